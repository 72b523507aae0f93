"""URL filters: host and path rules, and a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models of characters are counted over all distinct URLs: one of those that rules allow, one
of those they block.  A character's probability after its last ORDER characters is interpolated, with Witten-Bell
weights, from all shorter contexts down to a uniform one; a context that a model has not seen falls back to the next shorter one.  A URL's score
is the difference of its log-likelihoods under both, divided by its characters; the threshold is calibrated on URLs that rules
decide and that neither model was counted on.

Everything is DataFrame functions: no Python runs where the rows are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rules by host and path; a host stands for its subdomains too.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Characters of the longest context.
ORDER = 4
#: URLs that rules decide are kept for calibration where the MD5 of the URL begins with a hex digit below this: 3 of 16.
HELD_OUT = "3"
#: Keys that hold more than one row in so many are met by broadcast; there are fewer than this of them.
HOT = 1000
#: Steps of the calibrated threshold in one unit of score, and the largest score told apart.
STEPS, FARTHEST = 64, 16
#: Log-likelihoods are summed as integers, in units of one part in so many: sums do not depend on their order.
UNITS = 1_000_000_000
_START, _END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z in lower case; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _decided(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together; of equally long ones the first) and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):  # the longest is tested first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(url: Column, order: int) -> Column:
    """Each character of a URL and its end, behind the `order` characters before it."""
    characters = F.when(url == "", F.array().cast("array<string>")).otherwise(F.split(url, ""))
    padded = F.concat(F.array(*[F.lit(_START)] * order), characters, F.array(F.lit(_END)))
    # bound as a variable of an outer transform, the array is made once a URL and not once a character
    each = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - order), lambda i: F.array_join(F.slice(p, i, order + 1), ""))
    return F.transform(F.array(padded), each)[0]


def _looked_up(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with found by a key that found holds once, with n, the number of rows of the key.

    Keys of more than total / HOT rows meet the rows by broadcast, fewer than HOT in number; no other key is hot.
    """
    is_hot = F.col("n") * HOT > total
    hot, rest = found.where(is_hot).drop("n"), found.where(~is_hot).drop("n")
    by_broadcast = rows.join(F.broadcast(hot), key)
    by_exchange = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return by_broadcast.unionByName(by_exchange)


def _ratios(grams: DataFrame, order: int) -> DataFrame:
    """gram, n and ratio (in UNITS): the difference of the log-likelihoods of its last character, from gram, n, good and bad."""
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda i: F.substring(F.col("gram"), i, F.lit(order + 1)))
    counts = common.written(grams.select(F.explode(suffixes).alias("gram"), "good", "bad").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    before = F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1)
    about = [F.sum(c).alias(f"{c}_n") for c in ("good", "bad")] + [F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in ("good", "bad")]
    contexts = counts.groupBy(before.alias("before")).agg(*about)
    weighed = counts.withColumn("before", before).join(contexts, "before")
    for c in ("good", "bad"):
        all_of, n = F.col(f"{c}_n") + F.col(f"{c}_kinds"), F.col(f"{c}_n")
        weighed = weighed.withColumn(f"{c}_own", F.when(n > 0, F.col(c) / all_of).otherwise(0.0)).withColumn(f"{c}_back", F.when(n > 0, F.col(f"{c}_kinds") / all_of).otherwise(1.0))
    weighed = common.written(weighed.select("gram", F.length("gram").alias("size"), "good_own", "good_back", "bad_own", "bad_back"))
    uniform = 1.0 / (weighed.where("size = 1").count() + 1)
    level = weighed.where("size = 1").select("gram", *[(F.col(f"{c}_own") + F.col(f"{c}_back") * uniform).alias(c) for c in ("good", "bad")])
    for size in range(2, order + 2):
        shorter = level.select(F.col("gram").alias("suffix"), F.col("good").alias("good_less"), F.col("bad").alias("bad_less"))
        longer = weighed.where(F.col("size") == size).withColumn("suffix", F.substring("gram", 2, size)).join(shorter, "suffix")
        level = longer.select("gram", *[(F.col(f"{c}_own") + F.col(f"{c}_back") * F.col(f"{c}_less")).alias(c) for c in ("good", "bad")])
    ratio = F.round((F.log("good") - F.log("bad")) * UNITS).cast("long")
    return common.written(grams.select("gram", "n").join(level.select("gram", ratio.alias("ratio")), "gram"))


def _threshold(bins: list) -> float:
    """The step at which most of the allowed share stands from it on and most of the blocked share below; of equals the nearest to 0.

    Without held-out URLs of both kinds it is 0.
    """
    good, bad = sum(b.good for b in bins), sum(b.bad for b in bins)
    if not good or not bad:
        return 0.0
    counts = {b.bin: (b.good, b.bad) for b in bins}
    best, below_good, below_bad = None, 0, 0
    for step in range(min(counts), max(counts) + 2):
        worth = below_bad * good + (good - below_good) * bad, -abs(step), -step
        if best is None or worth > best:
            best = worth
        more = counts.get(step, (0, 0))
        below_good, below_bad = below_good + more[0], below_bad + more[1]
    return -best[2] / STEPS


def url_filter(pages: DataFrame, rules=RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score of each page.

    A rule fits its host and all subdomains, if the path starts with the rule's; the longest (host and path together) wins and decides. The
    rest is decided by the models: allow if the score is at the calibrated threshold or above. score is null where a rule
    decides. Where rules allow, or block, no URL that could be counted, there are no models: the score is null and the verdict allow.

    A null URL is an empty one; an empty URL is judged by its end alone; each repeated row has its own result row; null ids stay;
    an empty table gives no rows; columns other than the two named are not read.  Each distinct URL counts once in the models.

    Characters are looked up by exchange, but for the few that stand in more than one place of HOT, which are broadcast;
    all counts are partial aggregates over whole tables.
    """
    url = F.coalesce(pages[url_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), url.alias("url"))
    distinct = rows.groupBy("url").agg(F.count("*").alias("n"))
    label = _decided(host_of(F.col("url")), path_of(F.col("url")), rules)[1]
    held = F.substring(F.md5("url"), 1, 1) < HELD_OUT
    key = F.unhex(F.md5("url"))
    urls = common.written(distinct.select("url", "n", key.alias("key"), label.alias("label"), held.alias("held"), F.length("url").alias("length")))
    fitted = lambda what: F.count(F.when((F.col("label") == what) & ~F.col("held"), 1))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = _decided(host, path, rules)
    named = rows.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"), key.alias("key"))
    none = F.lit(None).cast("double")
    n_good, n_bad, n_pages = urls.agg(fitted("allow"), fitted("block"), F.sum("n")).first()
    if not n_good or not n_bad:
        return named.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), none.alias("score"))

    places = urls.select("label", "held", F.explode(_grams(F.col("url"), order)).alias("gram"))
    grams = common.written(places.groupBy("gram").agg(F.count("*").alias("n"), fitted("allow").alias("good"), fitted("block").alias("bad")))
    total = grams.agg(F.sum("n")).first()[0]
    asked = urls.where(F.col("label").isNull() | F.col("held")).select("key", F.explode(_grams(F.col("url"), order)).alias("gram"))
    sums = _looked_up(asked, _ratios(grams, order), "gram", total).groupBy("key").agg(F.sum("ratio").alias("ratio"))
    score = F.round(F.col("ratio") / F.lit(float(UNITS)) / (F.col("length") + 1), 6)
    scored = common.written(urls.drop("url").join(sums, "key").select("key", "n", "label", score.alias("score")))
    step = F.greatest(F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS * FARTHEST)), F.lit(-STEPS * FARTHEST))
    count = lambda what: F.count(F.when(F.col("label") == what, 1))
    bins = scored.where("label IS NOT NULL").groupBy(step.alias("bin")).agg(count("allow").alias("good"), count("block").alias("bad")).collect()
    least = _threshold(bins)
    judged = _looked_up(named.where("rule IS NULL"), scored.where("label IS NULL").select("key", "n", "score"), "key", n_pages)
    by_model = judged.select("page_id", "host", "path", "rule", F.when(F.col("score") >= least, "allow").otherwise("block").alias("verdict"), "score")
    return named.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), none.alias("score")).unionByName(by_model)
