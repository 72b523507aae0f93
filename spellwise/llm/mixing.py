"""Temperature mixing of sources, in DataFrame operations only.

A source with token share p gets the weight p^a / sum(p^a).  The exponent a is bisected so that the weights reach a
target entropy, or so that no source is repeated more often than a limit.  Each source's documents are dealt to
blocks; an epoch is a permutation of the blocks and of the documents inside, and the last epoch of a source stops
where its token budget is used up.  That place is found by sums over parts of the order, then over parts of the part
in which it lies, until that holds few blocks; so no task orders the blocks of a large source.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens that a block aims at, and the parts into which the order of a source's blocks is divided when its end is sought.
BLOCK_TOKENS, FAN = 1 << 16, 1024
#: Exponents evaluated in a job (five halvings), and jobs.
_POINTS, _ROUNDS = 31, 6


def word_tokens(text: Column) -> Column:
    """White-space words of a text, at least one: an empty document takes a place too."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))).cast("long")


@dataclasses.dataclass
class Mixture:
    """What the exponent gives."""

    exponent: float
    entropy: float
    most_repeats: float
    tokens: int
    budget: float


def _measures(shares: DataFrame, exponents: list[float], scale: float | None) -> list[tuple[float, float, float]]:
    """Entropy, the largest repetition, and the budget in units of all tokens, for each exponent; one job."""
    p, log_p = F.col("share"), F.ln("share")
    columns = []
    for i, a in enumerate(exponents):
        power = F.exp(log_p * F.lit(a))
        columns += [F.sum(power).alias(f"z{i}"), F.sum(power * log_p).alias(f"l{i}"), F.max(power / p).alias(f"x{i}"), F.min(power / p).alias(f"n{i}")]
    row = shares.agg(*columns).first()
    found = []
    for i, a in enumerate(exponents):
        z, most, least = row[f"z{i}"], row[f"x{i}"], row[f"n{i}"]
        budget = z / least if scale is None else scale
        found.append((math.log(z) - a * row[f"l{i}"] / z, budget * most / z, budget))
    return found


def find_exponent(sizes: DataFrame, total: int, target_entropy: float | None, max_repeats: float | None, budget_tokens: int | None) -> Mixture:
    """The largest exponent in [0, 1] whose entropy reaches the target, or 0; then raised as far as the repetition limit asks.

    Entropy and repetitions both fall as the exponent grows.  Without a target the limit alone decides.
    """
    shares = sizes.select((F.col("tokens") / F.lit(float(total))).alias("share"))
    scale = None if budget_tokens is None else budget_tokens / total

    def bisect(good) -> float:
        """The boundary between exponents that are good (from 0 on) and those that are not."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            points = [low + (high - low) * (i + 1) / (_POINTS + 1) for i in range(_POINTS)]
            passed = [good(m) for m in _measures(shares, points, scale)]
            last = max((i for i, ok in enumerate(passed) if ok), default=-1)
            low, high = points[last] if last >= 0 else low, points[last + 1] if last + 1 < _POINTS else high
        return low

    exponent = 0.0
    if target_entropy is not None:
        exponent = 1.0 if _measures(shares, [1.0], scale)[0][0] >= target_entropy else bisect(lambda m: m[0] >= target_entropy)
    if max_repeats is not None and _measures(shares, [exponent], scale)[0][1] > max_repeats:
        exponent = min(1.0, bisect(lambda m: m[1] > max_repeats) + 2.0**-29)
    entropy, repeats, budget = _measures(shares, [exponent], scale)[0]
    return Mixture(exponent, entropy, repeats, total, budget * total)


def _ends(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """s, end and left: the block (by its key in the last epoch) in which each source's rest ends, and what is left of the rest there.

    blocks holds s, key and tokens.  A source whose rest covers all its blocks has no row.
    """
    rest = plan.select("s", F.col("rest").alias("left"))
    inside, shift = blocks, 64
    place = lambda key, bits: F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(1 << 63))), bits)  # unsigned order as the signed one
    most = inside.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    while most > FAN and shift > 0:
        shift = max(0, shift - (FAN.bit_length() - 1))
        parts = common.written(inside.groupBy("s", place(F.col("key"), shift).alias("part")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
        before = F.sum("tokens").over(common.ordered("s", "part")) - F.col("tokens")
        at = parts.withColumn("before", before).join(rest, "s").where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("tokens")))
        rest = common.written(at.select("s", "part", (F.col("left") - F.col("before")).alias("left"), "n"))
        inside = common.written(inside.withColumn("part", place(F.col("key"), shift)).join(rest.select("s", "part"), ["s", "part"]).select("s", "key", "tokens"))
        most = rest.agg(F.max("n")).first()[0] or 0
        rest = rest.select("s", "left")
    before = F.sum("tokens").over(common.ordered("s", "key")) - F.col("tokens")
    at = inside.withColumn("before", before).join(rest, "s").where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("tokens")))
    return at.select("s", F.col("key").alias("end"), (F.col("left") - F.col("before")).alias("left"))


def mix(docs: DataFrame, max_repeats: float | None = 1.5, target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """The rows of docs as often as the mixture draws them, with epoch, block_key and doc_key: their order is the stream.

    Without budget_tokens the budget is the smallest that draws every document at least once, so nothing is lost and
    the source with the largest share appears once.  With a budget a source may be cut inside an epoch: its
    documents come in permuted order as long as the sum of their tokens stays within the rest.  A null source is a
    source of its own; a null or empty text counts one token; rows of a source that repeat an id, or have none, are drawn
    alike; an empty table gives no rows.  Columns of docs named epoch, block_key or doc_key are replaced.

    Tokens are counted once.  Only sums by source, block and part of the order are shuffled, pre-aggregated; the
    documents of a hot source are spread over its blocks, and just the block in which a source's budget ends is ordered, by ids.
    """
    own = [c for c in docs.columns if c not in ("epoch", "block_key", "doc_key")]
    count = tokens if tokens is not None else word_tokens(F.col("text"))
    source = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("null"))
    counted = common.written(docs.select(source.alias("s"), docs[id_col].alias("id"), count.alias("tokens")))
    sizes = common.written(counted.groupBy("s").agg(F.sum("tokens").alias("tokens")))
    total = sizes.agg(F.sum("tokens")).first()[0]
    # a row's own columns ride along in a struct, so that no name can clash with the working columns
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), source.alias("s"), docs[id_col].alias("id"))
    if not total:
        return rows.select("row.*", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block_key"), F.lit(0).cast("long").alias("doc_key"))
    found = find_exponent(sizes, total, target_entropy, max_repeats, budget_tokens)
    share = F.col("tokens") / F.lit(float(total))
    weight = F.exp(F.ln(share) * F.lit(found.exponent))
    z = sizes.agg(F.sum(weight)).first()[0]
    draws = F.lit(found.budget) * weight / F.lit(z) / F.col("tokens")
    plan = sizes.select("s", F.col("tokens").alias("size"), F.ceil(F.col("tokens") / BLOCK_TOKENS).alias("blocks"), draws.alias("draws"))
    plan = plan.withColumn("whole", F.floor(F.col("draws") + 1e-9)).withColumn("rest", F.round(F.greatest(F.lit(0.0), F.col("draws") - F.col("whole")) * F.col("size")).cast("long"))
    plan = common.written(plan.select("s", "blocks", "whole", "rest"))
    block = F.pmod(F.xxhash64(F.lit(seed), "s", "id"), "blocks")
    block_key = lambda epoch: F.xxhash64(F.lit(seed), epoch, "s", block)
    doc_key = lambda epoch: F.xxhash64(F.lit(seed), epoch, "id")
    # sources are few next to documents, but their table is joined, not collected: Spark broadcasts it if it is small
    last = counted.join(plan, "s").withColumn("key", block_key(F.col("whole")))
    blocks = common.written(last.groupBy("s", "key").agg(F.sum("tokens").alias("tokens")))
    ends = common.written(_ends(blocks, plan))
    in_end = last.join(ends, "s").where("key = end").groupBy("s", "id", "left").agg(F.sum("tokens").alias("tokens"), F.first(doc_key(F.col("whole"))).alias("doc"))
    inside = in_end.withColumn("upto", F.sum("tokens").over(common.ordered("s", "doc", "id"))).where("upto <= left")
    # in the end's block the documents up to the last one that fits; ids of one key (they have equal hashes) by id
    fits = common.written(inside.groupBy("s").agg(F.max(F.struct("doc", "id")).alias("fits")))
    place = plan.select("s", "blocks", "whole", "rest").join(ends.select("s", "end"), "s", "left").join(fits, "s", "left")
    key = block_key(F.col("whole"))
    until = F.struct(doc_key(F.col("whole")).alias("doc"), F.col("id").alias("id"))
    in_rest = F.when(F.col("end").isNull(), F.col("rest") > 0).otherwise((key < F.col("end")) | ((key == F.col("end")) & F.coalesce(until <= F.col("fits"), F.lit(False))))
    drawn = rows.join(place, "s").withColumn("times", F.col("whole") + in_rest.cast("long")).where("times > 0")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))))
    return drawn.select("row.*", "epoch", block_key(F.col("epoch").cast("long")).alias("block_key"), doc_key(F.col("epoch").cast("long")).alias("doc_key"))
