"""Career metrics of each person, or person and period: success, transitions, stability and complexity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

_TINY = 1e-10


def _keys(period: str | None) -> list[str]:
    return [C.PERSON, *([period] if period else [])]


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(F.asc_nulls_last(C.START), F.asc_nulls_last(C.END))


def contract_quality(valid: DataFrame, contract: str = C.CONTRACT, medians: DataFrame | None = None) -> DataFrame:
    """contract and quality: the median duration (or a given median survival) of a type, scaled to 0.1 .. 1; 0.5 if all are equal."""
    if medians is None:
        medians = valid.where(F.col(contract).isNotNull()).groupBy(F.col(contract).alias("contract")).agg(F.median(C.DAYS).alias("median"))
    else:
        medians = medians.where("median > 0")
    span = medians.agg(F.min("median").alias("low"), F.max("median").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), 0.1 + 0.9 * F.try_divide(F.col("median") - F.col("low"), F.col("high") - F.col("low"))).otherwise(0.5)
    return medians.join(F.broadcast(span)).select("contract", scaled.alias("quality"))  # one row


def success(segments: DataFrame, period: str | None = None, contract: str = C.CONTRACT, min_days: int = 1, enhance: bool = True, medians: DataFrame | None = None) -> DataFrame:
    """Quality, intensity, stability and growth scores, and the success and advancement indices."""
    keys = _keys(period)
    valid = segments.where((F.col(C.EPISODE) > 0) & (F.col(C.DAYS) >= min_days))
    scores = contract_quality(valid, contract, medians)
    d = F.col(C.DAYS)
    rows = valid.join(scores, F.col(contract) == F.col("contract"), "left")
    rows = rows.withColumns({"q": F.coalesce("quality", F.lit(0.5)), "i": F.when(F.col("prior").isNull(), 0.5).otherwise(C.clamp(F.col("prior") / 3))})
    order = _order(keys)
    better = lambda x: (F.col(x) > F.lag(x).over(order) * 1.05).cast("int")
    rows = rows.withColumn("better", F.coalesce(better("q"), F.lit(0)) + F.coalesce(better("i"), F.lit(0)))
    per_type = rows.groupBy(*keys, F.col(contract).alias("type")).agg(F.sum(d).alias("days"))
    total = F.sum("days").over(Window.partitionBy(*keys))
    p = F.col("days") / F.col("total")
    types = per_type.withColumn("total", total).groupBy(*keys).agg(F.count("*").alias("k"), F.sum(-p * F.ln(p + _TINY)).alias("entropy"))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(d).alias("days"), (F.sum(F.col("q") * d) / F.sum(d)).alias("q"), (F.sum(F.col("i") * d) / F.sum(d)).alias("i"),
        F.avg(d).alias("mean"), F.var_samp(d).alias("var"), (C.sum_if(F.col("q") > 0.7, d) / F.sum(d)).alias("high"), F.sum("better").alias("better"),
    )
    out = sums.join(types, keys)
    stability = F.when(F.col("n") > 1, C.clamp(1 - F.least(F.lit(1.0), F.col("var") / F.col("mean") / 2))).otherwise(0.5)
    diversity = F.when(F.col("k") > 1, F.col("entropy") / F.ln(F.col("k").cast("double"))).otherwise(0.0)
    out = out.withColumns({"s": stability, "g": C.clamp(0.6 * F.col("high") + 0.4 * diversity)})
    q, i, s, g = (F.col(c) for c in "qisg")
    if enhance:
        index = F.sqrt(F.least(F.lit(1.0), F.pow(F.sqrt(q), F.lit(0.35)) * F.pow(F.pow(i, F.lit(1.5)), F.lit(0.25)) * F.pow(C.sigmoid(s, 4, 0.5), F.lit(0.25)) * F.pow(g, F.lit(0.15))))
    else:
        index = C.clamp(0.35 * q + 0.25 * i + 0.25 * s + 0.15 * g)
    rate = F.try_divide(F.col("better").cast("double"), 2.0 * (F.col("n") - 1))
    return out.select(
        *keys, F.col("days").alias("total_employment_days"), q.alias("contract_quality_score"), i.alias("employment_intensity_score"), s.alias("career_stability_score"), g.alias("growth_opportunity_score"),
        index.alias("career_success_index"), F.when(F.col("n") <= 1, 0.0).otherwise(C.sigmoid(rate, 6, 0.3)).alias("career_advancement_index"),
    )


def job_transitions(segments: DataFrame, period: str | None = None, contract: str = C.CONTRACT, salary: str | None = "retribuzione", medians: DataFrame | None = None) -> DataFrame:
    """Improvements and deteriorations between a person's successive jobs: expected duration (10%), full time, salary (5%)."""
    keys = _keys(period)
    valid = segments.where(F.col(C.EPISODE) > 0)
    if medians is None:
        medians = valid.where(F.col(contract).isNotNull()).groupBy(F.col(contract).alias("contract")).agg(F.median(C.DAYS).alias("median"))
    fallback = valid.agg(F.median(C.DAYS).alias("fallback"))
    rows = valid.join(medians, F.col(contract) == F.col("contract"), "left").join(F.broadcast(fallback))  # one row
    rows = rows.withColumns({"expected": F.coalesce("median", "fallback"), "full": F.col("prior") >= 1})
    order = _order(keys)
    before = lambda x: F.lag(x).over(order)
    pairs = {"up_d": F.col("expected") > before("expected") * 1.1, "down_d": F.col("expected") < before("expected") * 0.9, "up_f": ~before("full") & F.col("full"), "down_f": before("full") & ~F.col("full")}
    if salary:
        pairs |= {"up_s": F.col(salary) > before(salary) * 1.05, "down_s": F.col(salary) < before(salary) * 0.95}
    rows = rows.withColumns(pairs)
    sums = rows.groupBy(*keys).agg((F.count("*") - 1).alias("n"), *[C.count_if(F.col(c)).alias(c) for c in pairs])
    ups = [F.col(c) for c in ("up_d", "up_f", "up_s") if c in pairs]
    rate = C.ratio(reduce(lambda a, b: a + b, ups), F.col("n"))
    names = {"up_d": "duration_improvements", "down_d": "duration_deteriorations", "up_f": "fulltime_improvements", "down_f": "fulltime_deteriorations", "up_s": "salary_improvements", "down_s": "salary_deteriorations"}
    counts = [F.col(c).alias(names[c]) for c in pairs]
    return sums.select(*keys, F.col("n").alias("total_transitions"), *counts, rate.alias("composite_improvement_rate"), (rate / len(ups)).alias("career_advancement_index"))


def stability(segments: DataFrame, period: str | None = None, min_days: int = 1) -> DataFrame:
    """Days in and out of work, spells as runs of one status, turnover, and the stability index."""
    keys = _keys(period)
    valid = segments.where(F.col(C.DAYS) >= min_days).withColumn("e", (F.col(C.EPISODE) > 0).cast("int"))
    order = _order(keys)
    changed = F.when(F.col("e") == F.lag("e").over(order), 0).otherwise(1)
    runs = valid.withColumn("run", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run", "e").agg(F.sum(C.DAYS).alias("d"), F.count("*").alias("m"))
    job, idle, d = F.col("e") == 1, F.col("e") == 0, F.col("d")
    sums = runs.groupBy(*keys).agg(
        F.sum("m").alias("n"), C.sum_if(job, d).alias("emp"), C.sum_if(idle, d).alias("un"), C.count_if(job).alias("ej"), C.count_if(idle).alias("ui"),
        F.coalesce(F.avg(F.when(job, d)), F.lit(0.0)).alias("ae"), F.coalesce(F.avg(F.when(idle, d)), F.lit(0.0)).alias("au"),
        F.coalesce(F.max(F.when(job, d)), F.lit(0)).alias("me"), F.coalesce(F.max(F.when(idle, d)), F.lit(0)).alias("mu"),
    )
    total = F.col("emp") + F.col("un")
    rate = C.ratio(F.col("emp"), total)
    one = F.lit(1.0)
    index = F.least(one, 0.4 * rate + 0.3 * F.least(one, F.col("me") / 365) + 0.2 * F.greatest(F.lit(0.0), 1 - F.least(one, F.col("ej") / 4)) + 0.1 * F.least(one, F.col("ae") / 90))
    single = F.col("n") <= 1
    return sums.select(
        *keys, F.col("emp").alias("days_employed"), F.col("un").alias("days_unemployed"), total.alias("total_days"), F.col("n").alias("total_observations"), rate.alias("employment_rate"),
        F.col("ej").alias("employment_spells"), F.col("ui").alias("unemployment_spells"), F.col("ae").alias("avg_employment_spell"), F.col("au").alias("avg_unemployment_spell"),
        F.col("me").alias("max_employment_spell"), F.col("mu").alias("max_unemployment_spell"),
        F.when(single, 0.0).otherwise(F.col("ej") / F.greatest(total / 365.25, F.lit(1 / 365.25))).alias("job_turnover_rate"), F.when(single, rate).otherwise(index).alias("employment_stability_index"),
    )


def _entropy(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    counts = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg(F.count("*").alias("k"), F.sum(-F.col("p") * F.ln(F.col("p") + _TINY)).alias("h")).select(*keys, F.when(F.col("k") > 1, F.col("h")).otherwise(0.0).alias("h"))


def complexity(segments: DataFrame, period: str | None = None, diversity: str = "prior") -> DataFrame:
    """Concurrency, diversity (entropy), fragmentation and their composite."""
    keys = _keys(period)
    job, d = F.col(C.EPISODE) > 0, F.col(C.DAYS)
    flips = F.abs(job.cast("int") - F.lag(job.cast("int")).over(_order(keys)))
    sums = segments.withColumn("flip", flips).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(job, F.col(C.JOBS))), F.lit(0)).cast("double").alias("mx"), F.coalesce(F.avg(F.when(job, F.col(C.JOBS))), F.lit(0.0)).alias("av"),
        C.sum_if(job & (F.col(C.JOBS) > 1), d).cast("double").alias("conc"), C.sum_if(job, d).cast("double").alias("days"), F.sum("flip").alias("flips"), F.sum(d).alias("all_days"), C.count_if(job).alias("jobs"),
    )
    out = sums.join(_entropy(segments.where(job), keys, diversity), keys, "left")
    h, rate, none = F.coalesce("h", F.lit(0.0)), C.ratio(F.col("conc"), F.col("days")), F.col("jobs") == 0
    years = F.greatest(F.lit(1.0), F.col("all_days") / 365.25)
    fragments = F.when(F.col("flips").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("flips") / years / 4.0))  # a single row has no flips
    raw = 0.25 * F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.col("mx") - 1))) + 0.25 * C.sigmoid(rate, 15, 0.05) + 0.3 * (1 - F.exp(-3 * h)) + 0.2 * F.least(F.lit(1.0), F.pow(fragments, F.lit(0.7)))
    zero = lambda x: F.when(none, 0.0).otherwise(x)
    return out.select(
        *keys, F.col("mx").alias("max_concurrent_jobs"), F.col("av").alias("avg_concurrent_jobs"), F.col("conc").alias("concurrent_employment_days"), F.col("days").alias("total_employment_days"),
        rate.alias("concurrent_employment_rate"), h.alias("employment_diversity_index"), zero(fragments).alias("career_fragmentation_index"), zero(F.sqrt(F.least(F.lit(1.0), raw))).alias("career_complexity_index"),
    )


def unified(segments: DataFrame, period: str | None = None, contract: str = C.CONTRACT, min_days: int = 7, enhance: bool = True, medians: DataFrame | None = None) -> DataFrame:
    """Success, stability and complexity of each person's (or person and period's) employment segments of min_days or more, from one exchange.

    Segments without employment take no part, so rates count employed days only.  Order, sums and both entropies (of types by days, of
    intensity by segments) come from one window and one aggregate by person.
    """
    keys = _keys(period)
    valid = segments.where((F.col(C.EPISODE) > 0) & (F.col(C.DAYS) >= min_days))
    d = F.col(C.DAYS)
    rows = valid.join(contract_quality(valid, contract, medians), F.col(contract) == F.col("contract"), "left")
    rows = rows.select(*keys, C.START, C.END, d.cast("long").alias("d"), F.col(C.JOBS).alias("jobs"), F.col(contract).alias("type"), "prior", F.coalesce("quality", F.lit(0.5)).alias("q"), F.when(F.col("prior").isNull(), 0.5).otherwise(C.clamp(F.col("prior") / 3)).alias("i"))
    order = _order(keys)
    better = lambda x: F.coalesce((F.col(x) > F.lag(x).over(order) * 1.05).cast("int"), F.lit(0))
    sums = rows.withColumn("better", better("q") + better("i")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("d").alias("days"), (F.sum(F.col("q") * F.col("d")) / F.sum("d")).alias("q"), (F.sum(F.col("i") * F.col("d")) / F.sum("d")).alias("i"), F.avg("d").alias("mean"), F.var_samp("d").alias("var"),
        (C.sum_if(F.col("q") > 0.7, F.col("d")) / F.sum("d")).alias("high"), F.sum("better").alias("better"), F.max("jobs").cast("double").alias("mx"), F.avg("jobs").alias("av"), C.sum_if(F.col("jobs") > 1, F.col("d")).cast("double").alias("conc"),
        F.collect_list(F.struct(F.coalesce(F.col("type").cast("string"), F.lit("")).alias("v"), F.col("d").alias("w"))).alias("types"), F.collect_list(F.struct(F.coalesce(F.col("prior").cast("string"), F.lit("")).alias("v"), F.lit(1).cast("long").alias("w"))).alias("priors"),
    )

    def shares(pairs: str) -> Column:
        """The share of each distinct value in the weights; a person has few segments."""
        whole = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + p["w"])
        own = lambda v: F.aggregate(F.filter(pairs, lambda p: p["v"] == v), F.lit(0).cast("long"), lambda s, p: s + p["w"])
        return F.transform(F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["v"]))), lambda v: own(v) / whole)

    entropy = lambda p: F.when(F.size(p) > 1, F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.ln(x + _TINY))).otherwise(0.0)
    out = sums.withColumns({"tp": shares("types"), "pp": shares("priors")})
    out = out.withColumns({"s": F.when(F.col("n") > 1, C.clamp(1 - F.least(F.lit(1.0), F.col("var") / F.col("mean") / 2))).otherwise(0.5), "h": entropy(F.col("pp")), "rate": C.ratio(F.col("conc"), F.col("days"))})
    diversity = F.when(F.size("tp") > 1, entropy(F.col("tp")) / F.ln(F.size("tp").cast("double"))).otherwise(0.0)
    out = out.withColumn("g", C.clamp(0.6 * F.col("high") + 0.4 * diversity))
    q, i, s, g, days, one = F.col("q"), F.col("i"), F.col("s"), F.col("g"), F.col("days"), F.lit(1.0)
    if enhance:
        index = F.sqrt(F.least(one, F.pow(F.sqrt(q), F.lit(0.35)) * F.pow(F.pow(i, F.lit(1.5)), F.lit(0.25)) * F.pow(C.sigmoid(s, 4, 0.5), F.lit(0.25)) * F.pow(g, F.lit(0.15))))
    else:
        index = C.clamp(0.35 * q + 0.25 * i + 0.25 * s + 0.15 * g)
    rate = F.try_divide(F.col("better").cast("double"), 2.0 * (F.col("n") - 1))
    security = F.least(one, 0.4 + 0.3 * F.least(one, days / 365) + 0.2 * 0.75 + 0.1 * F.least(one, days / 90))
    raw = 0.25 * F.least(one, F.sqrt(F.greatest(F.lit(0.0), F.col("mx") - 1))) + 0.25 * C.sigmoid(F.col("rate"), 15, 0.05) + 0.3 * (1 - F.exp(-3 * F.col("h")))
    return out.select(
        *keys, days.alias("total_employment_days"), q.alias("contract_quality_score"), i.alias("employment_intensity_score"), s.alias("career_stability_score"), g.alias("growth_opportunity_score"), index.alias("career_success_index"),
        F.when(F.col("n") <= 1, 0.0).otherwise(C.sigmoid(rate, 6, 0.3)).alias("career_advancement_index"), F.lit(1.0).alias("employment_rate"), days.cast("double").alias("max_employment_spell"),
        F.when(F.col("n") <= 1, 0.0).otherwise(1 / F.greatest(days / 365.25, F.lit(1 / 365.25))).alias("job_turnover_rate"), security.alias("employment_stability_index"), F.col("mx").alias("max_concurrent_jobs"), F.col("av").alias("avg_concurrent_jobs"),
        F.col("conc").alias("concurrent_employment_days"), F.col("rate").alias("concurrent_employment_rate"), F.col("h").alias("employment_diversity_index"), F.lit(0.0).alias("career_fragmentation_index"), F.sqrt(F.least(one, raw)).alias("career_complexity_index"),
    )


def long_form(wide: DataFrame, keys: list[str], category: Column) -> DataFrame:
    """keys, metric_name, metric_value and metric_category of a wide table."""
    values = [c for c in wide.columns if c not in keys]
    doubles = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(keys, values, "metric_name", "metric_value").withColumn("metric_category", category)


def career_category() -> Column:
    name = F.col("metric_name")
    return (
        F.when(name.rlike("quality|contract_quality|intensity|stability_score|growth_opportunity|performance_index"), "quality")
        .when(name.rlike("transition|improvement|deterioration|progression"), "transitions")
        .when(name.rlike("employment_rate|employment_spells|turnover|employment_stability"), "stability")
        .when(name.rlike("concurrent|diversity|complexity|fragmentation"), "complexity")
        .otherwise("other")
    )


def comprehensive(segments: DataFrame, period: str | None = None, metrics: tuple[str, ...] = ("success", "transitions", "stability", "complexity"), form: str = "wide") -> DataFrame | dict[str, DataFrame]:
    """The chosen metrics joined by person (rows of the last one stay), in wide or long form, or as a dictionary (list)."""
    make = {"success": success, "transitions": job_transitions, "stability": stability, "complexity": complexity}
    keys = _keys(period)
    parts = {m: make[m](segments, period) for m in metrics}
    if form == "list":
        return parts
    seen, frames = set(keys), []
    for m, part in parts.items():
        frames.append(part.select(*keys, *[F.col(c).alias(c if c not in seen else f"{c}_{m}") for c in part.columns if c not in keys]))
        seen |= set(part.columns)
    wide = reduce(lambda a, b: a.join(b, keys, "right"), frames)
    return wide if form == "wide" else long_form(wide, keys, career_category())
