"""Outcome metrics of each person and period for impact evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import career

KEYS = ["cf", "period"]


def _order():
    return Window.partitionBy(*KEYS).orderBy(F.asc_nulls_last("inizio"), F.asc_nulls_last("fine"))


def stability_metrics(segments: DataFrame, period: str = "period") -> DataFrame:
    return career.stability(segments.withColumnRenamed(period, "period"), "period")


def complexity_metrics(segments: DataFrame, period: str = "period") -> DataFrame:
    return career.complexity(segments.withColumnRenamed(period, "period"), "period")


def contract_quality(segments: DataFrame, permanent: list[str], temporary: list[str], internship: list[str] | None = None, contract: str = C.CONTRACT) -> DataFrame:
    """Days, rates and scores of contract kinds, typed transitions, the trend of the score and the improvement rate."""
    code = F.col(contract)
    perm, temp, intern = (F.coalesce(code.isin(*codes), F.lit(False)) if codes else F.lit(False) for codes in (permanent, temporary, internship))
    score = F.when(perm, 1.0).when(intern, 0.5).when(temp, 0.0).otherwise(0.25) if internship else F.when(perm, 1.0).when(temp, 0.0).otherwise(0.5)
    order = _order()
    rows = segments.where("over_id > 0 AND period IS NOT NULL").withColumns({"perm": perm, "temp": temp, "intern": intern, "score": score})
    rows = rows.withColumns({"rn": F.row_number().over(order), "was_perm": F.lag("perm").over(order), "was_temp": F.lag("temp").over(order), "was_intern": F.lag("intern").over(order), "step": F.col("score") - F.lag("score").over(order)})
    if internship:
        moves = [C.count_if(F.col(a) & F.col(b)) for a, b in (("was_temp", "perm"), ("was_perm", "temp"), ("was_temp", "intern"), ("was_intern", "perm"))]
    else:
        moves = [C.count_if(F.col("step") > 0.3), C.count_if(F.col("step") < -0.3), F.lit(0), F.lit(0)]
    sums = rows.groupBy(*KEYS).agg(
        C.sum_if(F.col("perm"), "durata").alias("p"), C.sum_if(F.col("temp"), "durata").alias("t"), C.sum_if(F.col("intern"), "durata").alias("i"), F.sum("durata").alias("d"),
        F.avg("score").alias("q"), F.count("*").alias("n"), *[m.alias(f"m{k}") for k, m in enumerate(moves)], F.regr_slope("score", "rn").alias("slope"),
    )
    p, t, i, d = (F.col(c) for c in "ptid")
    rates = {"permanent": C.ratio(p, d), "internship": C.ratio(i, d), "temporary": C.ratio(t, d)} if internship else {"permanent": C.ratio(p, p + t)}
    return sums.select(
        *KEYS, p.alias("permanent_contract_days"), t.alias("temporary_contract_days"), *([i.alias("internship_contract_days")] if internship else []), d.alias("total_employment_days"),
        F.col("q").alias("average_contract_quality"), F.col("n").alias("contract_observations"), *[r.alias(f"{k}_contract_rate") for k, r in rates.items()],
        F.col("m0").alias("temp_to_perm_transitions"), F.col("m1").alias("perm_to_temp_transitions"), F.col("m2").alias("temp_to_internship_transitions"), F.col("m3").alias("internship_to_perm_transitions"),
        F.when(F.col("n") >= 3, F.coalesce("slope", F.lit(0.0))).otherwise(0.0).alias("contract_stability_trend"), (F.col("m0") / F.greatest(F.lit(1.0), F.col("n") / 4)).alias("contract_improvement_rate"),
    )


def transition_patterns(segments: DataFrame) -> DataFrame:
    """Gaps between jobs, success of searches, changes of prior, and continuity.  A gap is start less previous end, so adjoining jobs are 1 apart."""
    order, jobs = _order(), Window.partitionBy(*KEYS, "e").orderBy(F.asc_nulls_last("inizio"), F.asc_nulls_last("fine"))
    rows = segments.where("period IS NOT NULL").withColumn("e", (F.col("over_id") > 0).cast("int"))
    rows = rows.withColumns({"gap": F.when(F.col("e") == 1, F.datediff("inizio", F.lag("fine").over(jobs))), "flip": F.col("e") - F.lag("e").over(order), "dp": F.col("prior") - F.lag("prior").over(order)})
    gap = F.when(F.col("gap") > 0, F.col("gap"))
    sums = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg(gap).alias("ag"), F.median(gap).alias("mg"), C.count_if(F.col("e") == 0).alias("idle"), C.count_if(F.col("flip") > 0).alias("found"),
        C.count_if(F.col("dp") != 0).alias("changes"), C.count_if(F.col("dp") > 0).alias("up"), C.count_if(F.col("dp") < 0).alias("down"), C.count_if(F.col("flip") != 0).alias("flips"),
        F.sum("durata").alias("days"), C.sum_if(F.col("e") == 1, "durata").alias("worked"),
    )
    many = F.col("n") > 1
    zero = lambda x: F.when(many, x.cast("double")).otherwise(0.0)
    return sums.select(
        *KEYS, F.when(many, F.col("ag")).alias("avg_time_to_next_job"), F.when(many, F.col("mg")).alias("median_time_to_next_job"), F.when(many, F.try_divide(F.col("found").cast("double"), F.col("idle"))).alias("job_search_success_rate"),
        zero(F.col("changes")).alias("contract_type_changes"), zero(F.col("up")).alias("upward_transitions"), zero(F.col("down")).alias("downward_transitions"),
        zero(F.col("flips") / F.greatest(F.lit(1.0), F.col("days") / 365.25)).alias("transition_frequency"), F.when(many, F.col("worked") / F.greatest(F.lit(1.0), F.col("days"))).otherwise(1.0).alias("employment_continuity_index"),
    )


def success_index(quality: DataFrame, stability: DataFrame) -> DataFrame:
    """.35 quality, .25 employment rate, .25 stability and .15 improvement, with neutral values where one is missing."""
    rows = quality.select(*KEYS, "average_contract_quality", "contract_improvement_rate").join(stability.select(*KEYS, "employment_stability_index", "employment_rate"), KEYS, "left")
    value = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    index = 0.35 * value("average_contract_quality", 0.5) + 0.25 * value("employment_rate", 0.5) + 0.25 * value("employment_stability_index", 0.5) + 0.15 * F.least(F.lit(1.0), value("contract_improvement_rate", 0.3))
    return rows.select(*KEYS, C.clamp(index).alias("career_success_index"))


def impact_category() -> Column:
    name = F.col("metric_name")
    return (
        F.when(name.rlike("employment|spell|turnover|stability"), "stability")
        .when(name.rlike("contract|permanent|temporary|quality"), "quality")
        .when(name.rlike("concurrent|diversity|complexity|fragmentation"), "complexity")
        .when(name.rlike("transition|continuity|search|time"), "transitions")
        .when(name.rlike("career_success_index|career_advancement_index"), "career_success")
        .when(name.rlike("^career_|employment_intensity_score|growth_opportunity_score"), "career_metrics")
        .otherwise("other")
    )


def comprehensive(segments: DataFrame, permanent: list[str], temporary: list[str], internship: list[str] | None = None, form: str = "wide") -> DataFrame:
    """All period metrics in one row for each person and period (full outer joins), wide or long."""
    quality, stable = contract_quality(segments, permanent, temporary, internship), stability_metrics(segments)
    parts = [stable, quality, complexity_metrics(segments), transition_patterns(segments), success_index(quality, stable)]
    seen, frames = set(KEYS), []
    for part in parts:
        frames.append(part.select(*KEYS, *[c for c in part.columns if c not in seen]))
        seen |= set(part.columns)
    wide = reduce(lambda a, b: a.join(b, KEYS, "full"), frames)
    return wide if form == "wide" else career.long_form(wide, KEYS, impact_category())
