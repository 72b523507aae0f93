"""Overlapping employment and what consolidation of over_id gives, per person and for the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def _employed() -> Column:
    return F.col("arco") >= 1


def _overlap() -> Column:
    return F.col("arco") > 1


def _idle() -> Column:
    return F.col("arco") == 0



def metric_rows(one: DataFrame, values: dict[str, Column]) -> DataFrame:
    """A single row as metric, value (text; numbers lose trailing zeros)."""
    text = lambda c: F.regexp_replace(F.format_string("%.4f", c.cast("double")), r"\.?0+$", "")
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), text(v).alias("value")) for k, v in values.items()])).alias("m")).select("m.*")


def person_overlaps(segments: DataFrame) -> DataFrame:
    """One row per person: counts, frequency and intensity of overlaps, complexity, and the unemployment beside them."""
    sums = segments.groupBy("cf").agg(
        C.count_if(_employed()).alias("total_employment_periods"),
        C.count_if(_overlap()).alias("overlapping_episodes"),
        C.count_if(F.col("arco") == 1).alias("single_job_periods"),
        F.coalesce(F.avg(F.when(_employed(), F.col("arco"))), F.lit(0.0)).alias("avg_concurrent_jobs"),
        F.coalesce(F.max(F.when(_employed(), F.col("arco"))), F.lit(0)).alias("max_concurrent_jobs"),
        C.sum_if(_overlap(), "durata").alias("total_overlap_days"),
        C.sum_if(_employed(), "durata").alias("total_employment_days"),
        F.coalesce(F.avg(F.when(_overlap(), F.col("durata"))), F.lit(0.0)).alias("avg_overlap_duration"),
        F.coalesce(F.max(F.when(_overlap(), F.col("durata"))), F.lit(0)).alias("max_overlap_duration"),
        F.count_distinct(F.when(_overlap() & (F.col("over_id") > 0), F.col("over_id"))).alias("unique_over_id_groups"),
        C.sum_if(_employed(), F.col("durata") * (F.col("arco") - 1)).alias("excess"),
        C.count_if(_idle()).alias("total_unemployment_periods"),
        C.sum_if(_idle(), "durata").alias("total_unemployment_days"),
    )
    return sums.select(
        "cf", "total_employment_periods", "overlapping_episodes", "single_job_periods",
        F.round(C.ratio(F.col("overlapping_episodes"), F.col("total_employment_periods")), 4).alias("overlap_frequency"),
        F.round("avg_concurrent_jobs", 2).alias("avg_concurrent_jobs"), "max_concurrent_jobs", "total_overlap_days", "total_employment_days",
        F.round(100 * C.ratio(F.col("total_overlap_days"), F.col("total_employment_days")), 2).alias("overlap_intensity_pct"),
        F.round("avg_overlap_duration", 1).alias("avg_overlap_duration"), "max_overlap_duration", "unique_over_id_groups",
        F.round(C.ratio(F.col("excess"), F.col("total_employment_days")), 4).alias("employment_complexity_score"),
        "total_unemployment_periods", "total_unemployment_days",
        F.round(C.ratio(F.col("total_employment_days"), F.col("total_unemployment_days"), None), 2).alias("employment_to_unemployment_ratio"),
    )


def aggregate_overlaps(segments: DataFrame) -> DataFrame:
    """Population figures as metric, value."""
    one = segments.agg(
        F.count_distinct("cf").alias("persons"), C.count_if(_employed()).alias("employed"), C.count_if(_overlap()).alias("overlapping"),
        F.count_distinct(F.when(_overlap(), F.col("cf"))).alias("with_overlaps"), F.avg(F.when(_employed(), F.col("arco"))).alias("avg_arco"), F.max("arco").alias("max_arco"),
        C.sum_if(_overlap(), "durata").alias("overlap_days"), C.sum_if(_employed(), "durata").alias("days"), F.avg(F.when(_overlap(), F.col("durata"))).alias("avg_d"),
        F.median(F.when(_overlap(), F.col("durata"))).alias("med_d"), F.count_distinct(F.when(_overlap() & (F.col("over_id") > 0), F.struct("cf", "over_id"))).alias("episodes"),
        C.count_if(_idle()).alias("idle"), C.sum_if(_idle(), "durata").alias("idle_days"),
    )
    c = F.col
    return metric_rows(one, {
        "total_persons": c("persons"), "total_employment_periods": c("employed"), "total_overlapping_periods": c("overlapping"), "persons_with_overlaps": c("with_overlaps"),
        "pct_persons_with_overlaps": F.round(100 * C.ratio(c("with_overlaps"), c("persons")), 1), "overlap_frequency_population": F.round(C.ratio(c("overlapping"), c("employed")), 4),
        "avg_employment_intensity": F.round("avg_arco", 2), "max_employment_intensity": c("max_arco"), "total_overlap_days": c("overlap_days"), "total_employment_days": c("days"),
        "population_overlap_intensity_pct": F.round(100 * C.ratio(c("overlap_days"), c("days")), 2), "avg_overlap_duration": F.round(F.coalesce("avg_d", F.lit(0.0)), 1),
        "median_overlap_duration": F.round(F.coalesce("med_d", F.lit(0.0)), 1), "unique_overlap_episodes": c("episodes"),
        "avg_overlap_episodes_per_person": F.round(C.ratio(c("episodes"), c("with_overlaps")), 2), "total_unemployment_periods": c("idle"), "total_unemployment_days": c("idle_days"),
        "employment_to_unemployment_ratio": F.round(C.ratio(c("days"), c("idle_days"), None), 2),
    })


def intensity_breakdown(segments: DataFrame) -> DataFrame:
    """Employment segments and their share by number of jobs."""
    return segments.where(_employed()).groupBy("arco").agg(F.count("*").alias("N")).withColumn("percentage", C.share(F.col("N")))


_BUCKETS = ((7, "1-7 days"), (30, "8-30 days"), (90, "31-90 days"), (180, "91-180 days"), (365, "181-365 days"))


def _days(name: str = "durata") -> list[Column]:
    d = F.col(name)
    return [F.sum(d).alias("total_days"), F.round(F.avg(d), 1).alias("avg_duration"), F.round(F.median(d), 1).alias("median_duration")]


def duration_distribution(segments: DataFrame) -> DataFrame:
    """Overlapping segments in six classes of duration; duration_rank is the order of the classes."""
    bucket, rank = F.lit("366+ days"), F.lit(len(_BUCKETS) + 1)
    for k, (top, name) in reversed(list(enumerate(_BUCKETS))):
        bucket, rank = F.when(F.col("durata") <= top, name).otherwise(bucket), F.when(F.col("durata") <= top, k + 1).otherwise(rank)
    out = segments.where(_overlap()).groupBy(bucket.alias("duration_category"), rank.alias("duration_rank")).agg(F.count("*").alias("n_periods"), *_days(), F.min("durata").alias("min_duration"), F.max("durata").alias("max_duration"))
    return out.withColumn("percentage", C.share(F.col("n_periods")))


def intensity_distribution(segments: DataFrame) -> DataFrame:
    """Employment segments by number of jobs, with shares of segments and days."""
    out = segments.where(_employed()).groupBy("arco").agg(F.count("*").alias("n_periods"), *_days(), F.count_distinct("cf").alias("n_persons"), F.count_distinct(F.when(F.col("over_id") > 0, F.col("over_id"))).alias("n_unique_over_id"))
    kind = F.when(F.col("arco") == 1, "Single employment").otherwise(F.format_string("Multiple employment (%d jobs)", F.col("arco")))
    return out.withColumns({"percentage_of_periods": C.share(F.col("n_periods")), "percentage_of_days": C.share(F.col("total_days")), "employment_type": kind})


def period_key(date: Column, by: str) -> Column:
    year = F.date_format(date, "yyyy")
    return {"month": F.date_format(date, "yyyy-MM"), "quarter": F.concat(year, F.lit("-Q"), F.quarter(date).cast("string")), "year": year}[by]


def period_label(date: Column, by: str) -> Column:
    year = F.date_format(date, "yyyy")
    return {"month": F.date_format(date, "MMMM yyyy"), "quarter": F.concat(F.lit("Q"), F.quarter(date).cast("string"), F.lit(" "), year), "year": year}[by]


def temporal_patterns(segments: DataFrame, by: str = "month") -> DataFrame:
    """Overlaps by month, quarter or year of their start."""
    start = F.col("inizio")
    out = segments.where(_overlap()).groupBy(period_key(start, by).alias("temporal_period"), period_label(start, by).alias("temporal_label")).agg(
        F.count("*").alias("n_overlapping_periods"), F.sum("durata").alias("total_overlap_days"), F.count_distinct("cf").alias("n_persons_with_overlaps"),
        F.round(F.avg("arco"), 2).alias("avg_concurrent_jobs"), F.max("arco").alias("max_concurrent_jobs"), F.round(F.avg("durata"), 1).alias("avg_overlap_duration"),
        F.count_distinct(F.when(F.col("over_id") > 0, F.col("over_id"))).alias("n_unique_over_id_episodes"),
    )
    return out.withColumns({"percentage_of_overlaps": C.share(F.col("n_overlapping_periods")), "percentage_of_overlap_days": C.share(F.col("total_overlap_days"))})


def group_comparison(segments: DataFrame, group: str) -> DataFrame:
    """Overlap figures by group, ranked (ties share the smaller rank)."""
    sums = segments.groupBy(group).agg(
        F.count_distinct("cf").alias("total_persons"), C.count_if(_employed()).alias("total_employment_periods"), C.count_if(_overlap()).alias("total_overlapping_periods"),
        F.count_distinct(F.when(_overlap(), F.col("cf"))).alias("persons_with_overlaps"), F.avg(F.when(_employed(), F.col("arco"))).alias("avg_arco"), F.max("arco").alias("max_employment_intensity"),
        C.sum_if(_overlap(), "durata").alias("overlap_days"), C.sum_if(_employed(), "durata").alias("days"), F.avg(F.when(_overlap(), F.col("durata"))).alias("avg_d"), C.sum_if(_idle(), "durata").alias("idle_days"),
    )
    c = F.col
    out = sums.select(
        group, "total_persons", "total_employment_periods", "total_overlapping_periods", "persons_with_overlaps",
        F.round(100 * C.ratio(c("persons_with_overlaps"), c("total_persons")), 1).alias("pct_persons_with_overlaps"),
        F.round(C.ratio(c("total_overlapping_periods"), c("total_employment_periods")), 4).alias("overlap_frequency"),
        F.round(F.coalesce("avg_arco", F.lit(0.0)), 2).alias("avg_employment_intensity"), "max_employment_intensity",
        F.round(100 * C.ratio(c("overlap_days"), c("days")), 2).alias("overlap_intensity_pct"), F.round(F.coalesce("avg_d", F.lit(0.0)), 1).alias("avg_overlap_duration"),
        F.round(C.ratio(c("days"), c("idle_days"), None), 2).alias("employment_to_unemployment_ratio"),
    )
    rank = lambda x: F.rank().over(Window.partitionBy().orderBy(F.desc(x)))  # noqa: E731  groups are few
    return out.withColumns({"overlap_frequency_rank": rank("overlap_frequency"), "overlap_intensity_rank": rank("overlap_intensity_pct"), "persons_with_overlaps_rank": rank("pct_persons_with_overlaps")})


def consolidated_persons(segments: DataFrame) -> DataFrame:
    """One row per person: segments before and after consolidation by over_id."""
    c, job = F.col, F.col("over_id") > 0
    episodes = segments.groupBy("cf", "over_id").agg(
        F.count("*").alias("n"), C.count_if(_employed()).alias("employed"), C.count_if(_idle()).alias("idle"), C.sum_if(_employed(), "durata").alias("days"),
        F.sum("durata").alias("all_days"), F.sum(F.when(_employed(), c("arco"))).alias("arco_sum"), F.max(F.when(_employed(), c("arco"))).alias("arco_max"),
    )
    sums = episodes.groupBy("cf").agg(
        F.sum("n").alias("total"), C.count_if(job).alias("jobs"), C.count_if(c("over_id") == 0).alias("idle_groups"), F.sum("employed").alias("employed"),
        F.coalesce(F.sum("arco_sum"), F.lit(0)).alias("arco_sum"), F.coalesce(F.max("arco_max"), F.lit(0)).alias("max_jobs"), F.sum("days").alias("days"),
        C.sum_if(job, "all_days").alias("job_days"), C.count_if(job & (c("n") > 1)).alias("overlapping_episodes"),
    )
    after = c("jobs") + c("idle_groups")
    return sums.select(
        "cf", c("total").alias("total_periods_original"), after.alias("total_periods_consolidated"), c("employed").alias("employment_periods_original"), c("jobs").alias("employment_periods_consolidated"),
        c("idle_groups").alias("unemployment_periods"), F.round(1 - C.ratio(after, c("total")), 4).alias("consolidation_ratio"), F.round(C.ratio(c("arco_sum"), c("employed")), 2).alias("employment_complexity_avg"),
        c("max_jobs").alias("max_simultaneous_jobs"), c("days").alias("total_employment_days_original"), c("job_days").alias("total_employment_days_consolidated"),
        F.round(C.ratio(c("days"), c("employed")), 1).alias("avg_employment_duration_original"), F.round(C.ratio(c("job_days"), c("jobs")), 1).alias("avg_employment_duration_consolidated"),
        F.round(C.ratio(c("job_days"), c("days"), 1.0), 4).alias("duration_efficiency"), "overlapping_episodes",
    )


def consolidated_aggregate(segments: DataFrame) -> DataFrame:
    """Population figures of consolidation as metric, value."""
    c = F.col
    one = segments.agg(
        F.count_distinct("cf").alias("persons"), F.count("*").alias("n"), C.count_if(_employed()).alias("employed"), C.count_if(_idle()).alias("idle"),
        F.count_distinct(F.when(c("over_id") > 0, F.struct("cf", "over_id"))).alias("jobs"), F.count_distinct(F.when(c("over_id") == 0, c("cf"))).alias("idle_groups"),
        F.median(F.when(_employed(), c("durata"))).alias("med"), F.avg(F.when(_employed(), c("arco"))).alias("avg_arco"), F.max("arco").alias("max_arco"),
        F.count_distinct(F.when(_overlap(), c("cf"))).alias("with_overlaps"),
    )
    after = c("jobs") + c("idle")
    kept = C.ratio(after, c("n"))
    return metric_rows(one, {
        "total_persons": c("persons"), "total_segments_original": c("n"), "total_employment_segments": c("employed"), "total_unemployment_segments": c("idle"),
        "total_consolidated_employment_periods": c("jobs"), "total_consolidated_unemployment_periods": c("idle_groups"), "avg_periods_per_person_original": F.round(C.ratio(c("n"), c("persons")), 2),
        "avg_employment_periods_per_person": F.round(C.ratio(c("employed"), c("persons")), 2), "median_employment_duration": F.round("med", 1), "avg_employment_complexity": F.round("avg_arco", 2),
        "max_employment_complexity": c("max_arco"), "pct_with_overlapping_employment": F.round(100 * C.ratio(c("with_overlaps"), c("persons")), 1), "total_consolidated_periods": after,
        "overall_consolidation_ratio": F.round(1 - kept, 4), "consolidation_efficiency_pct": F.round(100 * (1 - kept), 1),
    })


def consolidation_benefits(segments: DataFrame) -> DataFrame:
    """One row per employment episode: the segments that consolidation merges."""
    out = segments.where("over_id > 0").groupBy("cf", "over_id").agg(F.count("*").alias("original_segments"), F.sum("durata").alias("total_duration"), F.round(F.avg("arco"), 2).alias("avg_employment_intensity"), F.max("arco").alias("max_employment_intensity"))
    n = F.col("original_segments")
    return out.withColumns({"consolidated_segments": F.lit(1), "complexity_reduction": n - 1, "administrative_efficiency": F.when(n > 1, "High").otherwise("Standard")})


def employment_complexity(segments: DataFrame) -> DataFrame:
    """Employment segments by number of jobs."""
    out = segments.where(_employed()).groupBy("arco").agg(F.count("*").alias("segments_count"), F.sum("durata").alias("total_person_days"), F.round(F.avg("durata"), 1).alias("avg_duration"), F.count_distinct("cf").alias("persons_affected"))
    return out.withColumn("employment_intensity", F.col("arco"))
