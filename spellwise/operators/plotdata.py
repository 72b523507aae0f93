"""The data behind charts: timelines, distributions, flows, heat maps, risk grids and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ordering, tables

#: Colours of the employment states, and of charts of effects.
STATUS_COLORS = {"disoccupato": "#B0BEC5", "occ_pt": "#4FC3F7", "occ_ft": "#1565C0", "over_pt_pt": "#FFB74D", "over_pt_ft": "#FB8C00", "over_ft_pt": "#F4511E", "over_ft_ft": "#B71C1C"}


def luminance(color: str) -> float:
    """Relative luminance of #RRGGBB."""
    parts = [int(color[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    linear = [p / 12.92 if p <= 0.03928 else ((p + 0.055) / 1.055) ** 2.4 for p in parts]
    return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]


def contrast(a: str, b: str) -> float:
    x, y = sorted((luminance(a), luminance(b)), reverse=True)
    return (x + 0.05) / (y + 0.05)


def status_colors(states: list[str]) -> dict[str, str]:
    return {s: STATUS_COLORS.get(s, "#757575") for s in states}


def timeline(segments: DataFrame, persons: int = 20, gaps: bool = True, overlaps: bool = True) -> DataFrame:
    """The segments of the first persons by id, with their row on the chart."""
    rows = segments.join(segments.select("cf").distinct().orderBy("cf").limit(persons).withColumn("y", F.row_number().over(Window.partitionBy().orderBy("cf"))), "cf")
    if not gaps:
        rows = rows.where("arco > 0")
    if not overlaps:
        rows = rows.where("arco <= 1")
    return rows.select("cf", "y", "inizio", "fine", "stato", "durata")


def distribution(segments: DataFrame, by: str = "month", measure: str = "count", group: str | None = None) -> DataFrame:
    """Segments or days by period of the start and status, with their share of the period (and group)."""
    keys = [F.date_trunc(by, "inizio").cast("date").alias("period"), *([F.col(group)] if group else [])]
    value = F.count("*") if measure == "count" else F.sum("durata")
    out = segments.groupBy(*keys, "stato").agg(value.alias("value"))
    return out.withColumn("share", F.round(C.ratio(F.col("value"), F.sum("value").over(Window.partitionBy("period", *([group] if group else [])))), 6))


def duration_summary(segments: DataFrame, min_days: int = 1, max_days: int | None = None) -> DataFrame:
    """Median, mean, upper quartile and number of segments by status."""
    rows = segments.where(F.col("durata") >= min_days)
    rows = rows if max_days is None else rows.where(F.col("durata") <= max_days)
    return rows.groupBy("stato").agg(F.median("durata").alias("median"), F.round(F.avg("durata"), 6).alias("mean"), F.percentile("durata", F.lit(0.75)).alias("q75"), F.count("*").alias("n"))


def modal_status(segments: DataFrame, by: str = "year") -> DataFrame:
    """Each person's most frequent status in a period; of equals the first by name."""
    counts = segments.groupBy("cf", F.date_trunc(by, "inizio").cast("date").alias("period"), "stato").agg(F.count("*").alias("n"))
    best = counts.groupBy("cf", "period").agg(F.min(F.struct(-F.col("n"), "stato")).alias("b"))
    return best.select("cf", "period", F.col("b.stato").alias("stato"))


def flows(segments: DataFrame, by: str = "year") -> DataFrame:
    """First to last modal status of persons with two periods or more."""
    ends = modal_status(segments, by).groupBy("cf").agg(F.count("*").alias("n"), F.min_by("stato", "period").alias("from"), F.max_by("stato", "period").alias("to"))
    return ends.where("n >= 2").groupBy("from", "to").agg(F.count("*").alias("n"))


def heatmap(segments: DataFrame, by: str = "month") -> DataFrame:
    """Density of segments, mean duration and changes by person and period."""
    return segments.groupBy("cf", F.date_trunc(by, "inizio").cast("date").alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("durata"), 6).alias("mean_duration"), (F.count("*") - 1).alias("changes"))


#: The code of each employment state on the status heat map; other states are 0.
STATUS_CODES = {"disoccupato": 0, "occ_pt": 1, "occ_ft": 2, "over_pt_pt": 3, "over_ft_pt": 4, "over_pt_ft": 4, "over_ft_ft": 5}


def status_heatmap(segments: DataFrame, by: str = "month") -> DataFrame:
    """The highest status code by person and period of the start."""
    code = F.lit(0)
    for state, k in STATUS_CODES.items():
        code = F.when(F.col("stato") == state, k).otherwise(code)
    return segments.groupBy("cf", F.date_trunc(by, "inizio").cast("date").alias("period")).agg(F.max(code).alias("status_code"))


def overlap_heatmap(segments: DataFrame, least: int = 2, cap: int = 5) -> DataFrame:
    """The most jobs at once by person and month, shown up to a cap."""
    return segments.where(F.col("arco") >= least).groupBy("cf", F.date_trunc("month", "inizio").cast("date").alias("month")).agg(F.least(F.max("arco"), F.lit(cap)).alias("jobs"))


def gantt(segments: DataFrame) -> DataFrame:
    """Bars with their middle and a label of days, months or years."""
    label = F.when(F.col("durata") < 60, F.concat(F.col("durata").cast("string"), F.lit("d"))).when(F.col("durata") < 730, F.concat(F.round(F.col("durata") / 30.44).cast("int").cast("string"), F.lit("m"))).otherwise(F.concat(F.round(F.col("durata") / 365.25, 1).cast("string"), F.lit("y")))
    return segments.select("cf", "inizio", "fine", "stato", F.date_add("inizio", (F.col("durata") / 2).cast("int")).alias("middle"), label.alias("label"))


def kpis(segments: DataFrame) -> DataFrame:
    """Key figures in one row."""
    job = F.col("arco") >= 1
    return segments.agg(F.count_distinct("cf").alias("n_persons"), F.count("*").alias("n_segments"), F.round(100 * C.ratio(C.sum_if(job, "durata"), F.sum("durata")), 6).alias("employment_rate_pct"), F.round(F.avg("durata"), 6).alias("mean_duration"), F.round(100 * C.ratio(C.count_if(F.col("arco") > 1), C.count_if(job)), 6).alias("overlap_pct"))


def monthly_rates(segments: DataFrame) -> DataFrame:
    """Persons and the share of employment segments by month of start."""
    return segments.groupBy(F.date_trunc("month", "inizio").cast("date").alias("month")).agg(F.count_distinct("cf").alias("n_persons"), F.round(F.avg((F.col("arco") >= 1).cast("double")), 6).alias("employment_rate"))


def survival_steps(table: DataFrame, group: str = "contract_type") -> DataFrame:
    """The steps of survival curves: from (0, 1), each with where it ends and whether it is a censoring mark."""
    rows = table.select(group, F.col("time").cast("int").alias("time"), "survival_prob", "lower_ci", "upper_ci", "n_event")
    zero = table.select(group).distinct().select(group, F.lit(0).alias("time"), F.lit(1.0).alias("survival_prob"), F.lit(1.0).alias("lower_ci"), F.lit(1.0).alias("upper_ci"), F.lit(1).cast("long").alias("n_event"))
    return zero.unionByName(rows).withColumns({"next_time": F.lead("time").over(Window.partitionBy(group).orderBy("time")), "censor_mark": F.col("n_event") == 0}).drop("n_event")


def over_id_summary(segments: DataFrame) -> DataFrame:
    """Segments and days of each employment episode (over_id counts within a person), with quartiles of the days."""
    q = F.percentile("durata", [0.25, 0.5, 0.75])
    out = segments.where("over_id > 0").groupBy("cf", "over_id").agg(F.count("*").alias("n"), F.sum("durata").alias("total_days"), F.round(F.avg("durata"), 6).alias("mean_days"), F.max("arco").alias("most_jobs"), q.alias("q"))
    return out.select("cf", "over_id", "n", "total_days", "mean_days", "most_jobs", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def milestones(segments: DataFrame, persons: int = 10) -> DataFrame:
    """Start and end marks on a Gantt chart of the persons with most days (ties by id): one mark a person and date, a start where both fall together (a top report)."""
    top = segments.groupBy("cf").agg(F.sum("durata").alias("days")).orderBy(F.desc("days"), "cf").limit(persons)
    placed = top.withColumn("y", F.row_number().over(Window.partitionBy().orderBy(F.desc("days"), "cf")))  # `persons` rows
    marks = segments.select("cf", F.explode(F.array(F.struct(F.col("inizio").alias("date"), F.lit(0).alias("late")), F.struct(F.col("fine").alias("date"), F.lit(1).alias("late")))).alias("m"))
    once = marks.join(F.broadcast(placed), "cf").groupBy("cf", "y", "m.date").agg(F.min("m.late").alias("late"))
    return once.select("cf", "y", "date", F.when(F.col("late") == 0, "start").otherwise("end").alias("type"))


def career_events(segments: DataFrame) -> DataFrame:
    """A row a person with a job: the first job's start, changes of contract between successive jobs, and the longest spell without one (the first of equals)."""
    order = Window.partitionBy("cf").orderBy("inizio", "fine")
    job = F.col("arco") > 0
    known = F.last(F.when(job, F.col(C.CONTRACT)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.withColumn("changed", job & known.isNotNull() & (F.col(C.CONTRACT) != known))
    gap = F.when(~job, F.struct(F.col("durata").alias("days"), (-F.unix_date("inizio")).alias("earlier"), F.col("inizio").alias("begins")))
    out = rows.groupBy("cf").agg(F.min(F.when(job, F.col("inizio"))).alias("first_job"), C.count_if(F.col("changed")).alias("contract_changes"), F.max(gap).alias("gap"), F.sum("durata").alias("total_days"))
    return out.where("first_job IS NOT NULL").select("cf", "first_job", "contract_changes", F.col("gap.begins").alias("longest_gap_start"), F.col("gap.days").alias("longest_gap_days"), "total_days")


def person_order(metrics: DataFrame, index: str, long_metrics: list[str]) -> DataFrame:
    """Persons ordered by an index, unpivoted: their row on the chart beside each metric."""
    once = tables.written(metrics.select("cf", F.lit(1).cast("long").alias("y"), *dict.fromkeys([index, *long_metrics])))
    placed = ordering.running_sums(once, index, ["y"], ties="cf", descending=True)
    return placed.withColumn("y", F.col("y_upto").cast("int")).select("cf", "y", *[F.col(c).cast("double").alias(c) for c in long_metrics]).unpivot(["cf", "y"], long_metrics, "metric_name", "metric_value")
