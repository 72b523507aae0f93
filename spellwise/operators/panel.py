"""From period metrics to the panel that estimators take, and its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

#: Which of a person's inconsistent event times counts.
_PRIORITY = {"pre": 0, "post": 1, "control": 2}


def treatment_persons(assignment: DataFrame, id_col: str = "cf") -> DataFrame:
    """One row per person: is_treated is true where at least 80% of the rows say so, else that of the first period (pre, post, control)."""
    order = F.coalesce(*[F.when(F.col("event_time") == k, v) for k, v in _PRIORITY.items()], F.lit(3)) if "event_time" in assignment.columns else F.lit(0)
    rows = assignment.groupBy(id_col).agg(F.avg(F.col("is_treated").cast("double")).alias("share"), F.min_by("is_treated", F.struct(order, (~F.col("is_treated")).cast("int"))).alias("first"))
    verdict = F.when(F.col("share") >= 0.8, True).when(F.col("share") <= 0.2, False).otherwise(F.col("first"))
    return rows.select(id_col, verdict.alias("is_treated"))


def build_panel(metrics: DataFrame | list[DataFrame], assignment: DataFrame, outcomes: list[str] | None = None, id_col: str = "cf", period: str = "period", expand_controls: bool = True) -> DataFrame:
    """id, is_treated, period, post and the outcomes of each person and period.

    Several metric tables are joined in full.  A person whose only period is control counts in pre and post.
    Persons without treatment status are left out.
    """
    if isinstance(metrics, list):
        metrics = reduce(lambda a, b: a.join(b, [id_col, period], "full"), metrics)
    values = outcomes or [f.name for f in metrics.schema if isinstance(f.dataType, T.NumericType) and f.name not in (id_col, period)]
    rows = metrics.select(F.col(id_col).cast("string").alias(id_col), period, *values).join(treatment_persons(assignment, id_col).select(F.col(id_col).cast("string").alias(id_col), "is_treated"), id_col)
    if expand_controls:
        places = F.when(F.col(period) == "control", F.array(F.lit("pre"), F.lit("post"))).otherwise(F.array(F.col(period)))
        rows = rows.withColumn(period, F.explode(places))
    return rows.select(id_col, "is_treated", period, (F.col(period) == "post").cast("int").alias("post"), *values)


def validate_panel(panel: DataFrame, id_col: str = "cf") -> DataFrame:
    """One row: persons, those with both periods, treatment cells, and whether difference in differences can run (four cells)."""
    persons = panel.groupBy(id_col).agg(F.bool_or(F.col("post") == 0).alias("pre"), F.bool_or(F.col("post") == 1).alias("post"), F.bool_or("is_treated").alias("t"))
    counts = persons.agg(F.count("*").alias("n_persons"), C.count_if(F.col("t")).alias("n_treated"), C.count_if(F.col("pre") & F.col("post")).alias("n_both_periods"))
    cells = panel.agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct("is_treated", "post")).alias("n_cells"))
    return counts.join(cells).withColumn("did_ready", F.col("n_cells") >= 4)  # single rows
