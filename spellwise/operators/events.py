"""Treatment events, their timing, and treatment and control groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering

Condition = str | dict | Callable[[DataFrame], Column]
CONTROL = "Control (never treated)"


def as_column(condition: Condition, rows: DataFrame) -> tuple[Column, str]:
    """A condition as a column and its description: Spark SQL text, {column, operator, value}, or a function of the rows."""
    if isinstance(condition, str):
        return F.expr(condition), condition
    if isinstance(condition, dict):
        column, op, value = F.col(condition["column"]), condition["operator"], condition["value"]
        made = {"==": column == value, "=": column == value, "!=": column != value, ">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value, "in": column.isin(*value) if op == "in" else None}
        return made[op], f"{condition['column']} {op} {value}"
    return condition(rows), getattr(condition, "__name__", "custom")


def treatment_events(rows: DataFrame, conditions: list[Condition], which: str = "first", window: tuple[int, int] = (-365, 365), min_pre: int = 90, min_post: int = 90, employed_before: bool = False, id_col: str = "cf", date: str = "inizio") -> DataFrame:
    """Rows with treatment_event_date, treatment_condition_met, is_treated, days_to_event and flags of the event window.

    A person's first or last event counts ("all" times by the first); those observed less than min_pre days before it or
    min_post after it, or without a job before it if that is asked for, are controls.  Day 0 is neither pre nor post.
    """
    if which not in ("first", "last", "all"):
        raise ValueError(which)
    parts = []
    for k, c in enumerate(conditions):
        met, text = as_column(c, rows)
        parts.append(rows.where(met).select(id_col, F.col(date).alias("d"), F.lit(text).alias("why"), F.lit(k).alias("k")))
    events = parts[0]
    for p in parts[1:]:
        events = events.unionAll(p)
    pick = F.max(F.struct("d", -F.col("k"), "why")) if which == "last" else F.min(F.struct("d", "k", "why"))
    chosen = events.where("d IS NOT NULL").groupBy(id_col).agg(pick.alias("e")).select(id_col, F.col("e.d").alias("treatment_event_date"), F.col("e.why").alias("treatment_condition_met"))
    spans = rows.groupBy(id_col).agg(F.min(date).alias("first_obs"), F.max(date).alias("last_obs"))
    valid = chosen.join(spans, id_col).where((F.datediff("treatment_event_date", "first_obs") >= min_pre) & (F.datediff("last_obs", "treatment_event_date") >= min_post))
    if employed_before:
        worked = rows.select(id_col, date, "over_id").join(valid.select(id_col, "treatment_event_date"), id_col).where((F.col(date) < F.col("treatment_event_date")) & (F.col("over_id") > 0)).select(id_col).distinct()
        valid = valid.join(worked, id_col, "left_semi")
    out = rows.join(valid.select(id_col, "treatment_event_date", "treatment_condition_met"), id_col, "left")
    days = F.datediff(date, "treatment_event_date").cast("double")
    inside = lambda test: F.coalesce(test, F.lit(False))
    return out.withColumns({
        "is_treated": F.col("treatment_event_date").isNotNull(), "days_to_event": days, "in_event_window": inside(days.between(*window)),
        "pre_event_period": inside((days < 0) & (days >= window[0])), "post_event_period": inside((days > 0) & (days <= window[1])), "treatment_condition_met": F.coalesce("treatment_condition_met", F.lit(CONTROL)),
    })


def control_groups(rows: DataFrame, ratio: float = 1.0, eligible: Condition | None = None, seed: int = 17, id_col: str = "cf") -> DataFrame:
    """Persons with group_assignment and match_id: all treated, and ratio times as many controls, both numbered in hashed order."""
    treated = rows.where("is_treated").select(id_col).distinct()
    pool = rows.where(as_column(eligible, rows)[0]) if eligible is not None else rows
    controls = pool.select(id_col).distinct().join(treated, id_col, "left_anti")
    wanted = int(round(treated.count() * ratio))
    hashed = F.xxhash64(F.col(id_col), F.lit(seed))
    t = ordering.numbered(treated, hashed, id_col, "match_id").withColumn("group_assignment", F.lit("treatment"))
    c = ordering.numbered(controls, hashed, id_col, "match_id").where(F.col("match_id") <= wanted)
    c = c.withColumn("match_id", F.ceil(F.col("match_id") / max(1.0, ratio)).cast("int")).withColumn("group_assignment", F.lit("control"))
    return t.unionByName(c)


def data_quality(rows: DataFrame, variables: list[str] | None = None, id_col: str = "cf") -> DataFrame:
    """One row: rows and persons treated, their rates, gaps in the data and its completeness over `variables` (default: all columns).

    duplicate_events counts the treated rows beyond one a person; invalid_windows those in a window without a day.
    """
    known = sum(F.count(F.col(f"`{c}`")) for c in variables or rows.columns)
    treated, persons = F.count_if("is_treated"), F.count_distinct(F.when(F.col("is_treated"), F.col(id_col)))
    return rows.agg(
        F.count("*").alias("n_rows"), treated.alias("n_treated_rows"), persons.alias("n_treated_persons"), F.avg(F.col("is_treated").cast("double")).alias("treatment_rate"),
        F.try_divide(treated.cast("double"), persons).alias("events_per_person"), F.count_if(F.col("treatment_event_date").isNull()).alias("missing_event_dates"),
        F.count_if(F.col("is_treated").isNull()).alias("missing_treatment"), F.count_if(F.col("in_event_window") & F.col("days_to_event").isNull()).alias("invalid_windows"),
        (treated - persons).alias("duplicate_events"), F.try_divide(known.cast("double"), F.count("*") * len(variables or rows.columns)).alias("completeness"),
    )


def recommendations(quality: DataFrame, balance: DataFrame | None = None) -> list[str]:
    """What to mend in the events, from the row of data_quality and the balance table of event_quality; nothing for no rows."""
    q, advice = quality.first(), []
    if q.treatment_rate is not None and q.treatment_rate < 0.01:
        advice.append("Hardly anyone is treated: relax the conditions")
    if q.treatment_rate is not None and q.treatment_rate > 0.8:
        advice.append("Nearly everyone is treated: narrow the conditions")
    if balance is not None and balance.where(F.abs("std_mean_diff") > 0.25).limit(1).count():
        advice.append("Treated and controls differ widely: match or stratify")
    if q.completeness is not None and q.completeness < 0.9:
        advice.append("Many values are missing: clean or impute")
    return advice


def event_quality(rows: DataFrame, variables: list[str], id_col: str = "cf") -> dict[str, DataFrame]:
    """Counts, quantiles of event dates, standardised differences and completeness."""
    persons = rows.groupBy(id_col).agg(F.bool_or("is_treated").alias("is_treated"), F.min("treatment_event_date").alias("e"))
    counts = persons.agg(F.count("*").alias("n_persons"), F.count_if("is_treated").alias("n_treated"), F.count_if(~F.col("is_treated")).alias("n_control"))
    timing = persons.where("is_treated").agg(F.min("e").alias("first_event"), F.max("e").alias("last_event"), *[F.percentile(F.unix_date("e").cast("double"), F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])
    t, c = F.col("is_treated"), ~F.col("is_treated")
    figures = []
    for i, v in enumerate(variables):
        x = F.col(v).cast("double")
        figures += [F.avg(F.when(t, x)).alias(f"treated_mean{i}"), F.avg(F.when(c, x)).alias(f"control_mean{i}"), F.var_samp(F.when(t, x)).alias(f"tv{i}"), F.var_samp(F.when(c, x)).alias(f"cv{i}"), (F.count(x) / F.count("*")).alias(f"completeness{i}")]
    each = F.array(*[F.struct(F.lit(v).alias("variable"), *[F.col(f"{n}{i}").alias(n) for n in ("treated_mean", "control_mean", "tv", "cv", "completeness")]) for i, v in enumerate(variables)])
    table = rows.agg(*figures).select(F.explode(each).alias("v")).select("v.*")
    smd = F.try_divide(F.col("treated_mean") - F.col("control_mean"), F.sqrt((F.col("tv") + F.col("cv")) / 2))
    return {"counts": counts, "timing": timing, "balance": table.withColumn("std_mean_diff", smd).drop("tv", "cv")}
