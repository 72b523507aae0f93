"""Kaplan-Meier survival of contracts, its medians and lookups, and the log-rank family of tests."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ordering, stats

Z95 = 1.959963984540054
_EPS = 1e-9


def with_durations(contracts: DataFrame, start: str = "inizio", end: str = "fine") -> DataFrame:
    """Adds duration = survival_time (days, both ends count) and censored: 1 where the end is the last of all."""
    last = contracts.agg(F.max(end).alias("__last"))
    out = contracts.join(F.broadcast(last))  # one row
    days = (F.datediff(end, start) + 1).cast("int")
    return out.withColumns({"duration": days, "survival_time": days, "censored": (F.col(end) == F.col("__last")).cast("int")}).drop("__last")


def kaplan_meier(rows: DataFrame, group: str = "contract_type", time: str = "survival_time", censored: str = "censored") -> DataFrame:
    """The survival table of each group: time, n_risk, n_event, survival_prob, std_error (of log S) and log-log 95% bounds.

    Rows are first counted by group and time, so the windows run over distinct times only.
    """
    counts = rows.where(F.col(time).isNotNull()).groupBy(group, F.col(time).alias("time")).agg(F.count("*").alias("m"), F.sum((F.col(censored) == 0).cast("int")).alias("n_event"))
    up = Window.partitionBy(group).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(group).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("n_event"), F.col("n_risk")
    at_risk = counts.withColumn("n_risk", F.sum("m").over(down))
    gone = F.max((d == n).cast("int")).over(up) == 1
    log_s = F.sum(F.when(d < n, F.ln(1 - d / n)).otherwise(0.0)).over(up)
    variance = F.sum(F.when(d < n, d / (n * (n - d).cast("double"))).otherwise(0.0)).over(up)
    table = at_risk.select(group, "time", "n_risk", "n_event", F.when(gone, 0.0).otherwise(F.exp(log_s)).alias("survival_prob"), F.when(~gone, F.sqrt(variance)).alias("std_error"))
    s, inner = F.col("survival_prob"), (F.col("survival_prob") > 0) & (F.col("survival_prob") < 1)
    bound = lambda sign: F.when(inner, F.pow(s, F.exp(sign * Z95 * F.col("std_error") / F.ln(s))))
    return table.withColumns({"lower_ci": bound(F.lit(-1.0)), "upper_ci": bound(F.lit(1.0))})


def median_survival(table: DataFrame, group: str = "contract_type") -> DataFrame:
    """The first time with S at most 1/2 (halfway to the next event time where S is 1/2), and where the bounds cross it."""
    half = F.lit(0.5)
    events = table.where("n_event > 0").withColumn("next_time", F.lead("time").over(Window.partitionBy(group).orderBy("time")))
    s = F.col("survival_prob")
    first = lambda x: F.min(F.when(F.col(x) <= half + _EPS, F.col("time")))
    found = events.groupBy(group).agg(
        F.min(F.when(s <= half + _EPS, F.struct("time", "survival_prob", "next_time"))).alias("m"), first("lower_ci").alias("median_ci_lower"), first("upper_ci").alias("median_ci_upper")
    )
    plateau = (F.abs(F.col("m.survival_prob") - half) <= _EPS) & F.col("m.next_time").isNotNull()
    median = F.when(plateau, (F.col("m.time") + F.col("m.next_time")) / 2).otherwise(F.col("m.time").cast("double"))
    groups = table.select(group).distinct()
    return groups.join(found, group, "left").select(group, median.alias("median_survival"), F.col("median_ci_lower").cast("double").alias("median_ci_lower"), F.col("median_ci_upper").cast("double").alias("median_ci_upper"))


def _wanted(table: DataFrame, grid: DataFrame, group: str) -> DataFrame:
    return table.select(group).distinct().join(grid.select("time"))  # groups x a short grid


def survival_at(table: DataFrame, grid: DataFrame, group: str = "contract_type") -> DataFrame:
    """S at each time of grid(time): the step before or at it, 1 before the first."""
    met = ordering.as_of(_wanted(table, grid, group), table, [group], "time", ["survival_prob"])
    return met.select(group, "time", F.coalesce("survival_prob", F.lit(1.0)).alias("survival_prob"))


def survival_as_of(rows: DataFrame, table: DataFrame, time: str = "survival_time", group: str = "contract_type") -> DataFrame:
    """rows with survival_prob, S of their group at a time that need not be one of the table's: 1 before its first step, null for a null time or a group without a table.

    No group meets its table pair by pair: both stand in one order (ordering.as_of).
    """
    known = table.select(group, F.col("time").cast("double").alias(time), "survival_prob")
    first = table.select(group).distinct().select(group, F.lit(float("-inf")).alias(time), F.lit(1.0).alias("survival_prob"))
    return ordering.as_of(rows.drop("survival_prob"), first.unionByName(known), [group], time, ["survival_prob"])


def risk_table(table: DataFrame, grid: DataFrame, group: str = "contract_type") -> DataFrame:
    """Numbers at risk at each time of grid(time): those of the last row not after it."""
    return ordering.as_of(_wanted(table, grid, group), table, [group], "time", ["n_risk"]).select(group, "time", "n_risk")


def add_survival(rows: DataFrame, group: str = "contract_type") -> DataFrame:
    """Rows with durations, their group's median and bounds, and S at their own duration."""
    timed = with_durations(rows)
    table = kaplan_meier(timed, group)
    medians = median_survival(table, group).withColumnRenamed("median_survival", "contract_type_median")
    own = table.select(group, F.col("time").alias("survival_time"), "survival_prob")
    return timed.join(medians, group, "left").join(own, [group, "survival_time"], "left")


def logrank_components(rows: DataFrame, rho: float = 0.0, group: str = "contract_type") -> DataFrame:
    """Observed and expected weighted events of each group (weights S(t-)^rho of the pooled curve)."""
    times, per_group = _event_times(rows, rho, group)
    met = per_group.join(times, "time")
    w = F.col("w")
    return met.groupBy(group).agg(F.sum(w * F.col("d_g")).alias("observed"), F.sum(w * F.col("d") * F.col("n_g") / F.col("n")).alias("expected"))


def _event_times(rows: DataFrame, rho: float, group: str) -> tuple[DataFrame, DataFrame]:
    """Event times with pooled n and d and weight w; and of each group its numbers at risk and events at each of them.

    The groups' counts are united with zeros at the event times, and one window a group sums them from the end.
    """
    pooled = kaplan_meier(rows.withColumn("__all", F.lit("all")), "__all").select("time", F.col("n_risk").alias("n"), F.col("n_event").alias("d"), "survival_prob")
    before = F.coalesce(F.lag("survival_prob").over(Window.partitionBy().orderBy("time")), F.lit(1.0))  # distinct days only
    times = pooled.withColumn("w", F.pow(before, F.lit(float(rho)))).where("d > 0").select("time", "n", "d", "w")
    own = rows.where(F.col("survival_time").isNotNull()).groupBy(group, F.col("survival_time").alias("time")).agg(F.count("*").alias("m"), F.sum((F.col("censored") == 0).cast("int")).alias("n_event"))
    zero = F.lit(0).cast("long")
    grid = times.select("time").join(own.select(group).distinct()).select(group, "time", zero.alias("m"), zero.alias("n_event"))  # groups x event days
    counts = own.unionByName(grid).groupBy(group, "time").agg(F.sum("m").alias("m"), F.sum("n_event").alias("d_g"))
    down = Window.partitionBy(group).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    per_group = counts.withColumn("n_g", F.sum("m").over(down)).join(times.select("time"), "time", "left_semi").select(group, "time", "n_g", "d_g")
    return times, per_group


@dataclasses.dataclass
class LogRank:
    """A test of equal survival."""

    rho: float
    chi_square: float
    df: int
    p_value: float


def logrank_test(rows: DataFrame, rho: float = 0.0, group: str = "contract_type") -> LogRank:
    """Log-rank (rho 0) or Peto-Peto (rho 1) test; only the group x group sums come to the driver."""
    times, per_group = _event_times(rows, rho, group)
    met = per_group.join(times, "time")
    w, n, d, n_g = (F.col(c) for c in ("w", "n", "d", "n_g"))
    gap = met.groupBy(group).agg(F.sum(w * (F.col("d_g") - d * n_g / n)).alias("u")).orderBy(group).collect()
    factor = F.when(n > 1, w * w * d * (n - d) / (n - 1)).otherwise(0.0)
    a, b = met.alias("a"), per_group.alias("b")
    pair = a.join(b, F.col("a.time") == F.col("b.time"))
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")).cast("int")
    cov = pair.groupBy(F.col(f"a.{group}").alias("g"), F.col(f"b.{group}").alias("h")).agg(F.sum(factor * (F.col("a.n_g") / n) * (same - F.col("b.n_g") / n)).alias("v")).collect()
    names = [r[group] for r in gap]
    k = len(names) - 1
    if k < 1:
        return LogRank(rho, 0.0, 0, 1.0)
    u = np.array([r.u for r in gap])[:k]
    v = {(r.g, r.h): r.v for r in cov}
    m = np.array([[v[g, h] for h in names[:k]] for g in names[:k]])
    chi = float(u @ np.linalg.pinv(m) @ u)
    return LogRank(rho, chi, k, stats.chi2_sf(chi, k))


def pairwise_components(rows: DataFrame, group: str = "contract_type") -> DataFrame:
    """group_a, group_b and the log-rank figures of each pair of groups on the pooled curve of both: observed and expected events of a, variance, chi-square.

    One plan for all pairs: counts by group and time go to every pair of their group, numbers at risk are summed from the end of each
    pair's times, and one aggregate gives the figures.  Pairs that are never at risk together have no chi-square.
    """
    counts = rows.where(F.col("survival_time").isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("own"), F.col("survival_time").alias("time")).agg(F.count("*").alias("m"), C.count_if(F.col("censored") == 0).alias("e"))
    others = counts.select(F.col("own").alias("other")).distinct()  # a vocabulary
    met = counts.join(others, F.col("own") != F.col("other"))
    is_a = F.col("own") < F.col("other")
    side = lambda c, yes: F.sum(F.when(is_a == yes, F.col(c)).otherwise(0))
    pairs = met.groupBy(F.least("own", "other").alias("group_a"), F.greatest("own", "other").alias("group_b"), "time").agg(side("m", True).alias("ma"), side("m", False).alias("mb"), side("e", True).alias("ea"), F.sum("e").alias("d"))
    down = Window.partitionBy("group_a", "group_b").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)  # distinct days
    risk = pairs.withColumns({"na": F.sum("ma").over(down), "n": F.sum(F.col("ma") + F.col("mb")).over(down)}).where("d > 0")
    d, n, p = F.col("d"), F.col("n"), F.col("na") / F.col("n")
    out = risk.groupBy("group_a", "group_b").agg(F.sum("ea").alias("observed"), F.sum(d * p).alias("expected"), F.sum(F.when(n > 1, d * p * (1 - p) * (n - d) / (n - 1)).otherwise(0.0)).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    return out.withColumn("chi_square", F.try_divide(gap * gap, F.when(F.col("variance") > 0, F.col("variance"))))


def pairwise_logrank(rows: DataFrame, group: str = "contract_type") -> list[tuple[str, str, float]]:
    """p-values of each pair of groups, if there are more than two."""
    found = sorted((r.group_a, r.group_b, r.chi_square) for r in pairwise_components(rows, group).collect())  # a row a pair
    if len({g for r in found for g in r[:2]}) <= 2:
        return []
    return [(a, b, stats.chi2_sf(x or 0.0, 1)) for a, b, x in found]


def comparison_groups(medians: DataFrame, most: int = 10, group: str = "contract_type") -> DataFrame:
    """Up to `most` groups, evenly spaced over the order of their medians."""
    order = Window.partitionBy().orderBy(F.asc_nulls_last("median_survival"), group)  # groups are few
    ranked = medians.withColumns({"r": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy())})
    step = F.greatest(F.lit(1.0), (F.col("n") - 1) / F.lit(float(max(1, most - 1))))
    slot = F.floor((F.col("r") - 1) / step)
    kept = ranked.withColumn("slot", slot).withColumn("k", F.row_number().over(Window.partitionBy("slot").orderBy("r"))).where("k = 1 OR r = n")
    return kept.select(group, "median_survival", "median_ci_lower", "median_ci_upper")


def forest_data(medians: DataFrame, overall: float | None = None, group: str = "contract_type") -> DataFrame:
    """Rows of a forest chart: medians with their interval, whether it is valid, the place by falling median, and the overall median.

    An interval is valid if both ends are known and hold the median; without `overall` it is the mean of the medians.
    """
    whole = Window.partitionBy()  # groups are few
    low, high, m = F.col("median_ci_lower"), F.col("median_ci_upper"), F.col("median_survival")
    valid = F.coalesce((low <= m) & (m <= high), F.lit(False))
    centre = F.lit(float(overall)) if overall is not None else F.avg("median_survival").over(whole)
    place = F.row_number().over(whole.orderBy(F.desc_nulls_last("median_survival"), group))
    return medians.where(m.isNotNull()).select(group, "median_survival", "median_ci_lower", "median_ci_upper", valid.alias("ci_valid"), place.alias("place"), centre.alias("overall_median"))


def curve_frames(table: DataFrame, frames: int = 20, group: str = "contract_type") -> DataFrame:
    """The frames of an animated survival chart: in frame k each curve up to k / frames of the longest time."""
    last = table.agg(F.max("time").alias("__last"))
    number = F.explode(F.sequence(F.lit(1), F.lit(frames)))
    rows = table.select(group, "time", "survival_prob").join(F.broadcast(last)).withColumn("frame", number)  # one row
    return rows.where(F.col("time") <= F.col("__last") * F.col("frame") / frames).drop("__last")
