"""Person-level matching: aggregation, coarsened exact and propensity matching, balance and diagnostics."""

from __future__ import annotations

import dataclasses
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import ordering, stats, tables


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def person_level(rows: DataFrame, variables: list[str], how: str = "first", id_col: str = "cf", date: str = "inizio") -> DataFrame:
    """One row per person: first or last non-null value, mean, median or mode (numbers: median; text: most frequent, smaller first)."""
    order = F.struct(F.col(date), F.col("fine")) if "fine" in rows.columns else F.col(date)
    made, modes = [], []
    for v in variables:
        known = F.when(F.col(v).isNotNull(), order)
        if how == "last":
            made.append(F.max_by(v, known).alias(v))
        elif how == "first" or how in ("mean", "median") and not _numeric(rows, v):
            made.append(F.min_by(v, known).alias(v))
        elif how == "mean":
            made.append(F.avg(v).alias(v))
        elif how == "median" or _numeric(rows, v):
            made.append(F.median(v).alias(v))
        else:
            modes.append(v)
    out = rows.groupBy(id_col).agg(*made, F.count("*").alias("n_rows"))
    for v in modes:
        counts = rows.where(F.col(v).isNotNull()).groupBy(id_col, v).agg(F.count("*").alias("n"))
        best = counts.groupBy(id_col).agg(F.min(F.struct(-F.col("n"), F.col(v).alias("v"))).alias("b")).select(id_col, F.col("b.v").alias(v))
        out = out.join(best, id_col, "left")
    return out


def _bin(df: DataFrame, v: str, bins: int, cuts: list[float] | None) -> Column:
    """The stratum label of a variable: right-closed bins at quantiles (or cuts), lowest included; few values stay as they are."""
    if not _numeric(df, v):
        return F.coalesce(F.col(v).cast("string"), F.lit("NA"))
    if cuts is None:
        distinct = df.select(F.col(v).cast("double").alias("x")).where("x IS NOT NULL").distinct().limit(bins + 1).count()
        if distinct <= bins:
            return F.coalesce(F.col(v).cast("string"), F.lit("NA"))
        cuts = sorted(set(ordering.quantiles(df, v, [i / bins for i in range(bins + 1)])))
    label = F.lit("NA")
    for k in range(len(cuts) - 1, 0, -1):
        above = (F.col(v) >= cuts[0]) if k == 1 else (F.col(v) > cuts[k - 1])
        label = F.when(above & (F.col(v) <= cuts[k]), F.lit(f"b{k}")).otherwise(label)
    return label


def strata(persons: DataFrame, variables: list[str], treatment: str = "is_treated", bins: int = 5, cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """persons with strata_id and the numbers of treated and control persons in it.

    Where values set the bins persons is written once: the values that are cut are the very ones that set the cuts.
    """
    if any(_numeric(persons, v) and v not in (cuts or {}) for v in variables):
        persons = tables.written(persons)
    labels = [_bin(persons, v, bins, (cuts or {}).get(v)) for v in variables]
    rows = persons.withColumn("strata_id", F.concat_ws("_|_", *labels))
    t = F.col(treatment).cast("int")
    counts = rows.groupBy("strata_id").agg(F.sum(t).alias("n_treated"), F.sum(1 - t).alias("n_control"))
    return rows.join(counts, "strata_id")


def coarsened_exact(persons: DataFrame, variables: list[str], treatment: str = "is_treated", bins: int = 5, cuts: dict[str, list[float]] | None = None, ratio: float = 1.0, mode: str = "sample", id_col: str = "cf", seed: int | None = 17) -> DataFrame:
    """Matched persons with cem_weight and cem_strata (dense rank of the stratum).

    sample keeps ratio controls a treated person (or as many treated persons as the controls allow) in each stratum, in the
    order of a seeded hash (of the id without a seed); weights keeps all, weighted to the smaller side; all keeps all at 1.
    """
    both = strata(persons, variables, treatment, bins, cuts).where("n_treated > 0 AND n_control > 0")
    t = F.col(treatment).cast("int")
    nt, nc = F.col("n_treated"), F.col("n_control")
    if mode == "weights":
        matched = both.withColumn("cem_weight", F.least(nt, nc) / F.when(t == 1, nt).otherwise(nc))
    elif mode == "all":
        matched = both.withColumn("cem_weight", F.lit(1.0))
    else:
        key = F.col(id_col) if seed is None else F.xxhash64(F.col(id_col), F.lit(seed))
        rank = F.row_number().over(Window.partitionBy("strata_id", treatment).orderBy(key, id_col))
        enough = nc >= nt * ratio
        take = F.when(t == 1, F.when(enough, nt).otherwise(F.least(nt, F.floor(nc / ratio)))).otherwise(F.when(enough, F.least(nc, F.floor(nt * ratio))).otherwise(nc))
        matched = both.withColumn("rank", rank).where(F.col("rank") <= take).drop("rank").withColumn("cem_weight", F.lit(1.0))
    numbers = both.select("strata_id").distinct().withColumn("cem_strata", F.row_number().over(Window.partitionBy().orderBy("strata_id")))
    return matched.join(numbers, "strata_id")


def l1_imbalance(persons: DataFrame, variables: list[str], treatment: str = "is_treated") -> float:
    """The mean over the variables of |standardised difference| or, for text, of the summed share differences."""
    t = F.col(treatment).cast("int") == 1
    found = []
    for v in variables:
        if _numeric(persons, v):
            r = persons.agg(F.avg(F.when(t, F.col(v))).alias("a"), F.avg(F.when(~t, F.col(v))).alias("b"), F.stddev_samp(v).alias("s")).first()
            if r.s and r.a is not None and r.b is not None:
                found.append(abs(r.a - r.b) / r.s)
        else:
            found.append(categorical_shares(persons, v, treatment).agg(F.sum(F.abs(F.col("pt") - F.col("pc")))).first()[0] or 0.0)
    return sum(found) / len(found) if found else 0.0


def categorical_shares(persons: DataFrame, v: str, treatment: str = "is_treated", weight: str | None = None) -> DataFrame:
    t = F.col(treatment).cast("int") == 1
    w = F.col(weight) if weight else F.lit(1.0)
    counts = persons.groupBy(F.col(v).alias("level")).agg(C.sum_if(t, w).alias("a"), C.sum_if(~t, w).alias("b"))
    whole = Window.partitionBy()
    return counts.select("level", C.ratio(F.col("a"), F.sum("a").over(whole)).alias("pt"), C.ratio(F.col("b"), F.sum("b").over(whole)).alias("pc"))


def _long_levels(rows: DataFrame, variables: list[str], *more: Column) -> DataFrame:
    """variable and level (as text) of each row and variable, beside other columns: one pass for all variables."""
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])
    return rows.select(*more, F.explode(each).alias("v")).select("v.*", *[c for c in rows.select(*more).columns])


def level_sets(rows: DataFrame, variables: list[str], treatment: str = "is_treated") -> DataFrame:
    """variable, level, n_treated, n_control and side: the levels of all variables, and whether both sides have them.

    Rows of side `both` are the intersection of the two sides' level sets, those of one side the differences, all of them the
    union.  Missing values are no level.
    """
    t = F.col(treatment).cast("int") == 1
    counts = _long_levels(rows, variables, t.alias("t")).where("level IS NOT NULL").groupBy("variable", "level").agg(C.count_if(F.col("t")).alias("n_treated"), C.count_if(~F.col("t")).alias("n_control"))
    side = F.when(F.col("n_control") == 0, "treated_only").when(F.col("n_treated") == 0, "control_only").otherwise("both")
    return counts.withColumn("side", side)


def level_set_sizes(sets: DataFrame) -> DataFrame:
    """One row a variable: levels in all, on either side, on both, and on one only."""
    on = lambda c: C.count_if(F.col(c) > 0)
    only = lambda s: C.count_if(F.col("side") == s)
    return sets.groupBy("variable").agg(F.count("*").alias("n_levels"), on("n_treated").alias("n_treated_levels"), on("n_control").alias("n_control_levels"), only("both").alias("n_shared"), only("treated_only").alias("n_treated_only"), only("control_only").alias("n_control_only"))


def balance(persons: DataFrame, variables: list[str], treatment: str = "is_treated", weight: str | None = None, max_diff: float = 0.1, max_ratio: float = 2.0) -> DataFrame:
    """The balance table: standardised differences and variance ratios, or the largest share difference of text variables.

    One aggregate serves all numbers and one all text variables.
    """
    t = F.col(treatment).cast("int") == 1
    empty = F.lit(None).cast("double")
    n_of = lambda side: F.sum(F.when(side, F.col(weight))) if weight else C.count_if(side).cast("double")
    numbers, texts = [v for v in variables if _numeric(persons, v)], [v for v in variables if not _numeric(persons, v)]
    figures = [n_of(t).alias("tn"), n_of(~t).alias("cn")]
    for i, v in enumerate(numbers):
        x = F.col(v).cast("double")
        for name, side in (("t", t), ("c", ~t)):
            if weight:
                w, known = F.col(weight), side & x.isNotNull()
                mean = F.sum(F.when(known, w * x)) / F.sum(F.when(known, w))
                var = F.sum(F.when(known, w * x * x)) / F.sum(F.when(known, w)) - mean * mean
            else:
                mean, var = F.avg(F.when(side, x)), F.var_samp(F.when(side, x))
            figures += [mean.alias(f"{name}m{i}"), var.alias(f"{name}v{i}")]
    one = persons.agg(*figures)
    parts = []
    if numbers:
        each = F.array(*[F.struct(F.lit(v).alias("variable"), *[F.col(f"{c}{i}").alias(c) for c in ("tm", "cm", "tv", "cv")]) for i, v in enumerate(numbers)])
        rows = one.select("tn", "cn", F.explode(each).alias("v")).select("tn", "cn", "v.*")
        smd = F.try_divide(F.col("tm") - F.col("cm"), F.sqrt((F.col("tv") + F.col("cv")) / 2))
        ratio = F.try_divide(F.col("tv"), F.col("cv"))
        concern = (F.abs(smd) > max_diff) | (ratio > max_ratio) | (ratio < 1 / max_ratio)
        parts.append(rows.select("variable", F.lit("numeric").alias("variable_type"), F.col("tm").alias("treated_mean"), F.col("cm").alias("control_mean"), (F.col("tm") - F.col("cm")).alias("mean_diff"), smd.alias("std_mean_diff"), F.col("tv").alias("treated_var"), F.col("cv").alias("control_var"), ratio.alias("var_ratio"), F.col("tn").alias("treated_n"), F.col("cn").alias("control_n"), concern.alias("balance_concern")))
    if texts:
        w = F.col(weight) if weight else F.lit(1.0)
        counts = _long_levels(persons, texts, t.alias("t"), w.alias("w")).groupBy("variable", "level").agg(C.sum_if(F.col("t"), F.col("w")).alias("a"), C.sum_if(~F.col("t"), F.col("w")).alias("b"))
        sizes = one.select("tn", "cn")
        gap = F.abs(C.ratio(F.col("a"), F.col("tn")) - C.ratio(F.col("b"), F.col("cn")))
        worst = counts.join(F.broadcast(sizes)).groupBy("variable", "tn", "cn").agg(F.max(gap).alias("d"))  # one row
        parts.append(worst.select("variable", F.lit("categorical").alias("variable_type"), *[empty.alias(c) for c in ("treated_mean", "control_mean", "mean_diff")], F.col("d").alias("std_mean_diff"), *[empty.alias(c) for c in ("treated_var", "control_var", "var_ratio")], F.col("tn").alias("treated_n"), F.col("cn").alias("control_n"), (F.col("d") > max_diff).alias("balance_concern")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def overall_balance(table: DataFrame) -> DataFrame:
    bad = F.col("balance_concern")
    return table.agg(F.count("*").alias("n_variables"), C.count_if(~bad).alias("n_balanced"), C.count_if(bad).alias("n_imbalanced"), F.avg((~bad).cast("double")).alias("prop_balanced"), F.max(F.abs("std_mean_diff")).alias("max_std_diff"), F.avg(F.abs("std_mean_diff")).alias("mean_abs_std_diff"))


def ks_statistic(persons: DataFrame, v: str, treatment: str = "is_treated") -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic with both sample sizes, from counts of distinct values summed along their order."""
    t = F.col(treatment).cast("int") == 1
    counts = tables.written(persons.where(F.col(v).isNotNull()).groupBy(F.col(v).alias("x")).agg(C.count_if(t).alias("a"), C.count_if(~t).alias("b")))
    sizes = counts.agg(F.sum("a").alias("n_treated"), F.sum("b").alias("n_control"))
    summed = ordering.running_sums(counts, "x", ["a", "b"]).join(F.broadcast(sizes))  # one row
    gap = F.abs(C.ratio(F.col("a_upto"), F.col("n_treated")) - C.ratio(F.col("b_upto"), F.col("n_control")))
    return summed.agg(F.max(gap).alias("statistic"), F.sum("a").alias("n_treated"), F.sum("b").alias("n_control"))


def ks_test(persons: DataFrame, v: str, treatment: str = "is_treated") -> tuple[float, float]:
    """The statistic and its asymptotic p-value."""
    r = ks_statistic(persons, v, treatment).first()
    return r.statistic, stats.kolmogorov_sf(r.statistic * (r.n_treated * r.n_control / (r.n_treated + r.n_control)) ** 0.5)


def missing_patterns(rows: DataFrame, variables: list[str], top: int = 10) -> DataFrame:
    """The most frequent combinations of missing variables (a top report)."""
    flags = [F.col(v).isNull().cast("int").alias(f"{v}_missing") for v in variables]
    names = [f"{v}_missing" for v in variables]
    out = rows.select(*flags).groupBy(*names).agg(F.count("*").alias("n"))
    return out.withColumn("percentage", C.share(F.col("n"))).orderBy(F.desc("n"), *names).limit(top)


def diagnose(rows: DataFrame, variables: list[str], treatment: str = "is_treated") -> DataFrame:
    """Per variable: missing, not-a-number, infinite and empty values, distinct levels, and levels on one side only; two passes for all."""
    zero = F.lit(0).cast("long")
    figures = [F.count("*").alias("n")]
    for i, v in enumerate(variables):
        x, kind = F.col(v), rows.schema[v].dataType
        floating, text = isinstance(kind, (T.DoubleType, T.FloatType)), isinstance(kind, T.StringType)
        figures += [C.count_if(x.isNull()).alias(f"n_missing{i}"), (C.count_if(F.isnan(x)) if floating else zero).alias(f"n_nan{i}"), (C.count_if(F.abs(x) == float("inf")) if floating else zero).alias(f"n_infinite{i}"), (C.count_if(x == "") if text else zero).alias(f"n_empty{i}")]
    names = ("n_missing", "n_nan", "n_infinite", "n_empty")
    each = F.array(*[F.struct(F.lit(v).alias("variable"), *[F.col(f"{c}{i}").alias(c) for c in names]) for i, v in enumerate(variables)])
    values = rows.agg(*figures).select("n", F.explode(each).alias("v")).select("v.variable", "n", *[f"v.{c}" for c in names])
    sizes = level_set_sizes(level_sets(rows, variables, treatment)).select("variable", "n_levels", (F.col("n_treated_only") + F.col("n_control_only")).alias("n_one_sided_levels"))
    return values.join(sizes, "variable", "left").na.fill(0, ["n_levels", "n_one_sided_levels"])  # a row a variable


@dataclasses.dataclass
class Match:
    """A propensity match: persons with their score, and the pairs."""

    scores: DataFrame
    pairs: DataFrame


def propensity_scores(persons: DataFrame, variables: list[str], treatment: str = "is_treated", id_col: str = "cf", carried: list[str] | None = None) -> DataFrame:
    """id, treatment, variables (and columns carried along) and propensity_score of an unpenalised logit; text variables are dummies without the last level."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    text = [v for v in variables if not _numeric(persons, v)]
    rows = persons.dropna(subset=variables).withColumn("label", F.col(treatment).cast("double"))
    stages = [StringIndexer(inputCol=v, outputCol=f"{v}__i") for v in text] + [OneHotEncoder(inputCol=f"{v}__i", outputCol=f"{v}__o") for v in text]
    stages += [VectorAssembler(inputCols=[f"{v}__o" if v in text else v for v in variables], outputCol="features"), LogisticRegression(regParam=0.0, tol=1e-10, maxIter=100)]
    scored = Pipeline(stages=stages).fit(rows).transform(rows)
    return scored.select(id_col, F.col(treatment).cast("int").alias("treated"), *[v for v in [*variables, *(carried or [])] if v != id_col], vector_to_array("probability")[1].alias("propensity_score"))


def common_support(scores: DataFrame) -> DataFrame:
    """The scores between the larger of both sides' minima and the smaller of their maxima."""
    side = lambda f, t: f(F.when(F.col("treated") == t, F.col("propensity_score")))
    ends = scores.agg(F.greatest(side(F.min, 1), side(F.min, 0)).alias("__lo"), F.least(side(F.max, 1), side(F.max, 0)).alias("__hi"))
    return scores.join(F.broadcast(ends)).where("propensity_score BETWEEN __lo AND __hi").drop("__lo", "__hi")  # one row


def _nearest_first(rows: pd.DataFrame, caliper: float) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Pairs of the sorted rows (s, treated, place, room) of one stratum, nearest first, and who stays free with someone in reach.

    Of all free pairs the one with the least (distance, places between them) is taken until none is within the caliper; only
    neighbours can be it.  Rows of the stratum that are not here can be nearer: {side}_{kind} say where the nearest of them of each
    kind stands.  A pair that one of them may prevent stays open, and so does whatever depends on its two persons.
    """
    s, kind, place, room = rows.s.to_numpy(), rows.treated.to_numpy(), rows.place.to_numpy(), rows.room.to_numpy().copy()
    n = len(s)
    outside = []  # of each kind: places and scores of the nearest rows of the other kind on either side
    for other in (1, 0):
        outside.append([(rows[f"{side}_{other}_s"].iloc[0], rows[f"{side}_{other}_place"].iloc[0]) for side in ("left", "right")])
    before, after, free, unsure = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n, [False] * n
    heap: list[tuple] = []

    def push(i: int, j: int) -> None:
        if i >= 0 and j < n and kind[i] != kind[j] and s[j] - s[i] <= caliper:
            heapq.heappush(heap, (s[j] - s[i], place[j] - place[i], place[i], i, j))

    def drop(i: int) -> None:
        free[i] = False
        if before[i] >= 0:
            after[before[i]] = after[i]
        if after[i] < n:
            before[after[i]] = before[i]
        push(before[i], after[i])

    def nearest_outside(i: int) -> tuple:
        return min((abs(s[i] - score), abs(place[i] - at)) if at == at else (math.inf, math.inf) for score, at in outside[kind[i]])

    for i in range(n - 1):
        push(i, i + 1)
    out = []
    while heap:
        d, gap, _, i, j = heapq.heappop(heap)
        if not (free[i] and free[j]) or after[i] != j:
            continue
        if unsure[i] or unsure[j] or (d, gap) >= min(nearest_outside(i), nearest_outside(j)):
            unsure[i] = unsure[j] = True
            continue
        t, c = (i, j) if kind[i] else (j, i)
        out.append((t, c, d))
        room[t] -= 1
        drop(c)
        if not room[t]:
            drop(t)
    rows["room"] = room
    left = np.array(free, bool)
    for k in (0, 1):
        others = s[left & (kind != k)]
        own = np.flatnonzero(left & (kind == k))
        at = np.searchsorted(others, s[own])
        near = np.full(len(own), np.inf)
        if len(others):
            near = np.minimum(np.abs(s[own] - others[np.maximum(at - 1, 0)]), np.abs(others[np.minimum(at, len(others) - 1)] - s[own]))
        for score, place_of in outside[k]:
            if place_of == place_of:
                near = np.minimum(near, np.abs(s[own] - score))
        left[own[near > caliper]] = False
    return out, left


def _block_solver(caliper: float, columns: list[str]):
    def solve(block: pd.DataFrame) -> pd.DataFrame:
        """Pairs (pair 1) and who is still free (pair 0) of a block."""
        parts = []
        for _, rows in block.sort_values("place", kind="stable").groupby("code", sort=False):
            rows = rows.reset_index(drop=True)
            pairs, free = _nearest_first(rows, caliper)
            rest = rows.loc[free, columns]
            parts.append(rest.assign(mate=rest.id, distance=0.0, pair=0))
            if pairs:
                t, c, d = (list(x) for x in zip(*pairs, strict=True))
                parts.append(rows.loc[t, columns].assign(mate=rows.id.to_numpy()[c], distance=d, pair=1))
        return pd.concat(parts)

    return solve


#: Persons that are matched in one task; results do not depend on it.
BLOCK = 20_000


def _with_outside(cut: DataFrame) -> DataFrame:
    """Adds to each row of a block where the nearest rows of its stratum in the blocks before and after it stand, by kind."""
    at = lambda kind, f: f(F.when(F.col("treated") == kind, F.struct("place", "s")))
    ends = cut.groupBy("code", "block").agg(*[at(k, f).alias(f"{side}_{k}") for side, f in (("left", F.max), ("right", F.min)) for k in (0, 1)])
    order = Window.partitionBy("code").orderBy("block")  # a row a block
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    known = [(F.last if side == "left" else F.first)(f"{side}_{k}", ignorenulls=True).over(earlier if side == "left" else later).alias(f"{side}_{k}") for side in ("left", "right") for k in (0, 1)]
    flat = ends.select("code", "block", *known).select("code", "block", *[F.col(f"{side}_{k}.{x}").cast("double").alias(f"{side}_{k}_{x}") for side in ("left", "right") for k in (0, 1) for x in ("s", "place")])
    return cut.join(flat, ["code", "block"])


def _pairs_nearest_first(flat: DataFrame, keys: list[str], caliper: float, ratio: int) -> DataFrame:
    """treated_id, control_id, distance: pairs within strata, nearest first, each control once and each treated person up to ratio times.

    All persons stand in one order (stratum, score, id) and are cut into blocks of BLOCK; a block takes the pairs that nobody
    outside it can prevent.  Who is left free is numbered and cut anew, half a block further, until two turns add no pair: the
    nearest pair of all stands inside a block in one of them, so then none is left.  Persons with nobody of the other kind in reach leave early.
    """
    code = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    rows = flat.select(code.alias("code"), "id", "s", F.col("treated").cast("int").alias("treated"), F.when(F.col("treated") == 1, ratio).otherwise(1).cast("int").alias("room"), F.lit(1).cast("long").alias("one"))
    left = tables.written(ordering.running_sums(rows, "code", ["one"], ties=["s", "id"]).withColumnRenamed("one_upto", "place"))
    columns = left.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema) + f", mate {left.schema['id'].dataType.simpleString()}, distance double, pair int"
    solver, found, idle, turn = _block_solver(caliper, columns), [], 0, 0
    while idle < 2:
        total = left.count()
        cut = ordering.running_sums(left, "place", ["one"]) if total > BLOCK else left.withColumn("one_upto", F.lit(1).cast("long"))
        shift = turn % 2 * (BLOCK // 2)
        blocks = tables.written(cut.withColumn("block", F.floor((F.col("one_upto") - 1 + shift) / BLOCK)))
        solved = tables.written(_with_outside(blocks).groupBy("block").applyInPandas(solver, schema))
        pairs = solved.where("pair = 1").select(F.col("id").alias("treated_id"), F.col("mate").alias("control_id"), "distance")
        some = pairs.limit(1).count()
        if some:
            found.append(pairs)
        if total <= BLOCK:  # nobody was outside
            break
        idle, turn = 0 if some else idle + 1, turn + 1
        left = solved.where("pair = 0").select(*columns)
    out = found[0] if found else flat.where("false").select(F.col("id").alias("treated_id"), F.col("id").alias("control_id"), F.lit(0.0).alias("distance"))
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _pairs_with_replacement(flat: DataFrame, keys: list[str], caliper: float) -> DataFrame:
    """Each treated person with the nearest control, which may serve again; of two as near the lower score, then the smaller id."""
    controls = flat.where("treated = 0").groupBy(*keys, "s").agg(F.min("id").alias("mate"))
    treated = flat.where("treated = 1").withColumn("at", F.col("s"))
    below = ordering.as_of(treated, controls.withColumns({"at": F.col("s"), "low": F.struct("s", "mate")}), keys, "at", ["low"])
    both = ordering.as_of(below.withColumn("at", -F.col("s")), controls.withColumns({"at": -F.col("s"), "high": F.struct("s", "mate")}), keys, "at", ["high"])
    low, high = F.col("s") - F.col("low.s"), F.col("high.s") - F.col("s")
    take_low = F.col("high").isNull() | (low <= high)
    mate = F.when(take_low, F.col("low.mate")).otherwise(F.col("high.mate"))
    return both.select(F.col("id").alias("treated_id"), mate.alias("control_id"), F.when(take_low, low).otherwise(high).alias("distance")).where(F.col("control_id").isNotNull() & (F.col("distance") <= caliper))


def propensity_match(persons: DataFrame, variables: list[str], treatment: str = "is_treated", id_col: str = "cf", caliper: float | None = 0.2, ratio: int = 1, exact: list[str] | None = None, replace: bool = False, missing: str = "complete_cases", trim: bool = False) -> Match:
    """Nearest-neighbour matching inside exact strata; the caliper is in standard deviations of the score.

    The nearest pairs go first, of as near ones those with fewer persons between them in the order of score and id; so the pairs do not depend on how the
    work is cut, and no person is matched farther than a free neighbour.  With ratio a treated person takes so many controls; with replace
    controls serve again and a treated person has one pair.  missing is complete_cases, mean_impute or missing_indicator; trim
    keeps the scores in common support only.
    """
    rows = persons
    if missing == "mean_impute":
        rows = impute(persons, variables, "mean")
    elif missing == "missing_indicator":
        flags = {f"{v}_missing": F.col(v).isNull().cast("double") for v in variables}
        rows = impute(persons.withColumns(flags), variables, "mean")
        variables = [*variables, *flags]
    elif missing != "complete_cases":
        raise ValueError(missing)
    scores = propensity_scores(rows, variables, treatment, id_col, [e for e in exact or [] if e not in variables])
    scores = tables.written(common_support(scores) if trim else scores)
    width = scores.agg(F.stddev_samp("propensity_score")).first()[0]
    flat = scores.select(*[F.col(e).alias(f"e{i}") for i, e in enumerate(exact or [])], F.col(id_col).alias("id"), F.col("propensity_score").alias("s"), "treated")
    keys, reach = [f"e{i}" for i in range(len(exact or []))], math.inf if caliper is None else caliper * (width or 0.0)
    return Match(scores, _pairs_with_replacement(flat, keys, reach) if replace else _pairs_nearest_first(flat, keys, reach, ratio))


def match_quality(total_treated: int, total_control: int, matched_treated: int, matched_control: int, treated_in_support_pct: float | None = None, control_in_support_pct: float | None = None, balanced: bool | None = None) -> dict:
    """Retention, utilisation, the quality score (.3/.2/.3/.2) with its rating, and recommendations."""
    retention, use = matched_treated / total_treated, matched_control / total_control
    support = 0.5 if treated_in_support_pct is None else (treated_in_support_pct + control_in_support_pct) / 200
    score = 0.3 * min(1, retention) + 0.2 * min(1, use) + 0.3 * support + 0.2 * (0.5 if balanced is None else float(balanced))
    rating = "Excellent" if score >= 0.8 else "Good" if score >= 0.6 else "Fair" if score >= 0.4 else "Poor"
    advice = []
    if retention < 0.8:
        advice.append("Few treated persons are kept: relax the matching criteria")
    if use > 0.9:
        advice.append("Nearly all controls are used: the pool may be too small")
    if treated_in_support_pct is not None and treated_in_support_pct < 80:
        advice.append("Limited common support for treated persons")
    return {"treatment_retention_rate": retention, "control_utilization_rate": use, "effective_sample_size": matched_treated + matched_control, "quality_score": score, "rating": rating, "recommendations": advice}


def impute(rows: DataFrame, variables: list[str], how: str = "median") -> DataFrame:
    """Missing values filled: numbers with their median or mean, text with its mode (the smaller of equals); complete drops the rows instead."""
    if how == "complete":
        return rows.dropna(subset=variables)
    numbers = [v for v in variables if _numeric(rows, v)]
    out = rows
    if numbers:
        if how == "median":
            medians = {r.variable: r.quantiles[0] for r in ordering.exact_quantiles(rows, numbers, [0.5]).collect()}  # a row a variable
        else:
            medians = rows.agg(*[F.avg(v).alias(v) for v in numbers]).first().asDict()
        out = out.withColumns({v: F.coalesce(F.col(v).cast("double"), F.lit(medians.get(v)).cast("double")) for v in numbers})
    for v in variables:
        if not _numeric(rows, v):
            best = rows.where(F.col(v).isNotNull()).groupBy(v).agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), F.col(v).alias("v")))["v"].alias("__m"))
            out = out.join(F.broadcast(best)).withColumn(v, F.coalesce(F.col(v), F.col("__m"))).drop("__m")  # one row
    return out.select(*rows.columns)


def missing_correlation(rows: DataFrame, variables: list[str]) -> DataFrame:
    """The correlation of each pair of missingness flags; null where a flag never varies."""
    flag = {v: F.col(v).isNull().cast("double") for v in variables}
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1 :]]
    one = rows.agg(*[F.corr(flag[a], flag[b]).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def love_plot(before: DataFrame, after: DataFrame) -> DataFrame:
    """Absolute standardised differences of two balance tables, one under the other."""
    part = lambda t, name: t.select("variable", F.abs("std_mean_diff").alias("abs_std_diff"), F.lit(name).alias("sample"))
    return part(before, "before").unionByName(part(after, "after"))
