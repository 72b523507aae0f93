"""Transitions between jobs over spells of unemployment: edge lists, matrices and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import ordering, tables
from . import network


def transition_rows(segments: DataFrame, variable: str = C.CONTRACT, chain: str = "last", min_days: int = 1, max_days: int | None = None, statistics: tuple[str, ...] = ()) -> DataFrame:
    """One row per unemployment segment between two employment segments of a person with more than two segments.

    from and to are the chain values before and after; each statistic comes with its value and days on both sides.
    """
    order, person = C.by_person(), Window.partitionBy("cf")
    both = {"prev_arco": F.lag("arco").over(order), "next_arco": F.lead("arco").over(order), "from": F.lag(variable).over(order), "to": F.lead(variable).over(order), "n": F.count("*").over(person)}
    both |= {"from_days": F.lag("durata").over(order), "to_days": F.lead("durata").over(order)}
    for s in statistics:
        both |= {f"{s}_from": F.lag(s).over(order), f"{s}_to": F.lead(s).over(order)}
    rows = segments.withColumns(both).where("n > 2 AND arco = 0 AND prev_arco >= 1 AND next_arco >= 1").where(F.col("durata") >= min_days)
    if max_days is not None:
        rows = rows.where(F.col("durata") <= max_days)
    ends = rows.withColumns({"from": C.chain_value(F.col("from"), chain), "to": C.chain_value(F.col("to"), chain)})
    sides = [f"{s}_{side}" for s in statistics for side in ("from", "to")]
    return ends.where("`from` IS NOT NULL AND `to` IS NOT NULL").select("cf", "inizio", "from", "to", "durata", "from_days", "to_days", *sides)


def mode_of(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, the smaller of equals; nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counts.withColumn("r", first).where("r = 1").select(*keys, F.col(value).alias(name))


def transitions(segments: DataFrame, variable: str = C.CONTRACT, chain: str = "last", min_days: int = 1, max_days: int | None = None, statistics: tuple[str, ...] = ()) -> DataFrame:
    """from, to, weight and transition_duration (mean days), then of each statistic its median weighted by days, or its mode.

    Numeric statistics give {s}_from_median and {s}_to_median, others {s}_from_mode and {s}_to_mode.
    """
    rows = transition_rows(segments, variable, chain, min_days, max_days, statistics)
    aggregates = [F.count("*").alias("weight"), F.avg("durata").alias("transition_duration")]
    modes, medians = [], {}
    for s in statistics:
        numeric = isinstance(segments.schema[s].dataType, T.NumericType)
        for side in ("from", "to"):
            if numeric:
                medians[f"{s}_{side}"] = F.greatest(F.lit(1), F.round(F.col(f"{side}_days"))).cast("long")
            else:
                modes.append((f"{s}_{side}", f"{s}_{side}_mode"))
    if medians:
        rows = tables.written(rows)
    out = rows.groupBy("from", "to").agg(*aggregates)
    if medians:
        found = ordering.exact_quantiles(rows, list(medians), [0.5], ["from", "to"], medians)
        wide = found.groupBy("from", "to").agg(*[F.max(F.when(F.col("variable") == v, F.col("quantiles")[0])).alias(f"{v}_median") for v in medians])
        out = out.join(wide, ["from", "to"], "left")
    for value, name in modes:
        out = out.join(mode_of(rows, ["from", "to"], value, name), ["from", "to"], "left")
    return out


def transition_matrix(edges: DataFrame, normalize: str = "none") -> DataFrame:
    """The full grid of states as from, to, value; normalised by row, column or total.  States are few: they are the vocabulary."""
    states = edges.select(F.col("from").alias("s")).union(edges.select("to")).distinct()
    grid = states.select(F.col("s").alias("from")).join(states.select(F.col("s").alias("to")))  # contract types only
    value = F.coalesce(F.col("weight"), F.lit(0)).cast("double")
    long = grid.join(edges.select("from", "to", "weight"), ["from", "to"], "left").select("from", "to", value.alias("value"))
    if normalize == "none":
        return long
    keys = {"row": ["from"], "column": ["to"], "total": []}[normalize]
    return long.withColumn("value", C.ratio(F.col("value"), F.sum("value").over(Window.partitionBy(*keys))))


def pivoted(matrix: DataFrame) -> DataFrame:
    """A wide matrix: a row for each from state, a column for each to state."""
    return matrix.groupBy("from").pivot("to").agg(F.first("value")).na.fill(0.0).orderBy("from")


def matrix_statistics(edges: DataFrame, name: str = "raw") -> DataFrame:
    """The thirteen statistics of a matrix as matrix_type, metric, value; the edges are read once."""
    loop = F.col("from") == F.col("to")
    one = edges.agg(
        F.size(F.array_union(F.collect_set("from"), F.collect_set("to"))).cast("long").alias("n_states"),  # a vocabulary
        F.coalesce(F.sum("weight"), F.lit(0)).alias("total"),
        F.count("*").alias("nonzero"),
        C.sum_if(loop, "weight").alias("loops"),
        F.size(F.collect_set("from")).alias("active_from"),
        F.size(F.collect_set("to")).alias("active_to"),
        F.coalesce(F.avg("weight"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.median("weight"), F.lit(0.0)).alias("median"),
        F.coalesce(F.max("weight"), F.lit(0)).alias("max"),
    )
    possible = F.col("n_states") * F.col("n_states")
    density = C.ratio(F.col("nonzero"), possible)
    values = {
        "n_states": F.col("n_states"), "total_transitions": F.col("total"), "n_nonzero_cells": F.col("nonzero"), "n_possible_cells": possible,
        "sparsity": F.round(1 - density, 4), "density": F.round(density, 4), "n_self_transitions": F.col("loops"),
        "pct_self_transitions": F.round(C.ratio(F.col("loops"), F.col("total")), 4), "active_from_states": F.col("active_from"), "active_to_states": F.col("active_to"),
        "mean_transition_weight": F.round("mean", 2), "median_transition_weight": F.round("median", 2), "max_transition_weight": F.col("max"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])).alias("m")).select(F.lit(name).alias("matrix_type"), "m.metric", "m.value")


COMPARED = ("n_states", "total_transitions", "sparsity", "n_self_transitions", "pct_self_transitions", "density", "n_nonzero_cells")


def compare_matrices(raw: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Seven metrics of raw and consolidated edges, with the improvement, its percentage and a reading."""
    a = matrix_statistics(raw).select("metric", F.col("value").alias("raw_value"))
    b = matrix_statistics(consolidated).select("metric", F.col("value").alias("consolidated_value"))
    gain = F.when(F.col("metric") == "density", F.col("consolidated_value") - F.col("raw_value")).otherwise(F.col("raw_value") - F.col("consolidated_value"))
    out = a.join(b, "metric").where(F.col("metric").isin(*COMPARED)).withColumn("improvement", F.round(gain, 6))
    reading = (
        F.when((F.col("metric") == "sparsity") & (F.col("improvement") > 0), "Reduced sparsity")
        .when((F.col("metric") == "n_self_transitions") & (F.col("improvement") > 0), "Eliminated administrative self-transitions")
        .when((F.col("metric") == "pct_self_transitions") & (F.col("improvement") > 0), "Reduced self-transition rate")
        .when((F.col("metric") == "density") & (F.col("improvement") > 0), "Increased matrix density")
        .when((F.col("metric") == "n_states") & (F.col("improvement") > 0), "Simplified")
        .when((F.col("metric") == "n_states") & (F.col("improvement") < 0), "Added states")
        .when(F.col("improvement") == 0, "No change")
        .otherwise("Other change")
    )
    return out.withColumn("improvement_pct", F.round(100 * F.col("improvement") / F.greatest(F.col("raw_value"), F.lit(1e-10)), 1)).withColumn("interpretation", reading)


def consolidation_impact_matrix(raw: DataFrame, consolidated: DataFrame) -> DataFrame:
    """What consolidation does to the matrix, as impact_metric, value."""
    a = matrix_statistics(raw).groupBy().pivot("metric", ["total_transitions", "n_self_transitions", "sparsity"]).agg(F.first("value"))
    b = matrix_statistics(consolidated).groupBy().pivot("metric", ["total_transitions", "n_self_transitions", "sparsity"]).agg(F.first("value"))
    one = a.toDF("t0", "s0", "z0").join(b.toDF("t1", "s1", "z1"))  # two single rows
    noise = F.col("s0") - F.col("s1")
    values = {
        "transitions_consolidated": F.col("t0") - F.col("t1"), "administrative_noise_removed": noise,
        "transition_reduction_pct": F.round(100 * C.ratio(F.col("t0") - F.col("t1"), F.col("t0")), 1),
        "self_transition_reduction_pct": F.round(100 * C.ratio(noise, F.col("s0")), 1),
        "sparsity_improvement": F.round(F.col("z0") - F.col("z1"), 4),
        "matrix_efficiency_gain": F.round(noise / F.greatest(F.col("t0"), F.lit(1.0)), 4),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("impact_metric"), v.alias("value")) for k, v in values.items()])).alias("m")).select("m.*")


def person_consolidation_impact(segments: DataFrame) -> DataFrame:
    """Per person: segments, distinct over_id, ratio, reduction and the impact score."""
    out = segments.groupBy("cf").agg(F.count("*").alias("original_segments"), F.count_distinct("over_id").alias("consolidated_periods"), F.avg(F.when(F.col("arco") >= 1, F.col("arco"))).alias("avg_arco"), C.sum_if(F.col("arco") >= 1, "durata").alias("days"))
    kept = 1 - F.col("consolidated_periods") / F.col("original_segments")
    score = F.when(F.col("avg_arco").isNull(), kept).otherwise(kept * (1 + F.log10(1 + F.col("avg_arco"))) * F.log10(1 + F.col("days")))
    return out.select("cf", "original_segments", "consolidated_periods", F.round(kept, 4).alias("consolidation_ratio"), (F.col("original_segments") - F.col("consolidated_periods")).alias("complexity_reduction"), F.round(score, 4).alias("impact_score"))


def transitions_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Weights of edges for each period or group."""
    return rows.groupBy(*keys, "from", "to").agg(F.count("*").alias("weight"), F.avg("durata").alias("transition_duration"))


def matrix_labels(matrix: DataFrame, min_weight: float = 1.0) -> DataFrame:
    """The grid of a matrix with its share of all, values under min_weight left out, and a label."""
    shown = F.when(F.col("value") >= min_weight, F.col("value"))
    percentage = C.share(F.col("value"))
    out = matrix.withColumns({"percentage": percentage, "value": shown})
    return out.withColumn("label", F.when(F.col("value").isNotNull(), F.format_string("%d (%.1f%%)", F.col("value").cast("long"), F.col("percentage"))))


def transition_summary(edges: DataFrame) -> DataFrame:
    """One row: transitions, states, transitions a state, and the mean gap weighted by transitions."""
    states = edges.select(F.col("from").alias("s")).union(edges.select("to")).distinct().agg(F.count("*").alias("n_states"))
    sums = edges.agg(F.sum("weight").alias("total_transitions"), (F.sum(F.col("weight") * F.col("transition_duration")) / F.sum("weight")).alias("mean_gap"))
    return sums.join(states).withColumn("per_state", C.ratio(F.col("total_transitions"), F.col("n_states")))  # single rows


def consolidation_benefits(raw: DataFrame, consolidated: DataFrame) -> DataFrame:
    """One row: edges, weights and states before and after consolidation, and by how many percent they shrink."""
    def sizes(e: DataFrame, name: str) -> DataFrame:
        states = e.select(F.col("from").alias("s")).union(e.select("to")).distinct().agg(F.count("*").alias(f"{name}_states"))
        return e.agg(F.count("*").alias(f"{name}_edges"), F.sum("weight").alias(f"{name}_weight")).join(states)  # single rows

    both = sizes(raw, "raw").join(sizes(consolidated, "consolidated"))  # single rows
    cut = lambda c: F.round(100 * (1 - C.ratio(F.col(f"consolidated_{c}"), F.col(f"raw_{c}"))), 1)
    return both.withColumns({f"{c}_reduction_pct": cut(c) for c in ("edges", "weight", "states")})


def node_order(edges: DataFrame, how: str = "alphabetical", given: list[str] | None = None) -> DataFrame:
    """Nodes with their place on a circle, and whether they are among the top tenth of roots.

    how is alphabetical, frequency (falling), manual (those of `given` first, in that order, the others by name) or
    cluster (by community, then by falling frequency).
    """
    ends = edges.select(F.col("from").alias("node"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")).unionAll(edges.select("to", F.lit(0).cast("long"), F.col("weight")))
    nodes = ends.groupBy("node").agg((F.sum("o") + F.sum("i")).alias("frequency"), (F.sum("o") - F.sum("i")).alias("root_score"))
    whole = Window.partitionBy()  # nodes are few
    if how == "alphabetical":
        place = whole.orderBy("node")
    elif how == "frequency":
        place = whole.orderBy(F.desc("frequency"), "node")
    elif how == "manual":
        at = F.array_position(F.lit(list(given or [])).cast("array<string>"), F.col("node").cast("string"))
        place = whole.orderBy(F.when(at > 0, at).asc_nulls_last(), "node")
    elif how == "cluster":
        labels = list(network.communities(edges)[0].items())  # a vocabulary
        schema = T.StructType([T.StructField("node", edges.schema["from"].dataType), T.StructField("community", T.IntegerType())])
        nodes = nodes.join(edges.sparkSession.createDataFrame(labels, schema), "node", "left")
        place = whole.orderBy("community", F.desc("frequency"), "node")
    else:
        raise ValueError(how)
    roots = F.row_number().over(whole.orderBy(F.desc("root_score"), "node")) <= F.greatest(F.lit(1), F.ceil(F.count("*").over(whole) * 0.1))
    return nodes.withColumns({"place": F.row_number().over(place), "is_root": roots})
