"""Transition networks: nodes and edges, degrees, path metrics and communities.

States are a vocabulary of contract types or labels: graphs are small once edges are aggregated, so path metrics run on the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ordering


def node_degrees(edges: DataFrame, loops: bool = True) -> DataFrame:
    """node, in and out degree and strength, their sums, and the root score out less in."""
    own = edges if loops else edges.where(F.col("from") != F.col("to"))
    ends = own.select(F.col("from").alias("node"), F.lit(1).alias("o"), F.col("weight").alias("ow"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("iw")).unionAll(own.select("to", F.lit(0), F.lit(0).cast("long"), F.lit(1), F.col("weight")))
    out = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("iw").alias("in_strength"), F.sum("ow").alias("out_strength"))
    return out.withColumns({"degree": F.col("in_degree") + F.col("out_degree"), "strength": F.col("in_strength") + F.col("out_strength"), "root_score": F.col("out_strength") - F.col("in_strength")})


def node_status(edges: DataFrame) -> DataFrame:
    """Nodes with their degrees and strengths in and out, and the employment status that their name tells: the first that fits of unemployed, full-time, part-time, several jobs."""
    name = F.lower("node")
    status = F.when(name.rlike("disoccupato|unemployed"), "Unemployed").when(name.rlike("occ_ft|full.?time"), "Full-time").when(name.rlike("occ_pt|part.?time"), "Part-time").when(name.contains("over_"), "Multiple Jobs").otherwise("Other")
    return node_degrees(edges).drop("root_score").withColumn("status", status)


def scaled(x: Column, low: float, span: float) -> Column:
    """x brought to low .. low + span over the whole table; the middle where all are equal."""
    whole = Window.partitionBy()
    least, most = F.min(x).over(whole), F.max(x).over(whole)
    return F.when(most > least, low + span * F.try_divide((x - least).cast("double"), most - least)).otherwise(low + span / 2)


def graph_nodes(edges: DataFrame, min_weight: int = 1) -> DataFrame:
    """Nodes of an interactive graph with size 10 .. 50 by their total transitions; loops are left out."""
    kept = edges.where((F.col("weight") >= min_weight) & (F.col("from") != F.col("to")))
    return node_degrees(kept).select("node", "in_strength", "out_strength", "strength").withColumn("size", scaled(F.col("strength"), 10.0, 40.0))


def graph_edges(edges: DataFrame, min_weight: int = 1) -> DataFrame:
    """Edges of an interactive graph with width 1 .. 10 by weight."""
    kept = edges.where((F.col("weight") >= min_weight) & (F.col("from") != F.col("to")))
    return kept.select("from", "to", "weight").withColumn("width", scaled(F.col("weight"), 1.0, 9.0))


def network_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density without loops, weight figures."""
    nodes = F.size(F.array_union(F.collect_set("from"), F.collect_set("to"))).cast("long")  # a vocabulary
    one = edges.agg(nodes.alias("n_nodes"), F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight"), F.avg("weight").alias("mean_weight"), F.median("weight").alias("median_weight"), F.max("weight").alias("max_weight"))
    return one.withColumn("density", C.ratio(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))


def top_nodes(edges: DataFrame, k: int = 5, by: str = "strength") -> DataFrame:
    """The k nodes with the largest degree or strength, ties by name, with their share of the sum (a top report)."""
    nodes = node_degrees(edges).select("node", F.col(by).alias("value"))
    return nodes.withColumn("share", C.ratio(F.col("value"), F.sum("value").over(Window.partitionBy()))).orderBy(F.desc("value"), "node").limit(k)  # nodes are few


def network_analysis(edges: DataFrame) -> dict:
    """Sizes, weights, centrality (mean, largest and five nodes of each kind), communities and their modularity, in one result."""
    rows = edges.select("from", "to", "weight")
    summary = network_summary(rows).first().asDict()
    degrees = {r.node: r for r in node_degrees(rows).collect()}  # a vocabulary
    paths = path_metrics(rows)
    labels, modularity = communities(rows)
    kinds = {"degree": {n: float(r.degree) for n, r in degrees.items()}, "strength": {n: float(r.strength) for n, r in degrees.items()}}
    kinds |= {"betweenness": {n: b for n, (b, _) in paths.items()}, "closeness": {n: c for n, (_, c) in paths.items()}}
    centrality = {}
    for kind, values in kinds.items():
        best = sorted(values, key=lambda n: (-values[n], str(n)))[:5]
        centrality[kind] = {"mean": sum(values.values()) / len(values) if values else None, "max": max(values.values(), default=None), "top": [(n, values[n]) for n in best]}
    return {"summary": summary, "centrality": centrality, "communities": labels, "n_communities": len(set(labels.values())), "modularity": modularity}


def complexity_nodes(segments: DataFrame, metric: str = "overlap_count") -> DataFrame:
    """Employment episodes (cf, over_id) with their five figures and a score: overlap_count (periods and overlapping periods), duration_sum (months of 30 days) or period_count."""
    figures = segments.where("over_id > 0").groupBy("cf", "over_id").agg(
        F.count("*").alias("period_count"), F.sum("durata").alias("total_duration"), C.count_if(F.col("arco") > 1).alias("overlap_periods"), F.count_distinct("cf").alias("cf_count"), F.avg("arco").alias("mean_arco")
    )
    scores = {"overlap_count": F.col("overlap_periods") + F.col("period_count"), "duration_sum": F.col("total_duration") / 30, "period_count": F.col("period_count")}
    return figures.withColumn("complexity_score", scores[metric].cast("double")).where("complexity_score > 0")


#: Rows of the order of scores that are joined in one task.
_LINE = 4096


def similarity_edges(nodes: DataFrame, least: float = 0.3, neighbours: int = 5, keys: tuple[str, str] = ("cf", "over_id")) -> DataFrame:
    """Pairs of nodes of like complexity: each with the next `neighbours` in the order of (score, keys), where 1 / (1 + difference) is over `least`.

    All pairs over the limit grow with the square of the nodes, and in the order of scores the nearest stand side by side: a
    node has at most 2 x neighbours edges.  The order is cut into parts that hand their first rows on to the part before.
    """
    if not 0 < neighbours <= _LINE:
        raise ValueError(f"neighbours go from 1 to {_LINE}")
    rows = nodes.select(*keys, F.col("complexity_score").alias("score"), F.lit(1).cast("long").alias("one"))
    placed = ordering.running_sums(rows, "score", ["one"], ties=list(keys))
    place = F.col("one_upto") - 1
    own = F.struct(F.floor(place / _LINE).alias("part"), F.lit(True).alias("own"))
    border = F.struct((F.floor(place / _LINE) - 1).alias("part"), F.lit(False).alias("own"))
    dealt = placed.select(*keys, "score", place.alias("place"), F.explode(F.when(place % _LINE < neighbours, F.array(own, border)).otherwise(F.array(own))).alias("p")).select(*keys, "score", "place", "p.*")
    order = Window.partitionBy("part").orderBy("place")  # _LINE + neighbours rows
    nexts = F.collect_list(F.struct(*keys, "score")).over(order.rowsBetween(1, neighbours))
    pairs = dealt.withColumn("to", nexts).where("own").select(F.struct(*keys).alias("from"), "score", F.explode("to").alias("to"))
    similarity = 1 / (1 + F.abs(F.col("score") - F.col("to.score")))
    name = lambda side: [F.col(f"{side}.{k}").alias(f"{side}_{k}") for k in keys]
    return pairs.select(*name("from"), *name("to"), similarity.alias("weight")).where(F.col("weight") > least)


def _adjacency(edges: DataFrame, most: int = 5000) -> tuple[list, dict]:
    rows = edges.select("from", "to", "weight").limit(most * 10 + 1).collect()
    if len(rows) > most * 10:
        raise ValueError("path metrics are for graphs of a few thousand states")
    nodes = sorted({r["from"] for r in rows} | {r["to"] for r in rows})
    out: dict = {n: {} for n in nodes}
    for r in rows:
        if r["from"] != r["to"]:
            out[r["from"]][r["to"]] = float(r["weight"])
    return nodes, out


def path_metrics(edges: DataFrame) -> dict:
    """node -> (betweenness, closeness) with weights as lengths (Brandes)."""
    nodes, out = _adjacency(edges)
    between, close = dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        distance, count, before, done = {s: 0.0}, {s: 1.0}, {s: []}, []
        agenda = [(0.0, s)]
        closed = set()
        while agenda:
            d, v = heapq.heappop(agenda)
            if v in closed:
                continue
            closed.add(v)
            done.append(v)
            for w, length in out[v].items():
                new = d + length
                if w not in distance or new < distance[w] - 1e-12:
                    distance[w], count[w], before[w] = new, count[v], [v]
                    heapq.heappush(agenda, (new, w))
                elif abs(new - distance[w]) <= 1e-12 and w not in closed:
                    count[w] += count[v]
                    before[w].append(v)
        far = sum(distance.values())
        close[s] = (len(distance) - 1) / far if far else 0.0
        share = dict.fromkeys(done, 0.0)
        for w in reversed(done):
            for v in before[w]:
                share[v] += count[v] / count[w] * (1 + share[w])
            if w != s:
                between[w] += share[w]
    return {n: (between[n], close[n]) for n in nodes}


def communities(edges: DataFrame) -> tuple[dict, float]:
    """Labels and modularity of a Louvain partition of the undirected graph; nodes are visited in order, so it is repeatable."""
    nodes, out = _adjacency(edges)
    link: dict = {n: {} for n in nodes}
    for a, row in out.items():
        for b, w in row.items():
            link[a][b] = link[a].get(b, 0.0) + w
            link[b][a] = link[b].get(a, 0.0) + w
    member = {n: n for n in nodes}
    total = sum(sum(r.values()) for r in link.values())
    if not total:
        return {n: i for i, n in enumerate(nodes)}, 0.0
    graph = {n: dict(r) for n, r in link.items()}
    while True:
        label = {n: n for n in graph}
        degree = {n: sum(r.values()) for n, r in graph.items()}
        weight = dict(degree)
        moved = improved = True
        while moved:
            moved = False
            for n in sorted(graph):
                own = label[n]
                weight[own] -= degree[n]
                to: dict = {}
                for m, w in graph[n].items():
                    if m != n:
                        to[label[m]] = to.get(label[m], 0.0) + w
                best = max([own, *to], key=lambda c: (round(to.get(c, 0.0) - weight[c] * degree[n] / total, 12), c == own, str(c)))
                weight[best] += degree[n]
                if best != own:
                    label[n], moved = best, True
        improved = len(set(label.values())) < len(graph)
        member = {n: label[c] for n, c in member.items()}
        if not improved:
            break
        merged: dict = {c: {} for c in set(label.values())}
        for n, r in graph.items():
            for m, w in r.items():
                a, b = label[n], label[m]
                merged[a][b] = merged[a].get(b, 0.0) + w
        graph = merged
    names = {c: i for i, c in enumerate(sorted(set(member.values()), key=str))}
    degree = {n: sum(r.values()) for n, r in link.items()}
    inside, sums = {}, {}
    for n, r in link.items():
        sums[member[n]] = sums.get(member[n], 0.0) + degree[n]
        inside[member[n]] = inside.get(member[n], 0.0) + sum(w for m, w in r.items() if member[m] == member[n])
    modularity = sum(inside[c] / total - (sums[c] / total) ** 2 for c in sums)
    return {n: names[c] for n, c in member.items()}, modularity
