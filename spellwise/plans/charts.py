"""Queries over networks, chart data and generated histories."""

from __future__ import annotations

from ..operators import career as R
from ..operators import network as N
from ..operators import plotdata as P
from ..operators import transitions as T
from ..sources import adapters as A
from ..sources import generate as G
from .base_sql import EDGES, SEGMENTS, moves
from .metrics import _success_sql
from .registry import add, rounded

_edges = lambda s, d: T.transitions(A.segments(s, d))
_DEGREES = """dg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(iw) AS BIGINT) AS in_strength, CAST(sum(ow) AS BIGINT) AS out_strength FROM (
    SELECT "from" AS node, 1 AS o, weight AS ow, 0 AS i, 0 AS iw FROM ed UNION ALL SELECT "to", 0, 0, 1, weight FROM ed) GROUP BY node)"""
add("node_degrees", lambda s, d: N.node_degrees(_edges(s, d)), f"WITH {EDGES}, ed AS (SELECT * FROM edges), {_DEGREES} SELECT *, in_degree + out_degree AS degree, in_strength + out_strength AS strength, out_strength - in_strength AS root_score FROM dg")
add(
    "node_status",
    lambda s, d: N.node_status(T.transitions(A.segments(s, d), variable="stato")),
    f"""WITH {SEGMENTS}, sg AS (SELECT * REPLACE (stato AS ct) FROM segments),{moves("sg")}, ed AS (SELECT * FROM edges), {_DEGREES} SELECT *, in_degree + out_degree AS degree, in_strength + out_strength AS strength,
        CASE WHEN regexp_matches(lower(node), 'disoccupato|unemployed') THEN 'Unemployed' WHEN regexp_matches(lower(node), 'occ_ft|full.?time') THEN 'Full-time' WHEN regexp_matches(lower(node), 'occ_pt|part.?time') THEN 'Part-time' WHEN contains(lower(node), 'over_') THEN 'Multiple Jobs' ELSE 'Other' END AS status FROM dg""",
)
_NO_LOOPS = 'ed AS (SELECT * FROM edges WHERE "from" <> "to")'
_scaled = lambda x, low, span: f"CASE WHEN max({x}) OVER () > min({x}) OVER () THEN {low} + {span} * ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) ELSE {low + span / 2} END"
add("node_sizes", lambda s, d: N.graph_nodes(_edges(s, d)), f"WITH {EDGES}, {_NO_LOOPS}, {_DEGREES}, n AS (SELECT node, in_strength, out_strength, in_strength + out_strength AS strength FROM dg) SELECT *, round({_scaled('strength', 10.0, 40.0)}, 6) AS size FROM n")
add("edge_widths", lambda s, d: N.graph_edges(_edges(s, d)), f'WITH {EDGES}, {_NO_LOOPS} SELECT "from", "to", weight, round({_scaled("weight", 1.0, 9.0)}, 6) AS width FROM ed')
add(
    "network_summary",
    lambda s, d: N.network_summary(_edges(s, d)),
    f"""WITH {EDGES}, o AS (SELECT (SELECT count(*) FROM (SELECT "from" FROM edges UNION SELECT "to" FROM edges)) AS n_nodes, count(*) AS n_edges, CAST(sum(weight) AS BIGINT) AS total_weight, round(avg(weight), 6) AS mean_weight, round(median(weight), 6) AS median_weight, max(weight) AS max_weight FROM edges)
    SELECT *, round(n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM o""",
)
_NODES = """nd AS (SELECT cf, over_id, count(*) AS period_count, CAST(sum(durata) AS BIGINT) AS total_duration, count(*) FILTER (arco > 1) AS overlap_periods, count(DISTINCT cf) AS cf_count, avg(arco) AS mean_arco FROM segments WHERE over_id > 0 GROUP BY cf, over_id)"""
_SCORES = {"overlap_count": "overlap_periods + period_count", "duration_sum": "total_duration / 30", "period_count": "period_count"}
for metric, score in _SCORES.items():
    add(
        f"complexity_nodes_{metric}",
        lambda s, d, metric=metric: N.complexity_nodes(A.segments(s, d), metric),
        f"WITH {SEGMENTS}, {_NODES} SELECT cf, over_id, period_count, total_duration, overlap_periods, cf_count, round(mean_arco, 6) AS mean_arco, round({score}, 6) AS complexity_score FROM nd WHERE {score} > 0",
    )


def _similar_sql(metric: str, neighbours: int = 5, least: float = 0.3) -> str:
    """Each node against the next ones in the order of scores, by their numbers."""
    return f"""WITH {SEGMENTS}, {_NODES}, pl AS (SELECT cf, over_id, CAST({_SCORES[metric]} AS DOUBLE) AS score, row_number() OVER (ORDER BY {_SCORES[metric]}, cf, over_id) AS r FROM nd WHERE {_SCORES[metric]} > 0)
    SELECT a.cf AS from_cf, a.over_id AS from_over_id, b.cf AS to_cf, b.over_id AS to_over_id, round(1 / (1 + abs(a.score - b.score)), 6) AS weight
    FROM (SELECT *, unnest(range(1, {neighbours + 1})) AS k FROM pl) a JOIN pl b ON b.r = a.r + a.k WHERE 1 / (1 + abs(a.score - b.score)) > {least}"""


add("complexity_network", lambda s, d: N.similarity_edges(N.complexity_nodes(A.segments(s, d))), _similar_sql("overlap_count"))
add("similarity_edges", lambda s, d: N.similarity_edges(N.complexity_nodes(A.segments(s, d), "duration_sum")), _similar_sql("duration_sum"))
add("timeline", lambda s, d: P.timeline(A.segments(s, d)), f"WITH {SEGMENTS}, p AS (SELECT cf, CAST(row_number() OVER (ORDER BY cf) AS INTEGER) AS y FROM (SELECT DISTINCT cf FROM segments) ORDER BY cf LIMIT 20) SELECT cf, y, inizio, fine, stato, durata FROM segments JOIN p USING (cf)")
_month = "CAST(date_trunc('month', inizio) AS DATE)"
_year = "CAST(date_trunc('year', inizio) AS DATE)"
for measure, value in {"count": "count(*)", "days": "CAST(sum(durata) AS BIGINT)"}.items():
    add(f"distribution_{measure}", lambda s, d, measure=measure: P.distribution(A.segments(s, d), measure=measure), f"WITH {SEGMENTS}, v AS (SELECT {_month} AS period, stato, {value} AS value FROM segments GROUP BY 1, 2) SELECT period, stato, value, round(value / sum(value) OVER (PARTITION BY period), 6) AS share FROM v")
add("duration_summary", lambda s, d: P.duration_summary(A.segments(s, d)), f"WITH {SEGMENTS} SELECT stato, CAST(median(durata) AS DOUBLE) AS median, round(avg(durata), 6) AS mean, CAST(quantile_cont(durata, 0.75) AS DOUBLE) AS q75, count(*) AS n FROM segments GROUP BY stato")
_MODAL = f"{SEGMENTS}, ct_ AS (SELECT cf, {_year} AS period, stato, row_number() OVER (PARTITION BY cf, {_year} ORDER BY count(*) DESC, stato) AS r FROM segments GROUP BY 1, 2, 3), md AS (SELECT cf, period, stato FROM ct_ WHERE r = 1)"
add("modal_status", lambda s, d: P.modal_status(A.segments(s, d)), f"WITH {_MODAL} SELECT * FROM md")
add("status_flows", lambda s, d: P.flows(A.segments(s, d)), f'WITH {_MODAL}, e AS (SELECT cf, count(*) AS k, arg_min(stato, period) AS f, arg_max(stato, period) AS t FROM md GROUP BY cf) SELECT f AS "from", t AS "to", count(*) AS n FROM e WHERE k >= 2 GROUP BY 1, 2')
add("person_heatmap", lambda s, d: P.heatmap(A.segments(s, d)), f"WITH {SEGMENTS} SELECT cf, {_month} AS period, count(*) AS n, round(avg(durata), 6) AS mean_duration, count(*) - 1 AS changes FROM segments GROUP BY 1, 2")
add("status_heatmap", lambda s, d: P.status_heatmap(A.segments(s, d)), f"WITH {SEGMENTS} SELECT cf, {_month} AS period, max(CASE stato WHEN 'occ_pt' THEN 1 WHEN 'occ_ft' THEN 2 WHEN 'over_pt_pt' THEN 3 WHEN 'over_pt_ft' THEN 4 WHEN 'over_ft_pt' THEN 4 WHEN 'over_ft_ft' THEN 5 ELSE 0 END) AS status_code FROM segments GROUP BY 1, 2")
add("overlap_heatmap", lambda s, d: P.overlap_heatmap(A.segments(s, d)), f"WITH {SEGMENTS} SELECT cf, {_month} AS month, CAST(least(max(arco), 5) AS INTEGER) AS jobs FROM segments WHERE arco >= 2 GROUP BY 1, 2")
add("kpi_summary", lambda s, d: P.kpis(A.segments(s, d)), f"WITH {SEGMENTS} SELECT count(DISTINCT cf) AS n_persons, count(*) AS n_segments, round(100 * sum(CASE WHEN arco >= 1 THEN durata END) / sum(durata), 6) AS employment_rate_pct, round(avg(durata), 6) AS mean_duration, round(100 * count(CASE WHEN arco > 1 THEN 1 END) / count(CASE WHEN arco >= 1 THEN 1 END), 6) AS overlap_pct FROM segments")
add("monthly_kpi", lambda s, d: P.monthly_rates(A.segments(s, d)), f"WITH {SEGMENTS} SELECT {_month} AS month, count(DISTINCT cf) AS n_persons, round(avg(CASE WHEN arco >= 1 THEN 1.0 ELSE 0.0 END), 6) AS employment_rate FROM segments GROUP BY 1")
add("over_id_summary", lambda s, d: P.over_id_summary(A.segments(s, d)), f"WITH {SEGMENTS} SELECT cf, over_id, count(*) AS n, CAST(sum(durata) AS BIGINT) AS total_days, round(avg(durata), 6) AS mean_days, max(arco) AS most_jobs, CAST(quantile_cont(durata, 0.25) AS DOUBLE) AS q25, CAST(median(durata) AS DOUBLE) AS median, CAST(quantile_cont(durata, 0.75) AS DOUBLE) AS q75 FROM segments WHERE over_id > 0 GROUP BY cf, over_id")
add("gantt", lambda s, d: P.gantt(A.segments(s, d)), f"""WITH {SEGMENTS} SELECT cf, inizio, fine, stato, inizio + CAST(floor(durata / 2) AS INTEGER) AS middle, CASE WHEN durata < 60 THEN durata || 'd' WHEN durata < 730 THEN CAST(CAST(round(durata / 30.44, 0) AS INTEGER) AS VARCHAR) || 'm' ELSE CAST(round(durata / 365.25, 1) AS VARCHAR) || 'y' END AS label FROM segments""")
add(
    "gantt_milestones",
    lambda s, d: P.milestones(A.segments(s, d)),
    f"""WITH {SEGMENTS}, tp AS (SELECT cf, CAST(row_number() OVER (ORDER BY sum(durata) DESC, cf) AS INTEGER) AS y FROM segments GROUP BY cf ORDER BY y LIMIT 10),
    mk AS (SELECT cf, inizio AS date, 0 AS late FROM segments UNION ALL SELECT cf, fine, 1 FROM segments)
    SELECT cf, y, date, CASE WHEN min(late) = 0 THEN 'start' ELSE 'end' END AS type FROM mk JOIN tp USING (cf) GROUP BY cf, y, date""",
)
add(
    "career_events",
    lambda s, d: P.career_events(A.segments(s, d)),
    f"""WITH {SEGMENTS}, jb AS (SELECT cf, inizio, fine, ct, lag(ct) OVER (PARTITION BY cf ORDER BY inizio, fine) AS before FROM segments WHERE arco > 0 AND ct IS NOT NULL),
    ch AS (SELECT cf, count(*) FILTER (before IS NOT NULL AND before <> ct) AS n FROM jb GROUP BY cf), gp AS (SELECT cf, arg_max(inizio, (durata, DATE '2100-01-01' - inizio)) AS b, max(durata) AS m FROM segments WHERE arco = 0 GROUP BY cf)
    SELECT s.cf, min(inizio) FILTER (arco > 0) AS first_job, coalesce(any_value(n), 0) AS contract_changes, any_value(b) AS longest_gap_start, any_value(m) AS longest_gap_days, CAST(sum(durata) AS BIGINT) AS total_days
    FROM segments s LEFT JOIN ch USING (cf) LEFT JOIN gp USING (cf) GROUP BY s.cf HAVING min(inizio) FILTER (arco > 0) IS NOT NULL""",
)
add("top_nodes", lambda s, d: N.top_nodes(_edges(s, d)), f"WITH {EDGES}, ed AS (SELECT * FROM edges), {_DEGREES} SELECT node, in_strength + out_strength AS value, round((in_strength + out_strength) / sum(in_strength + out_strength) OVER (), 6) AS share FROM dg ORDER BY value DESC, node LIMIT 5")
add(
    "person_order",
    lambda s, d: P.person_order(rounded(R.success(A.segments(s, d))), "career_success_index", ["contract_quality_score", "career_stability_score"]),
    f"""WITH {SEGMENTS}, {_success_sql("segments", "cf")}, pl AS (SELECT *, CAST(row_number() OVER (ORDER BY career_success_index DESC NULLS LAST, cf) AS INTEGER) AS y FROM success)
    SELECT cf, y, 'contract_quality_score' AS metric_name, contract_quality_score AS metric_value FROM pl UNION ALL SELECT cf, y, 'career_stability_score', career_stability_score FROM pl""",
)


def _paths(s, d):
    found = N.path_metrics(T.transition_matrix(_edges(s, d)).withColumnRenamed("value", "weight").where("weight > 0"))
    return s.createDataFrame([(n, b, c) for n, (b, c) in found.items()], "node string, betweenness double, closeness double")


def _communities(s, d):
    labels, modularity = N.communities(_edges(s, d))
    return s.createDataFrame([(n, c, modularity) for n, c in labels.items()], "node string, community int, modularity double")


add("betweenness", _paths)
add("louvain", _communities)
add("generated_histories", lambda s, d: G.histories(s, 500, 5000))
add("generated_validation", lambda s, d: G.validate(G.histories(s, 500, 5000)))
