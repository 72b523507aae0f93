"""Queries over segments, transitions, overlaps and consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import overlaps as O
from ..operators import segments as S
from ..operators import transitions as T
from ..sources import adapters as A
from .base_sql import EDGES, ONES, SEGMENTS, SWEPT, consecutive, moves, overlapping
from .registry import add

_edges = lambda s, d, **k: T.transitions(A.segments(s, d), **k)
_merged = lambda s, d: T.transitions(S.consolidate(A.segments(s, d), "both"))

add("segments_sweep", lambda s, d: S.sweep(A.contracts(s, d)), f"WITH {SWEPT} SELECT cf, inizio, fine, arco, over_id, durata FROM swept")
add(
    "segment_attributes_chain",
    lambda s, d: A.segments(s, d).withColumn("retribuzione", F.round("retribuzione", 6)),
    f'WITH {SEGMENTS} SELECT cf, id, inizio, fine, arco, over_id, durata, prior, ct AS "{C.CONTRACT}", round(retribuzione, 6) AS retribuzione, stato FROM segments',
)
add(
    "over_id_validation",
    lambda s, d: S.validate_over_id(A.segments(s, d)),
    f"""WITH {SEGMENTS}, v AS (
        SELECT count(over_id) / greatest(count(*), 1) AS over_id_completeness, bool_and(arco <> 0 OR over_id = 0) AS unemployment_properly_coded,
            bool_and(arco < 1 OR over_id > 0) AS employment_properly_coded, min(over_id) AS min_over_id, max(over_id) AS max_over_id,
            count(DISTINCT CASE WHEN arco > 1 THEN cf END) AS persons_with_overlapping, count(DISTINCT over_id) AS total_over_id_groups FROM segments
    ), q AS (SELECT *, (over_id_completeness + CAST(unemployment_properly_coded AS INTEGER) + CAST(employment_properly_coded AS INTEGER)) / 3 AS score FROM v)
    SELECT over_id_completeness, unemployment_properly_coded, employment_properly_coded, min_over_id, max_over_id, persons_with_overlapping, total_over_id_groups,
        round(score, 6) AS quality_score, CASE WHEN score >= 0.95 THEN 'Excellent' WHEN score >= 0.85 THEN 'Good' WHEN score >= 0.7 THEN 'Fair' ELSE 'Poor' END AS quality_grade FROM q""",
)

_COLUMNS = f'cf, inizio, fine, arco, over_id, durata, prior, round(retribuzione, 6) AS retribuzione, ct AS "{C.CONTRACT}", n_periods, n_periods > 1 AS collapsed'
for kind, ctes in {
    "overlapping": overlapping("ones", "merged"),
    "consecutive": consecutive("ones", "merged"),
    "both": overlapping("ones", "episodes") + "," + consecutive("episodes", "merged"),
}.items():
    add(f"consolidate_{kind}", lambda s, d, kind=kind: S.consolidate(A.segments(s, d), kind).withColumn("retribuzione", F.round("retribuzione", 6)), f"WITH {SEGMENTS}, {ONES}, {ctes} SELECT {_COLUMNS} FROM merged")

for which in ("last", "first", "none"):
    add(
        f"transitions_{which}",
        lambda s, d, which=which: _edges(s, d, chain=which),
        f'WITH {SEGMENTS}, {moves("segments", which)} SELECT "from", "to", weight, round(transition_duration, 6) AS transition_duration FROM edges',
    )
add(
    "transitions_weighted_median",
    lambda s, d: _edges(s, d, statistics=("retribuzione",)),
    f"""WITH {EDGES}, fm AS (
        SELECT f, t, median(fr) AS m FROM (SELECT f, t, fr, unnest(range(greatest(1, fd))) AS k FROM moves) GROUP BY f, t
    ), tm AS (SELECT f, t, median(tr) AS m FROM (SELECT f, t, tr, unnest(range(greatest(1, td))) AS k FROM moves) GROUP BY f, t)
    SELECT "from", "to", weight, round(transition_duration, 6) AS transition_duration, round(fm.m, 6) AS retribuzione_from_median, round(tm.m, 6) AS retribuzione_to_median
    FROM edges JOIN fm ON fm.f = "from" AND fm.t = "to" JOIN tm ON tm.f = "from" AND tm.t = "to" """,
)
_mode = lambda c: f"(SELECT f, t, {c} AS v FROM (SELECT f, t, {c}, row_number() OVER (PARTITION BY f, t ORDER BY count(*) DESC, {c}) AS r FROM moves WHERE {c} IS NOT NULL GROUP BY f, t, {c}) WHERE r = 1)"
add(
    "transitions_mode",
    lambda s, d: _edges(s, d, statistics=("stato",)),
    f"""WITH {EDGES} SELECT "from", "to", weight, round(transition_duration, 6) AS transition_duration, a.v AS stato_from_mode, b.v AS stato_to_mode
    FROM edges LEFT JOIN {_mode("fs")} a ON a.f = "from" AND a.t = "to" LEFT JOIN {_mode("ts")} b ON b.f = "from" AND b.t = "to" """,
)

_GRID = f"""WITH {EDGES}, states AS (SELECT "from" AS s FROM edges UNION SELECT "to" FROM edges),
    grid AS (SELECT a.s AS "from", b.s AS "to", CAST(coalesce(e.weight, 0) AS DOUBLE) AS v FROM states a CROSS JOIN states b LEFT JOIN edges e ON e."from" = a.s AND e."to" = b.s)"""
for how, part in {"none": None, "row": 'PARTITION BY "from"', "column": 'PARTITION BY "to"', "total": ""}.items():
    value = "v" if part is None else f"coalesce(v / nullif(sum(v) OVER ({part}), 0), 0)"
    add(f"transition_matrix_{how}", lambda s, d, how=how: T.transition_matrix(_edges(s, d), how), f'{_GRID} SELECT "from", "to", round({value}, 6) AS value FROM grid')


_STATES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
add("transition_matrix_wide", lambda s, d: T.pivoted(T.transition_matrix(_edges(s, d), "row")), f"""{_GRID}, sh AS (SELECT "from", "to", coalesce(v / nullif(sum(v) OVER (PARTITION BY "from"), 0), 0) AS p FROM grid) SELECT "from", {", ".join(f"round(sum(p) FILTER (\"to\" = '{c}'), 6) AS \"{c}\"" for c in _STATES)} FROM sh GROUP BY "from" """)


def _statistics(edges: str, name: str) -> str:
    return f"""{name}_one AS (
        SELECT (SELECT count(*) FROM (SELECT "from" FROM {edges} UNION SELECT "to" FROM {edges})) AS n, coalesce(sum(weight), 0) AS total, count(*) AS nz,
            coalesce(sum(CASE WHEN "from" = "to" THEN weight END), 0) AS loops, count(DISTINCT "from") AS af, count(DISTINCT "to") AS at_, coalesce(avg(weight), 0) AS mean,
            coalesce(median(weight), 0) AS med, coalesce(max(weight), 0) AS mx FROM {edges}
    ), {name}_stats AS (
        SELECT unnest(['n_states', 'total_transitions', 'n_nonzero_cells', 'n_possible_cells', 'sparsity', 'density', 'n_self_transitions', 'pct_self_transitions',
            'active_from_states', 'active_to_states', 'mean_transition_weight', 'median_transition_weight', 'max_transition_weight']) AS metric,
            unnest([CAST(n AS DOUBLE), total, nz, n * n, round(1 - nz / (n * n), 4), round(nz / (n * n), 4), loops, round(loops / total, 4), af, at_, round(mean, 2), round(med, 2), mx]) AS value
        FROM {name}_one
    )"""


_BOTH_EDGES = (
    f"WITH {SEGMENTS}, {moves()}, {ONES}, {overlapping('ones', 'episodes')}, {consecutive('episodes', 'merged')}, stated AS (SELECT *, '' AS stato FROM merged), "
    + moves("stated").replace("around AS", "around2 AS").replace("FROM around", "FROM around2").replace("moves AS", "moves2 AS").replace("FROM moves", "FROM moves2").replace("edges AS", "edges2 AS")
    + f", {_statistics('edges', 'raw')}, {_statistics('edges2', 'cons')}"
)
add("matrix_statistics", lambda s, d: T.matrix_statistics(_edges(s, d)), f"WITH {EDGES}, {_statistics('edges', 'raw')} SELECT 'raw' AS matrix_type, metric, value FROM raw_stats")
add(
    "matrix_comparison",
    lambda s, d: T.compare_matrices(_edges(s, d), _merged(s, d)),
    f"""{_BOTH_EDGES}, j AS (
        SELECT metric, r.value AS raw_value, c.value AS consolidated_value, round(CASE WHEN metric = 'density' THEN c.value - r.value ELSE r.value - c.value END, 6) AS improvement
        FROM raw_stats r JOIN cons_stats c USING (metric)
        WHERE metric IN ('n_states', 'total_transitions', 'sparsity', 'n_self_transitions', 'pct_self_transitions', 'density', 'n_nonzero_cells')
    ) SELECT metric, raw_value, consolidated_value, improvement, round(100 * improvement / greatest(raw_value, 1e-10), 1) AS improvement_pct,
        CASE WHEN metric = 'sparsity' AND improvement > 0 THEN 'Reduced sparsity' WHEN metric = 'n_self_transitions' AND improvement > 0 THEN 'Eliminated administrative self-transitions'
            WHEN metric = 'pct_self_transitions' AND improvement > 0 THEN 'Reduced self-transition rate' WHEN metric = 'density' AND improvement > 0 THEN 'Increased matrix density'
            WHEN metric = 'n_states' AND improvement > 0 THEN 'Simplified' WHEN metric = 'n_states' AND improvement < 0 THEN 'Added states'
            WHEN improvement = 0 THEN 'No change' ELSE 'Other change' END AS interpretation FROM j""",
)
add(
    "consolidation_impact",
    lambda s, d: T.consolidation_impact_matrix(_edges(s, d), _merged(s, d)),
    f"""{_BOTH_EDGES}, p AS (
        SELECT max(CASE WHEN metric = 'total_transitions' THEN r.value END) AS t0, max(CASE WHEN metric = 'n_self_transitions' THEN r.value END) AS s0, max(CASE WHEN metric = 'sparsity' THEN r.value END) AS z0,
            max(CASE WHEN metric = 'total_transitions' THEN c.value END) AS t1, max(CASE WHEN metric = 'n_self_transitions' THEN c.value END) AS s1, max(CASE WHEN metric = 'sparsity' THEN c.value END) AS z1
        FROM raw_stats r JOIN cons_stats c USING (metric)
    ) SELECT unnest(['transitions_consolidated', 'administrative_noise_removed', 'transition_reduction_pct', 'self_transition_reduction_pct', 'sparsity_improvement', 'matrix_efficiency_gain']) AS impact_metric,
        unnest([t0 - t1, s0 - s1, round(100 * (t0 - t1) / t0, 1), round(100 * (s0 - s1) / s0, 1), round(z0 - z1, 4), round((s0 - s1) / greatest(t0, 1), 4)]) AS value FROM p""",
)
add(
    "person_consolidation_impact",
    lambda s, d: T.person_consolidation_impact(A.segments(s, d)),
    f"""WITH {SEGMENTS}, g AS (
        SELECT cf, count(*) AS n, count(DISTINCT over_id) AS c, avg(CASE WHEN arco >= 1 THEN arco END) AS a, coalesce(sum(CASE WHEN arco >= 1 THEN durata END), 0) AS d FROM segments GROUP BY cf
    ) SELECT cf, n AS original_segments, c AS consolidated_periods, round(1 - c / n, 4) AS consolidation_ratio, n - c AS complexity_reduction,
        round(CASE WHEN a IS NULL THEN 1 - c / n ELSE (1 - c / n) * (1 + log10(1 + a)) * log10(1 + d) END, 4) AS impact_score FROM g""",
)
add(
    "transitions_by_year",
    lambda s, d: T.transitions_by(T.transition_rows(A.segments(s, d)).withColumn("year", F.year("inizio")), "year"),
    f'WITH {EDGES} SELECT CAST(year(inizio) AS INTEGER) AS "year", f AS "from", t AS "to", count(*) AS weight, round(avg(durata), 6) AS transition_duration FROM moves GROUP BY ALL',
)
add(
    "transitions_by_group",
    lambda s, d: T.transitions_by(T.transition_rows(A.segments(s, d)).join(A.table(s, d, "customer").select(F.col("c_custkey").alias("cf"), F.col("c_mktsegment").alias("area")), "cf"), "area"),
    f'WITH {EDGES} SELECT c_mktsegment AS area, f AS "from", t AS "to", count(*) AS weight, round(avg(durata), 6) AS transition_duration FROM moves JOIN customer ON c_custkey = cf GROUP BY ALL',
)

_DAYS = "CAST(sum(durata) AS BIGINT) AS total_days, round(avg(durata), 1) AS avg_duration, round(median(durata), 1) AS median_duration"
_EMP, _OVER = "CASE WHEN arco >= 1 THEN", "CASE WHEN arco > 1 THEN"
add(
    "consolidated_person",
    lambda s, d: O.consolidated_persons(A.segments(s, d)),
    f"""WITH {SEGMENTS}, e AS (
        SELECT cf, over_id, count(*) AS n, count({_EMP} 1 END) AS employed, coalesce(sum({_EMP} durata END), 0) AS days, sum(durata) AS all_days, sum({_EMP} arco END) AS arco_sum, max({_EMP} arco END) AS arco_max
        FROM segments GROUP BY cf, over_id
    ), g AS (
        SELECT cf, CAST(sum(n) AS BIGINT) AS n, count(CASE WHEN over_id > 0 THEN 1 END) AS jobs, count(CASE WHEN over_id = 0 THEN 1 END) AS idle, CAST(sum(employed) AS BIGINT) AS employed,
            coalesce(sum(arco_sum), 0) AS arco_sum, coalesce(max(arco_max), 0) AS max_jobs, CAST(sum(days) AS BIGINT) AS days, CAST(coalesce(sum(CASE WHEN over_id > 0 THEN all_days END), 0) AS BIGINT) AS job_days,
            count(CASE WHEN over_id > 0 AND n > 1 THEN 1 END) AS over_ FROM e GROUP BY cf
    ) SELECT cf, n AS total_periods_original, jobs + idle AS total_periods_consolidated, employed AS employment_periods_original, jobs AS employment_periods_consolidated, idle AS unemployment_periods,
        round(1 - (jobs + idle) / n, 4) AS consolidation_ratio, round(coalesce(arco_sum / nullif(employed, 0), 0), 2) AS employment_complexity_avg, max_jobs AS max_simultaneous_jobs,
        days AS total_employment_days_original, job_days AS total_employment_days_consolidated, round(coalesce(days / nullif(employed, 0), 0), 1) AS avg_employment_duration_original,
        round(coalesce(job_days / nullif(jobs, 0), 0), 1) AS avg_employment_duration_consolidated, round(coalesce(job_days / nullif(days, 0), 1), 4) AS duration_efficiency, over_ AS overlapping_episodes FROM g""",
)


def _metrics(values: dict[str, str], source: str) -> str:
    names = ", ".join(f"'{k}'" for k in values)
    texts = ", ".join(f"regexp_replace(printf('%.4f', CAST({v} AS DOUBLE)), '\\.?0+$', '')" for v in values.values())
    return f"SELECT unnest([{names}]) AS metric, unnest([{texts}]) AS value FROM {source}"


add(
    "consolidated_aggregate",
    lambda s, d: O.consolidated_aggregate(A.segments(s, d)),
    f"""WITH {SEGMENTS}, g AS (
        SELECT count(DISTINCT cf) AS p, count(*) AS n, count({_EMP} 1 END) AS e, count(CASE WHEN arco = 0 THEN 1 END) AS i, count(DISTINCT CASE WHEN over_id > 0 THEN (cf, over_id) END) AS j,
            count(DISTINCT CASE WHEN over_id = 0 THEN cf END) AS ig, median({_EMP} durata END) AS med, avg({_EMP} arco END) AS aa, max(arco) AS ma, count(DISTINCT {_OVER} cf END) AS w FROM segments
    ) """
    + _metrics({
        "total_persons": "p", "total_segments_original": "n", "total_employment_segments": "e", "total_unemployment_segments": "i", "total_consolidated_employment_periods": "j",
        "total_consolidated_unemployment_periods": "ig", "avg_periods_per_person_original": "round(n / p, 2)", "avg_employment_periods_per_person": "round(e / p, 2)", "median_employment_duration": "round(med, 1)",
        "avg_employment_complexity": "round(aa, 2)", "max_employment_complexity": "ma", "pct_with_overlapping_employment": "round(100 * w / p, 1)", "total_consolidated_periods": "j + i",
        "overall_consolidation_ratio": "round(1 - (j + i) / n, 4)", "consolidation_efficiency_pct": "round(100 * (1 - (j + i) / n), 1)",
    }, "g"),
)
add(
    "consolidation_benefits",
    lambda s, d: O.consolidation_benefits(A.segments(s, d)),
    f"""WITH {SEGMENTS} SELECT cf, over_id, count(*) AS original_segments, CAST(sum(durata) AS BIGINT) AS total_duration, round(avg(arco), 2) AS avg_employment_intensity, max(arco) AS max_employment_intensity,
        1 AS consolidated_segments, count(*) - 1 AS complexity_reduction, CASE WHEN count(*) > 1 THEN 'High' ELSE 'Standard' END AS administrative_efficiency FROM segments WHERE over_id > 0 GROUP BY cf, over_id""",
)
add(
    "employment_complexity",
    lambda s, d: O.employment_complexity(A.segments(s, d)),
    f"WITH {SEGMENTS} SELECT arco, count(*) AS segments_count, CAST(sum(durata) AS BIGINT) AS total_person_days, round(avg(durata), 1) AS avg_duration, count(DISTINCT cf) AS persons_affected, arco AS employment_intensity FROM segments WHERE arco >= 1 GROUP BY arco",
)
add(
    "overlap_person",
    lambda s, d: O.person_overlaps(A.segments(s, d)),
    f"""WITH {SEGMENTS}, g AS (
        SELECT cf, count({_EMP} 1 END) AS e, count({_OVER} 1 END) AS o, count(CASE WHEN arco = 1 THEN 1 END) AS s, coalesce(avg({_EMP} arco END), 0) AS aa, coalesce(max({_EMP} arco END), 0) AS ma,
            CAST(coalesce(sum({_OVER} durata END), 0) AS BIGINT) AS od, CAST(coalesce(sum({_EMP} durata END), 0) AS BIGINT) AS ed, coalesce(avg({_OVER} durata END), 0) AS ad, coalesce(max({_OVER} durata END), 0) AS md,
            count(DISTINCT CASE WHEN arco > 1 AND over_id > 0 THEN over_id END) AS g, coalesce(sum({_EMP} durata * (arco - 1) END), 0) AS x, count(CASE WHEN arco = 0 THEN 1 END) AS u,
            CAST(coalesce(sum(CASE WHEN arco = 0 THEN durata END), 0) AS BIGINT) AS ud FROM segments GROUP BY cf
    ) SELECT cf, e AS total_employment_periods, o AS overlapping_episodes, s AS single_job_periods, round(coalesce(o / nullif(e, 0), 0), 4) AS overlap_frequency, round(aa, 2) AS avg_concurrent_jobs, ma AS max_concurrent_jobs,
        od AS total_overlap_days, ed AS total_employment_days, round(100 * coalesce(od / nullif(ed, 0), 0), 2) AS overlap_intensity_pct, round(ad, 1) AS avg_overlap_duration, md AS max_overlap_duration, g AS unique_over_id_groups,
        round(coalesce(x / nullif(ed, 0), 0), 4) AS employment_complexity_score, u AS total_unemployment_periods, ud AS total_unemployment_days, round(ed / nullif(ud, 0), 2) AS employment_to_unemployment_ratio FROM g""",
)
add(
    "overlap_aggregate",
    lambda s, d: O.aggregate_overlaps(A.segments(s, d)),
    f"""WITH {SEGMENTS}, g AS (
        SELECT count(DISTINCT cf) AS p, count({_EMP} 1 END) AS e, count({_OVER} 1 END) AS o, count(DISTINCT {_OVER} cf END) AS w, avg({_EMP} arco END) AS aa, max(arco) AS ma, sum({_OVER} durata END) AS od,
            sum({_EMP} durata END) AS ed, avg({_OVER} durata END) AS ad, median({_OVER} durata END) AS md, count(DISTINCT CASE WHEN arco > 1 AND over_id > 0 THEN (cf, over_id) END) AS ep,
            count(CASE WHEN arco = 0 THEN 1 END) AS i, sum(CASE WHEN arco = 0 THEN durata END) AS id_ FROM segments
    ) """
    + _metrics({
        "total_persons": "p", "total_employment_periods": "e", "total_overlapping_periods": "o", "persons_with_overlaps": "w", "pct_persons_with_overlaps": "round(100 * w / p, 1)", "overlap_frequency_population": "round(o / e, 4)",
        "avg_employment_intensity": "round(aa, 2)", "max_employment_intensity": "ma", "total_overlap_days": "od", "total_employment_days": "ed", "population_overlap_intensity_pct": "round(100 * od / ed, 2)",
        "avg_overlap_duration": "round(ad, 1)", "median_overlap_duration": "round(md, 1)", "unique_overlap_episodes": "ep", "avg_overlap_episodes_per_person": "round(ep / w, 2)", "total_unemployment_periods": "i",
        "total_unemployment_days": "id_", "employment_to_unemployment_ratio": "round(ed / id_, 2)",
    }, "g"),
)
add("overlap_intensity_breakdown", lambda s, d: O.intensity_breakdown(A.segments(s, d)), f'WITH {SEGMENTS} SELECT arco, count(*) AS "N", round(100 * count(*) / sum(count(*)) OVER (), 1) AS percentage FROM segments WHERE arco >= 1 GROUP BY arco')
add(
    "overlap_duration",
    lambda s, d: O.duration_distribution(A.segments(s, d)),
    f"""WITH {SEGMENTS} SELECT CASE WHEN durata <= 7 THEN '1-7 days' WHEN durata <= 30 THEN '8-30 days' WHEN durata <= 90 THEN '31-90 days' WHEN durata <= 180 THEN '91-180 days' WHEN durata <= 365 THEN '181-365 days'
        ELSE '366+ days' END AS duration_category, CASE WHEN durata <= 7 THEN 1 WHEN durata <= 30 THEN 2 WHEN durata <= 90 THEN 3 WHEN durata <= 180 THEN 4 WHEN durata <= 365 THEN 5 ELSE 6 END AS duration_rank, count(*) AS n_periods, {_DAYS}, min(durata) AS min_duration, max(durata) AS max_duration, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percentage FROM segments WHERE arco > 1 GROUP BY 1, 2""",
)
add(
    "overlap_intensity",
    lambda s, d: O.intensity_distribution(A.segments(s, d)),
    f"""WITH {SEGMENTS} SELECT arco, count(*) AS n_periods, {_DAYS}, count(DISTINCT cf) AS n_persons, count(DISTINCT CASE WHEN over_id > 0 THEN over_id END) AS n_unique_over_id,
        round(100 * count(*) / sum(count(*)) OVER (), 1) AS percentage_of_periods, round(100 * sum(durata) / sum(sum(durata)) OVER (), 1) AS percentage_of_days,
        CASE WHEN arco = 1 THEN 'Single employment' ELSE 'Multiple employment (' || arco || ' jobs)' END AS employment_type FROM segments WHERE arco >= 1 GROUP BY arco""",
)
for by, (key, label) in {
    "month": ("strftime(inizio, '%Y-%m')", "strftime(inizio, '%B %Y')"),
    "quarter": ("strftime(inizio, '%Y') || '-Q' || quarter(inizio)", "'Q' || quarter(inizio) || ' ' || strftime(inizio, '%Y')"),
    "year": ("strftime(inizio, '%Y')", "strftime(inizio, '%Y')"),
}.items():
    add(
        f"overlap_by_{by}",
        lambda s, d, by=by: O.temporal_patterns(A.segments(s, d), by),
        f"""WITH {SEGMENTS} SELECT {key} AS temporal_period, {label} AS temporal_label, count(*) AS n_overlapping_periods, CAST(sum(durata) AS BIGINT) AS total_overlap_days, count(DISTINCT cf) AS n_persons_with_overlaps,
            round(avg(arco), 2) AS avg_concurrent_jobs, max(arco) AS max_concurrent_jobs, round(avg(durata), 1) AS avg_overlap_duration, count(DISTINCT CASE WHEN over_id > 0 THEN over_id END) AS n_unique_over_id_episodes,
            round(100 * count(*) / sum(count(*)) OVER (), 1) AS percentage_of_overlaps, round(100 * sum(durata) / sum(sum(durata)) OVER (), 1) AS percentage_of_overlap_days FROM segments WHERE arco > 1 GROUP BY 1, 2""",
    )
add(
    "overlap_by_group",
    lambda s, d: O.group_comparison(A.grouped_segments(s, d), "area"),
    f"""WITH {SEGMENTS}, g AS (
        SELECT c_mktsegment AS area, count(DISTINCT cf) AS p, count({_EMP} 1 END) AS e, count({_OVER} 1 END) AS o, count(DISTINCT {_OVER} cf END) AS w, avg({_EMP} arco END) AS aa, max(arco) AS ma, sum({_OVER} durata END) AS od,
            sum({_EMP} durata END) AS ed, avg({_OVER} durata END) AS ad, sum(CASE WHEN arco = 0 THEN durata END) AS ud FROM segments JOIN customer ON c_custkey = cf GROUP BY 1
    ), m AS (
        SELECT area, p AS total_persons, e AS total_employment_periods, o AS total_overlapping_periods, w AS persons_with_overlaps, round(100 * w / p, 1) AS pct_persons_with_overlaps, round(o / e, 4) AS overlap_frequency,
            round(aa, 2) AS avg_employment_intensity, ma AS max_employment_intensity, round(100 * od / ed, 2) AS overlap_intensity_pct, round(ad, 1) AS avg_overlap_duration, round(ed / ud, 2) AS employment_to_unemployment_ratio FROM g
    ) SELECT *, CAST(rank() OVER (ORDER BY overlap_frequency DESC) AS INTEGER) AS overlap_frequency_rank, CAST(rank() OVER (ORDER BY overlap_intensity_pct DESC) AS INTEGER) AS overlap_intensity_rank,
        CAST(rank() OVER (ORDER BY pct_persons_with_overlaps DESC) AS INTEGER) AS persons_with_overlaps_rank FROM m""",
)
add(
    "transition_matrix_labels",
    lambda s, d: T.matrix_labels(T.transition_matrix(_edges(s, d)), 20),
    f"""{_GRID}, p AS (SELECT *, round(100 * v / sum(v) OVER (), 1) AS percentage FROM grid)
    SELECT "from", "to", CASE WHEN v >= 20 THEN v END AS value, percentage, CASE WHEN v >= 20 THEN printf('%d (%.1f%%)', CAST(v AS BIGINT), percentage) END AS label FROM p""",
)
add(
    "transition_summary",
    lambda s, d: T.transition_summary(_edges(s, d)),
    f"""WITH {EDGES}, n AS (SELECT count(*) AS n_states FROM (SELECT "from" FROM edges UNION SELECT "to" FROM edges)), t AS (SELECT CAST(sum(weight) AS BIGINT) AS total_transitions, sum(weight * transition_duration) / sum(weight) AS g FROM edges)
    SELECT total_transitions, round(g, 6) AS mean_gap, n_states, round(total_transitions / n_states, 6) AS per_state FROM t, n""",
)
add("consolidation_edge_benefits", lambda s, d: T.consolidation_benefits(_edges(s, d), _merged(s, d)),
    f"""{_BOTH_EDGES}, a AS (SELECT nz AS raw_edges, total AS raw_weight, n AS raw_states FROM raw_one), b AS (SELECT nz AS consolidated_edges, total AS consolidated_weight, n AS consolidated_states FROM cons_one)
    SELECT raw_edges, CAST(raw_weight AS BIGINT) AS raw_weight, raw_states, consolidated_edges, CAST(consolidated_weight AS BIGINT) AS consolidated_weight, consolidated_states, round(100 * (1 - consolidated_edges / raw_edges), 1) AS edges_reduction_pct,
        round(100 * (1 - consolidated_weight / raw_weight), 1) AS weight_reduction_pct, round(100 * (1 - consolidated_states / raw_states), 1) AS states_reduction_pct FROM a, b""")  # fmt: skip
for how, order in {"alphabetical": "node", "frequency": "frequency DESC, node"}.items():
    add(
        f"node_order_{how}",
        lambda s, d, how=how: T.node_order(_edges(s, d), how),
        f"""WITH {EDGES}, e AS (SELECT "from" AS node, weight AS o, 0 AS i FROM edges UNION ALL SELECT "to", 0, weight FROM edges), n AS (SELECT node, CAST(sum(o) + sum(i) AS BIGINT) AS frequency, CAST(sum(o) - sum(i) AS BIGINT) AS root_score FROM e GROUP BY node)
        SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, row_number() OVER (ORDER BY root_score DESC, node) <= greatest(1, ceil(count(*) OVER () * 0.1)) AS is_root FROM n""",
    )
add(
    "node_order_manual",
    lambda s, d: T.node_order(_edges(s, d), "manual", ["5-LOW", "3-MEDIUM"]),
    f"""WITH {EDGES}, e AS (SELECT "from" AS node, weight AS o, 0 AS i FROM edges UNION ALL SELECT "to", 0, weight FROM edges), n AS (SELECT node, CAST(sum(o) + sum(i) AS BIGINT) AS frequency, CAST(sum(o) - sum(i) AS BIGINT) AS root_score FROM e GROUP BY node)
    SELECT *, CAST(row_number() OVER (ORDER BY CASE node WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, node) AS INTEGER) AS place, row_number() OVER (ORDER BY root_score DESC, node) <= greatest(1, ceil(count(*) OVER () * 0.1)) AS is_root FROM n""",
)
add("node_order_cluster", lambda s, d: T.node_order(_edges(s, d), "cluster"))
add(
    "benefits_min_duration",
    lambda s, d: O.consolidation_benefits(S.min_duration(A.segments(s, d), 30)).select("cf", "over_id", "original_segments", "total_duration", "complexity_reduction"),
    f"WITH {SEGMENTS} SELECT cf, over_id, count(*) AS original_segments, CAST(sum(durata) AS BIGINT) AS total_duration, count(*) - 1 AS complexity_reduction FROM segments WHERE (arco = 0 OR durata >= 30) AND over_id > 0 GROUP BY cf, over_id",
)
add(
    "min_duration_counts",
    lambda s, d: S.min_duration(A.segments(s, d), 60).groupBy("stato").agg(F.count("*").alias("n"), F.min("durata").alias("shortest")),
    f"WITH {SEGMENTS} SELECT stato, count(*) AS n, min(durata) AS shortest FROM segments WHERE arco = 0 OR durata >= 60 GROUP BY stato",
)
