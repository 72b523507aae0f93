"""Queries over events, matching, panels, estimates and discontinuities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimation as E
from ..operators import events as V
from ..operators import impact_metrics as I
from ..operators import matching as M
from ..operators import panel as N
from ..operators import rdd as R
from ..sources import adapters as A
from ..sources import writers as W
from .base_sql import CONTRACTS, PERIODS, SEGMENTS
from .registry import add

# --- events ------------------------------------------------------------------------------------------------------------
_CONDITION = "retribuzione > 450000"


def _events(s: SparkSession, d: str, which: str = "first", **k) -> DataFrame:
    return V.treatment_events(A.segments(s, d), [_CONDITION], which, **k)


def _events_sql(which: str, before: bool = False) -> str:
    pick = "max" if which == "last" else "min"
    worked = " AND EXISTS (SELECT 1 FROM segments s WHERE s.cf = c.cf AND s.inizio < c.e AND s.over_id > 0)" if before else ""
    return f"""{SEGMENTS}, chosen AS (SELECT cf, {pick}(inizio) AS e FROM segments WHERE {_CONDITION} GROUP BY cf),
    spans AS (SELECT cf, min(inizio) AS a, max(inizio) AS b FROM segments GROUP BY cf),
    valid AS (SELECT c.cf, e FROM chosen c JOIN spans USING (cf) WHERE e - a >= 90 AND b - e >= 90{worked}),
    ev AS (SELECT s.*, e AS treatment_event_date, coalesce(CASE WHEN e IS NOT NULL THEN '{_CONDITION}' END, 'Control (never treated)') AS treatment_condition_met, e IS NOT NULL AS is_treated, CAST(inizio - e AS DOUBLE) AS days_to_event,
        coalesce(inizio - e BETWEEN -365 AND 365, false) AS in_event_window, coalesce(inizio - e < 0 AND inizio - e >= -365, false) AS pre_event_period, coalesce(inizio - e > 0 AND inizio - e <= 365, false) AS post_event_period
        FROM segments s LEFT JOIN valid v USING (cf))"""


_EV = ["cf", "inizio", "treatment_event_date", "treatment_condition_met", "is_treated", "days_to_event", "in_event_window", "pre_event_period", "post_event_period"]
for which in ("first", "last", "all"):
    add(f"treatment_events_{which}", lambda s, d, which=which: _events(s, d, which).select(*_EV), f"WITH {_events_sql(which)} SELECT {', '.join(_EV)} FROM ev")
add("treatment_events_employed_before", lambda s, d: _events(s, d, employed_before=True).select(*_EV), f"WITH {_events_sql('first', True)} SELECT {', '.join(_EV)} FROM ev")
add(
    "event_windows",
    lambda s, d: _events(s, d).groupBy("is_treated", "in_event_window", "pre_event_period", "post_event_period").agg(F.count("*").alias("n"), F.count_distinct("cf").alias("persons")),
    f"WITH {_events_sql('first')} SELECT is_treated, in_event_window, pre_event_period, post_event_period, count(*) AS n, count(DISTINCT cf) AS persons FROM ev GROUP BY ALL",
)
_SIDE = "avg(CASE WHEN is_treated THEN {0} END) AS treated_mean, avg(CASE WHEN NOT is_treated THEN {0} END) AS control_mean, var_samp(CASE WHEN is_treated THEN {0} END) AS tv, var_samp(CASE WHEN NOT is_treated THEN {0} END) AS cv, count({0}) / count(*) AS completeness"
add(
    "event_quality_balance",
    lambda s, d: V.event_quality(_events(s, d), ["durata", "prior"])["balance"],
    f"WITH {_events_sql('first')}, b AS ("
    + " UNION ALL ".join(f"SELECT '{v}' AS variable, {_SIDE.format(v)} FROM ev" for v in ("durata", "prior"))
    + ") SELECT variable, round(treated_mean, 6) AS treated_mean, round(control_mean, 6) AS control_mean, round(completeness, 6) AS completeness, round((treated_mean - control_mean) / nullif(sqrt((tv + cv) / 2), 0), 6) AS std_mean_diff FROM b",
)
add(
    "event_quality_counts",
    lambda s, d: V.event_quality(_events(s, d), ["durata"])["counts"],
    f"WITH {_events_sql('first')}, p AS (SELECT cf, bool_or(is_treated) AS t FROM ev GROUP BY cf) SELECT count(*) AS n_persons, count(CASE WHEN t THEN 1 END) AS n_treated, count(CASE WHEN NOT t THEN 1 END) AS n_control FROM p",
)
add(
    "event_data_quality",
    lambda s, d: V.data_quality(_events(s, d), ["retribuzione", "prior", "days_to_event"]),
    f"""WITH {_events_sql('first')}, q AS (SELECT count(*) AS n, count(CASE WHEN is_treated THEN 1 END) AS t, count(DISTINCT CASE WHEN is_treated THEN cf END) AS p, count(CASE WHEN treatment_event_date IS NULL THEN 1 END) AS m,
        count(CASE WHEN in_event_window AND days_to_event IS NULL THEN 1 END) AS w, count(retribuzione) + count(prior) + count(days_to_event) AS k FROM ev)
    SELECT n AS n_rows, t AS n_treated_rows, p AS n_treated_persons, round(t / n, 6) AS treatment_rate, round(t / nullif(p, 0), 6) AS events_per_person, m AS missing_event_dates, CAST(0 AS BIGINT) AS missing_treatment,
        w AS invalid_windows, t - p AS duplicate_events, round(k / (3 * n), 6) AS completeness FROM q""",
)
add("control_groups", lambda s, d: V.control_groups(_events(s, d).select("cf", "is_treated")).groupBy("group_assignment").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("n_match_ids")),
    f"WITH {_events_sql('first')}, p AS (SELECT cf, bool_or(is_treated) AS t FROM ev GROUP BY cf), c AS (SELECT count(CASE WHEN t THEN 1 END) AS nt, count(CASE WHEN NOT t THEN 1 END) AS nc FROM p) SELECT unnest(['treatment', 'control']) AS group_assignment, unnest([nt, least(nt, nc)]) AS n, unnest([nt, least(nt, nc)]) AS n_match_ids FROM c")


# --- matching ----------------------------------------------------------------------------------------------------------
def _persons(s: SparkSession, d: str) -> DataFrame:
    """Customers with their orders' figures; treated are those with a negative balance."""
    price = F.sum(F.col("o_totalprice").cast("decimal(28, 10)")).cast("double") / 1000  # a sum that does not depend on the order of rows
    orders = A.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), (price / F.count("o_totalprice")).alias("mean_price"))
    rows = A.table(s, d, "customer").join(orders, "c_custkey")
    return rows.select(F.col("c_custkey").alias("cf"), (F.col("c_acctbal") < 2000).alias("is_treated"), F.col("c_mktsegment").alias("area"), F.col("c_nationkey").alias("nation"), "n_orders", "mean_price")


_PERSONS = """orders_of AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice / 1000) AS mean_price FROM orders GROUP BY 1),
persons AS (SELECT c_custkey AS cf, c_acctbal < 2000 AS is_treated, c_mktsegment AS area, c_nationkey AS nation, n_orders, mean_price FROM customer JOIN orders_of ON o_custkey = c_custkey)"""
for how, (num, txt) in {
    "first": ("arg_min(prior, (inizio, fine))", "arg_min(stato, (inizio, fine))"),
    "last": ("arg_max(prior, (inizio, fine))", "arg_max(stato, (inizio, fine))"),
    "mean": ("avg(prior)", "arg_min(stato, (inizio, fine))"),
    "median": ("median(prior)", "arg_min(stato, (inizio, fine))"),
}.items():
    add(
        f"person_aggregate_{how}",
        lambda s, d, how=how: M.person_level(A.segments(s, d), ["prior", "stato"], how),
        f"WITH {SEGMENTS} SELECT cf, {num if how in ("first", "last") else f"round({num}, 6)"} AS prior, {txt} AS stato, count(*) AS n_rows FROM segments GROUP BY cf",
    )
add(
    "person_aggregate_mode",
    lambda s, d: M.person_level(A.segments(s, d), ["retribuzione", "stato"], "mode"),
    f"""WITH {SEGMENTS}, m AS (SELECT cf, stato, row_number() OVER (PARTITION BY cf ORDER BY count(*) DESC, stato) AS r FROM segments GROUP BY cf, stato)
    SELECT s.cf, round(median(retribuzione), 6) AS retribuzione, any_value(m.stato) AS stato, count(*) AS n_rows FROM segments s JOIN m ON m.cf = s.cf AND r = 1 GROUP BY s.cf""",
)
_STRATA = f"""{_PERSONS}, b AS (SELECT unnest(list_sort(list_distinct(quantile_cont(mean_price, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))) AS x FROM persons),
e AS (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi, row_number() OVER (ORDER BY x) AS k FROM b),
st AS (SELECT p.*, area || '_|_' || 'b' || k AS strata_id FROM persons p JOIN e ON hi IS NOT NULL AND ((mean_price > lo AND mean_price <= hi) OR (k = 1 AND mean_price = lo))),
co AS (SELECT strata_id, CAST(sum(CAST(is_treated AS INTEGER)) AS BIGINT) AS n_treated, CAST(sum(1 - CAST(is_treated AS INTEGER)) AS BIGINT) AS n_control FROM st GROUP BY strata_id)"""
add("cem_strata", lambda s, d: M.strata(_persons(s, d), ["area", "mean_price"]).select("cf", "strata_id", "n_treated", "n_control"), f"WITH {_STRATA} SELECT cf, strata_id, n_treated, n_control FROM st JOIN co USING (strata_id)")
_MATCHED = f"""{_STRATA}, bo AS (SELECT * FROM st JOIN co USING (strata_id) WHERE n_treated > 0 AND n_control > 0),
nu AS (SELECT strata_id, row_number() OVER (ORDER BY strata_id) AS cem_strata FROM (SELECT DISTINCT strata_id FROM bo))"""
add(
    "cem_matched",
    lambda s, d: M.coarsened_exact(_persons(s, d), ["area", "mean_price"], seed=None).select("cf", "is_treated", "cem_strata", "cem_weight"),
    f"""WITH {_MATCHED}, ra AS (SELECT *, row_number() OVER (PARTITION BY strata_id, is_treated ORDER BY cf) AS r FROM bo)
    SELECT cf, is_treated, CAST(cem_strata AS INTEGER) AS cem_strata, CAST(1 AS DOUBLE) AS cem_weight FROM ra JOIN nu USING (strata_id) WHERE r <= CASE WHEN is_treated THEN least(n_treated, n_control) ELSE least(n_control, n_treated) END""",
)
add(
    "cem_weights",
    lambda s, d: M.coarsened_exact(_persons(s, d), ["area", "mean_price"], mode="weights").select("cf", "is_treated", "cem_strata", "cem_weight"),
    f"WITH {_MATCHED} SELECT cf, is_treated, CAST(cem_strata AS INTEGER) AS cem_strata, round(least(n_treated, n_control) / CASE WHEN is_treated THEN n_treated ELSE n_control END, 6) AS cem_weight FROM bo JOIN nu USING (strata_id)",
)


def _numeric_balance(v: str) -> str:
    side = lambda f, t: f"{f}(CASE WHEN {'' if t else 'NOT '}is_treated THEN {v} END)"
    return f"SELECT '{v}' AS variable, {side('avg', 1)} AS tm, {side('avg', 0)} AS cm, {side('var_samp', 1)} AS tv, {side('var_samp', 0)} AS cv, CAST(count(CASE WHEN is_treated THEN 1 END) AS DOUBLE) AS tn, CAST(count(CASE WHEN NOT is_treated THEN 1 END) AS DOUBLE) AS cn FROM persons"


_SHARES = f"""{_PERSONS}, sh AS (SELECT area, count(CASE WHEN is_treated THEN 1 END) / (SELECT count(*) FROM persons WHERE is_treated) AS pt, count(CASE WHEN NOT is_treated THEN 1 END) / (SELECT count(*) FROM persons WHERE NOT is_treated) AS pc FROM persons GROUP BY area)"""
add(
    "balance_numeric",
    lambda s, d: M.balance(_persons(s, d), ["n_orders", "mean_price", "nation"]),
    f"""WITH {_PERSONS}, u AS ({' UNION ALL '.join(map(_numeric_balance, ('n_orders', 'mean_price', 'nation')))}), z AS (SELECT *, (tm - cm) / sqrt((tv + cv) / 2) AS smd, tv / cv AS vr FROM u)
    SELECT variable, 'numeric' AS variable_type, round(tm, 6) AS treated_mean, round(cm, 6) AS control_mean, round(tm - cm, 6) AS mean_diff, round(smd, 6) AS std_mean_diff, round(tv, 6) AS treated_var, round(cv, 6) AS control_var,
        round(vr, 6) AS var_ratio, tn AS treated_n, cn AS control_n, abs(smd) > 0.1 OR vr > 2 OR vr < 0.5 AS balance_concern FROM z""",
)
add(
    "balance_categorical",
    lambda s, d: M.balance(_persons(s, d), ["area"]).select("variable", "variable_type", "std_mean_diff", "treated_n", "control_n", "balance_concern"),
    f"""WITH {_SHARES} SELECT 'area' AS variable, 'categorical' AS variable_type, round(max(abs(pt - pc)), 6) AS std_mean_diff, (SELECT CAST(count(*) AS DOUBLE) FROM persons WHERE is_treated) AS treated_n,
        (SELECT CAST(count(*) AS DOUBLE) FROM persons WHERE NOT is_treated) AS control_n, max(abs(pt - pc)) > 0.1 AS balance_concern FROM sh""",
)
_LABELS = {"n_orders": "Orders", "mean_price": "Mean price (thousands)"}
add(
    "balance_table",
    lambda s, d: W.rounded_table(M.balance(_persons(s, d), ["n_orders", "mean_price", "nation"]).select("variable", "treated_mean", "control_mean", "std_mean_diff", "var_ratio"), 3, _LABELS),
    f"""WITH {_PERSONS}, u AS ({' UNION ALL '.join(map(_numeric_balance, ('n_orders', 'mean_price', 'nation')))})
    SELECT CASE variable WHEN 'n_orders' THEN 'Orders' WHEN 'mean_price' THEN 'Mean price (thousands)' ELSE variable END AS variable, round(tm, 3) AS treated_mean, round(cm, 3) AS control_mean, round((tm - cm) / sqrt((tv + cv) / 2), 3) AS std_mean_diff, round(tv / cv, 3) AS var_ratio FROM u""",
)
add("categorical_shares", lambda s, d: M.categorical_shares(_persons(s, d), "area"), f"WITH {_SHARES} SELECT area AS level, round(pt, 6) AS pt, round(pc, 6) AS pc FROM sh")
add("balance_overall", lambda s, d: M.overall_balance(M.balance(_persons(s, d), ["n_orders", "mean_price", "nation"])),
    f"""WITH {_PERSONS}, u AS ({' UNION ALL '.join(map(_numeric_balance, ('n_orders', 'mean_price', 'nation')))}), z AS (SELECT (tm - cm) / sqrt((tv + cv) / 2) AS smd, tv / cv AS vr FROM u), q AS (SELECT abs(smd) AS a, abs(smd) > 0.1 OR vr > 2 OR vr < 0.5 AS bad FROM z)
    SELECT count(*) AS n_variables, count(CASE WHEN NOT bad THEN 1 END) AS n_balanced, count(CASE WHEN bad THEN 1 END) AS n_imbalanced, round(avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END), 6) AS prop_balanced, round(max(a), 6) AS max_std_diff, round(avg(a), 6) AS mean_abs_std_diff FROM q""")  # fmt: skip
add(
    "ks_statistic",
    lambda s, d: M.ks_statistic(_persons(s, d), "mean_price"),
    f"""WITH {_PERSONS}, k AS (SELECT mean_price AS x, count(CASE WHEN is_treated THEN 1 END) AS a, count(CASE WHEN NOT is_treated THEN 1 END) AS b FROM persons GROUP BY 1),
    c AS (SELECT a, b, abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap FROM k WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)) SELECT round(max(gap), 6) AS statistic, CAST(sum(a) AS BIGINT) AS n_treated, CAST(sum(b) AS BIGINT) AS n_control FROM c""",
)
add(
    "missing_patterns",
    lambda s, d: M.missing_patterns(A.segments(s, d), ["retribuzione", "prior"]),
    f"WITH {SEGMENTS} SELECT CAST(retribuzione IS NULL AS INTEGER) AS retribuzione_missing, CAST(prior IS NULL AS INTEGER) AS prior_missing, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percentage FROM segments GROUP BY 1, 2 ORDER BY n DESC LIMIT 10",
)
add(
    "matching_diagnostics",
    lambda s, d: M.diagnose(_persons(s, d), ["area", "n_orders"]),
    f"WITH {_PERSONS} "
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, count(*) AS n, count(*) - count({v}) AS n_missing, 0 AS n_nan, 0 AS n_infinite, {empty} AS n_empty, (SELECT count(DISTINCT {v}) FROM persons) AS n_levels, (SELECT count(*) FROM (SELECT {v} FROM persons GROUP BY 1 HAVING count(DISTINCT is_treated) = 1)) AS n_one_sided_levels FROM persons"
        for v, empty in (("area", "count(CASE WHEN area = '' THEN 1 END)"), ("n_orders", "0"))
    ),
)
add("propensity_scores", lambda s, d: M.propensity_scores(_persons(s, d), ["area", "n_orders", "mean_price"]).select("cf", "treated", "propensity_score"))
add("propensity_match", lambda s, d: M.propensity_match(_persons(s, d), ["area", "n_orders", "mean_price"]).pairs)
add("l1_imbalance", lambda s, d: s.createDataFrame([(M.l1_imbalance(_persons(s, d), ["area", "mean_price"]),)], "l1 double"),
    f"WITH {_SHARES}, n AS (SELECT abs(avg(CASE WHEN is_treated THEN mean_price END) - avg(CASE WHEN NOT is_treated THEN mean_price END)) / stddev_samp(mean_price) AS v FROM persons) SELECT round(((SELECT sum(abs(pt - pc)) FROM sh) + v) / 2, 6) AS l1 FROM n")


def _quality(s: SparkSession, d: str) -> DataFrame:
    p = _persons(s, d)
    t, c = p.agg(F.count_if("is_treated"), F.count_if(~F.col("is_treated"))).first()
    m = M.coarsened_exact(p, ["area", "mean_price"], seed=None)
    mt, mc = m.agg(F.count_if("is_treated"), F.count_if(~F.col("is_treated"))).first()
    q = M.match_quality(t, c, mt, mc)
    return s.createDataFrame([(q["treatment_retention_rate"], q["control_utilization_rate"], q["effective_sample_size"], q["quality_score"], q["rating"])], "treatment_retention_rate double, control_utilization_rate double, effective_sample_size long, quality_score double, rating string")


add(
    "match_quality",
    _quality,
    f"""WITH {_MATCHED}, ra AS (SELECT *, row_number() OVER (PARTITION BY strata_id, is_treated ORDER BY cf) AS r FROM bo), k AS (SELECT count(*) FILTER (is_treated) AS mt, count(*) FILTER (NOT is_treated) AS mc FROM ra WHERE r <= least(n_treated, n_control)),
    q AS (SELECT mt / count(*) FILTER (is_treated) AS a, mc / count(*) FILTER (NOT is_treated) AS b, mt + mc AS n FROM persons, k GROUP BY mt, mc), z AS (SELECT *, 0.3 * least(1, a) + 0.2 * least(1, b) + 0.25 AS s FROM q)
    SELECT round(a, 6) AS treatment_retention_rate, round(b, 6) AS control_utilization_rate, n AS effective_sample_size, round(s, 6) AS quality_score, CASE WHEN s >= 0.8 THEN 'Excellent' WHEN s >= 0.6 THEN 'Good' WHEN s >= 0.4 THEN 'Fair' ELSE 'Poor' END AS rating FROM z""",
)
_LEVELS = f"""{_PERSONS}, lv AS (SELECT 'area' AS variable, area AS level, is_treated FROM persons UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), is_treated FROM persons UNION ALL SELECT 'n_orders', CAST(n_orders AS VARCHAR), is_treated FROM persons),
ls AS (SELECT variable, level, count(*) FILTER (is_treated) AS n_treated, count(*) FILTER (NOT is_treated) AS n_control FROM lv WHERE level IS NOT NULL GROUP BY variable, level)"""
_LEVEL_VARIABLES = ["area", "nation", "n_orders"]
add("level_sets", lambda s, d: M.level_sets(_persons(s, d), _LEVEL_VARIABLES), f"WITH {_LEVELS} SELECT *, CASE WHEN n_control = 0 THEN 'treated_only' WHEN n_treated = 0 THEN 'control_only' ELSE 'both' END AS side FROM ls")
add(
    "level_set_sizes",
    lambda s, d: M.level_set_sizes(M.level_sets(_persons(s, d), _LEVEL_VARIABLES)),
    f"""WITH {_LEVELS} SELECT variable, count(*) AS n_levels, count(*) FILTER (n_treated > 0) AS n_treated_levels, count(*) FILTER (n_control > 0) AS n_control_levels, count(*) FILTER (n_treated > 0 AND n_control > 0) AS n_shared,
        count(*) FILTER (n_control = 0) AS n_treated_only, count(*) FILTER (n_treated = 0) AS n_control_only FROM ls GROUP BY variable""",
)
_wmean = lambda x, t: f"sum(n_orders * {x}) FILTER ({t}) / sum(n_orders) FILTER ({t})"
_wside = lambda v, t: f"{_wmean(v, t)} AS m, {_wmean(f'{v} * {v}', t)} - ({_wmean(v, t)}) * ({_wmean(v, t)}) AS v"
add(
    "balance_weighted",
    lambda s, d: M.balance(_persons(s, d), ["mean_price", "nation", "area"], weight="n_orders").select("variable", "variable_type", "treated_mean", "control_mean", "std_mean_diff", "var_ratio"),
    f"WITH {_PERSONS}, "
    + ", ".join(f"t_{v} AS (SELECT {_wside(v, 'is_treated')} FROM persons), c_{v} AS (SELECT {_wside(v, 'NOT is_treated')} FROM persons)" for v in ("mean_price", "nation"))
    + ", sw AS (SELECT area, coalesce(sum(n_orders) FILTER (is_treated), 0) / (SELECT sum(n_orders) FROM persons WHERE is_treated) AS pt, coalesce(sum(n_orders) FILTER (NOT is_treated), 0) / (SELECT sum(n_orders) FROM persons WHERE NOT is_treated) AS pc FROM persons GROUP BY area) "
    + " UNION ALL ".join(f"SELECT '{v}' AS variable, 'numeric' AS variable_type, round(t.m, 6) AS treated_mean, round(c.m, 6) AS control_mean, round((t.m - c.m) / sqrt((t.v + c.v) / 2), 6) AS std_mean_diff, round(t.v / c.v, 6) AS var_ratio FROM t_{v} t, c_{v} c" for v in ("mean_price", "nation"))
    + " UNION ALL SELECT 'area', 'categorical', NULL, NULL, round(max(abs(pt - pc)), 6), NULL FROM sw",
)


# --- panels and estimates ------------------------------------------------------------------------------------------------
def _panel(s: SparkSession, d: str) -> DataFrame:
    return N.build_panel(I.stability_metrics(A.period_segments(s, d)).select("cf", "period", "employment_rate", "days_employed"), _persons(s, d).select("cf", "is_treated"))


_RATES = """rt AS (SELECT CAST(cf AS VARCHAR) AS cf, period, coalesce(sum(CASE WHEN over_id > 0 THEN durata END), 0) / sum(durata) AS employment_rate, CAST(coalesce(sum(CASE WHEN over_id > 0 THEN durata END), 0) AS BIGINT) AS days_employed FROM periods GROUP BY cf, period)"""
_PANEL = f"{PERIODS}, {_PERSONS}, {_RATES}, pn AS (SELECT rt.cf, is_treated, period, CAST(period = 'post' AS INTEGER) AS post, employment_rate, days_employed FROM rt JOIN persons p ON CAST(p.cf AS VARCHAR) = rt.cf)"
add("panel", _panel, f"WITH {_PANEL} SELECT cf, is_treated, period, post, round(employment_rate, 6) AS employment_rate, days_employed FROM pn")


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """Segments of treated persons by period, those of the others all as control."""
    rows = A.period_segments(s, d).join(_persons(s, d).select("cf", "is_treated"), "cf")
    return rows.withColumn("period", F.when(F.col("is_treated"), F.col("period")).otherwise("control"))


add(
    "panel_control_expansion",
    lambda s, d: N.build_panel(_mixed(s, d).groupBy("cf", "period").agg(F.sum("durata").alias("days")), _persons(s, d).select("cf", "is_treated")),
    f"""WITH {PERIODS}, {_PERSONS}, m AS (SELECT s.cf, CASE WHEN is_treated THEN period ELSE 'control' END AS period, is_treated, CAST(sum(durata) AS BIGINT) AS days FROM periods s JOIN persons p USING (cf) GROUP BY 1, 2, 3),
    x AS (SELECT * FROM m WHERE period <> 'control' UNION ALL SELECT cf, unnest(['pre', 'post']), is_treated, days FROM m WHERE period = 'control') SELECT CAST(cf AS VARCHAR) AS cf, is_treated, period, CAST(period = 'post' AS INTEGER) AS post, days FROM x""",
)
add(
    "panel_validation",
    lambda s, d: N.validate_panel(_panel(s, d)),
    f"""WITH {_PANEL}, p AS (SELECT cf, bool_or(post = 0) AS a, bool_or(post = 1) AS b, bool_or(is_treated) AS t FROM pn GROUP BY cf)
    SELECT count(*) AS n_persons, count(CASE WHEN t THEN 1 END) AS n_treated, count(CASE WHEN a AND b THEN 1 END) AS n_both_periods, (SELECT count(*) FROM pn) AS n_rows, (SELECT count(DISTINCT (is_treated, post)) FROM pn) AS n_cells, (SELECT count(DISTINCT (is_treated, post)) >= 4 FROM pn) AS did_ready FROM p""",
)
_CELL = "avg(CASE WHEN is_treated = {0} AND post = {1} THEN employment_rate END)"
add(
    "did_means",
    lambda s, d: E.did_means(_panel(s, d), "employment_rate"),
    f"""WITH {_PANEL}, c AS (SELECT {_CELL.format('true', 0)} AS a, {_CELL.format('true', 1)} AS b, {_CELL.format('false', 0)} AS x, {_CELL.format('false', 1)} AS y FROM pn)
    SELECT round(a, 6) AS treated_pre, round(b, 6) AS treated_post, round(x, 6) AS control_pre, round(y, 6) AS control_post, round(b - a - y + x, 6) AS did FROM c""",
)
_DID = "outcome string, treatment_effect double, std_error double, t_statistic double, p_value double, conf_lower double, conf_upper double, significant boolean, n_obs long, r_squared double, error string"


def _balanced(s: SparkSession, d: str) -> DataFrame:
    p = _panel(s, d)
    return p.join(p.groupBy("cf").agg(F.count("*").alias("n")).where("n = 2").select("cf"), "cf")


def _rows(s: SparkSession, found: list[dict], schema: str) -> DataFrame:
    return s.createDataFrame([tuple(f.values()) for f in found], schema)


add(
    "did_effect_balanced",
    lambda s, d: _rows(s, E.difference_in_differences(_balanced(s, d), ["employment_rate"]), _DID).select("outcome", "treatment_effect", "n_obs"),
    f"""WITH {_PANEL}, ok AS (SELECT * FROM pn WHERE cf IN (SELECT cf FROM pn GROUP BY cf HAVING count(*) = 2)), c AS (SELECT {_CELL.format('true', 0)} AS a, {_CELL.format('true', 1)} AS b, {_CELL.format('false', 0)} AS x, {_CELL.format('false', 1)} AS y, count(*) AS n FROM ok)
    SELECT 'employment_rate' AS outcome, round(b - a - y + x, 6) AS treatment_effect, n AS n_obs FROM c""",
)
add("did_effects", lambda s, d: _rows(s, E.difference_in_differences(_panel(s, d), ["employment_rate", "days_employed"], cluster=True), _DID))


def _study_rows(s: SparkSession, d: str) -> DataFrame:
    """Treated and control segments around 1998: everyone's event time counts from that date."""
    rows = A.segments(s, d).join(_persons(s, d).select("cf", "is_treated"), "cf")
    rows = rows.withColumn("days_to_event", F.datediff("inizio", F.lit("1998-01-01").cast("date")))
    return E.event_bins(rows.where(F.abs("days_to_event") < 400).withColumn("days_to_event", F.col("days_to_event") / 4), "month", (-3, 3))


add("event_study_effects", lambda s, d: _rows(s, E.event_study(_study_rows(s, d), ["durata"]), "outcome string, event_time int, coefficient double, std_error double, t_statistic double, p_value double, conf_lower double, conf_upper double"))


def _two_way(s: SparkSession, d: str) -> DataFrame:
    """Days of a segment on concurrent jobs, part-time and treatment from 1996, with effects of persons and of the months segments begin in."""
    rows = A.segments(s, d).where("arco > 0").join(_persons(s, d).select("cf", "is_treated"), "cf").withColumn("month", F.date_trunc("month", "inizio").cast("date"))
    x = {"jobs": F.col("arco"), "part_time": (F.col("prior") < 1).cast("int"), "treated_late": (F.col("is_treated") & (F.col("inizio") >= "1996-01-01")).cast("int")}
    fit = E.two_way_fit(rows, "durata", x, "cf", "month")
    return s.createDataFrame([(n, *fit.row(n), fit.n) for n in fit.names], "regressor string, coefficient double, std_error double, n_obs long")


add("two_way_effects", _two_way)


def _effects(s: SparkSession, d: str) -> DataFrame:
    """The difference in mean order price between urgent and other orders, by market segment, with its error and p-value class."""
    rows = A.table(s, d, "orders").join(A.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = F.col("o_orderpriority") == "1-URGENT"
    x = F.col("o_totalprice") / 1000
    one = rows.groupBy(F.col("c_mktsegment").alias("outcome")).agg((F.avg(F.when(t, x)) - F.avg(F.when(~t, x))).alias("treatment_effect"), F.sqrt(F.var_samp(F.when(t, x)) / F.count_if(t) + F.var_samp(F.when(~t, x)) / F.count_if(~t)).alias("std_error"), F.count("*").alias("n_obs"))
    z = F.abs(F.col("treatment_effect") / F.col("std_error"))
    return one.select("outcome", F.lit("did").alias("method"), "treatment_effect", "std_error", F.exp(-0.717 * z - 0.416 * z * z).alias("p_value"), "n_obs")  # a closed form close to the normal tail, which SQL has not


_EFFECTS = """ef AS (SELECT outcome, 'did' AS method, e AS treatment_effect, se AS std_error, exp(-0.717 * abs(e / se) - 0.416 * (e / se) * (e / se)) AS p_value, n AS n_obs FROM (
    SELECT c_mktsegment AS outcome, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 1000 END) - avg(CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice / 1000 END) AS e,
        sqrt(var_samp(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 1000 END) / count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) + var_samp(CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice / 1000 END) / count(CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 END)) AS se,
        count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1))"""


def _study(s: SparkSession, d: str) -> DataFrame:
    """A path of effects by market segment: the difference in mean order price between urgent and other orders of each year from 1995."""
    rows = A.table(s, d, "orders").join(A.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t, x = F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 1000
    effect = F.avg(F.when(t, x)) - F.avg(F.when(~t, x))
    error = F.sqrt(F.var_samp(F.when(t, x)) / F.count_if(t) + F.var_samp(F.when(~t, x)) / F.count_if(~t))
    return rows.groupBy(F.col("c_mktsegment").alias("outcome"), (F.year("o_orderdate") - 1995).alias("event_time")).agg(effect.alias("coefficient"), error.alias("std_error"))


def _study_effects(s: SparkSession, d: str) -> DataFrame:
    return E.effects_of(s, study=[r.asDict() for r in _study(s, d).collect()])  # an outcome and event time a row


_price = lambda u: f"CASE WHEN o_orderpriority {'=' if u else '<>'} '1-URGENT' THEN o_totalprice / 1000 END"
_STUDY = f"""st AS (SELECT c_mktsegment AS outcome, year(CAST(o_orderdate AS DATE)) - 1995 AS event_time, avg({_price(1)}) - avg({_price(0)}) AS coefficient, sqrt(var_samp({_price(1)}) / count({_price(1)}) + var_samp({_price(0)}) / count({_price(0)})) AS std_error
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
ev AS (SELECT 'event_study_' || outcome AS effect_id, outcome, 'Event Study' AS method, avg(coefficient) AS treatment_effect, sqrt(avg(std_error * std_error)) AS std_error FROM st WHERE event_time > 0 GROUP BY outcome)"""
add("event_study_pooled_effects", lambda s, d: _study_effects(s, d).drop("p_value", "n_obs"), f"WITH {_STUDY} SELECT effect_id, outcome, method, round(treatment_effect, 6) AS treatment_effect, round(std_error, 6) AS std_error FROM ev")
add(
    "pool_event_study",
    lambda s, d: E.pool(_study_effects(s, d), "weighted_average").select("pooled_effect", "pooled_se", "n_effects", "methods_used", "total_weight"),
    f"WITH {_STUDY} SELECT round(sum(treatment_effect / (std_error * std_error)) / sum(1 / (std_error * std_error)), 6) AS pooled_effect, round(sqrt(1 / sum(1 / (std_error * std_error))), 6) AS pooled_se, count(*) AS n_effects, 'Event Study' AS methods_used, round(sum(1 / (std_error * std_error)), 6) AS total_weight FROM ev",
)
for method, formula in {
    "bonferroni": "least(1, p_value * count(*) OVER ())",
    "holm": "least(1, max((count(*) OVER () - r + 1) * p_value) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING))",
    "fdr": "least(1, min(count(*) OVER () * p_value / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
}.items():
    split = f"rk AS (SELECT *, row_number() OVER (ORDER BY p_value, outcome) AS r, count(*) OVER () AS m FROM ef) SELECT outcome, round(p_value, 6) AS p_value, round({formula.replace('count(*) OVER ()', 'm')}, 6) AS adjusted_p_value FROM rk"
    add(f"p_adjust_{method}", lambda s, d, method=method: E.adjust_p(_effects(s, d), method).select("outcome", "p_value", "adjusted_p_value"), f"WITH {_EFFECTS}, {split}")
_Z = 1.959963984540054
_TAIL = f"round(pe, 6) AS pooled_effect, round(ps, 6) AS pooled_se, n AS n_effects, 'did' AS methods_used, round(pe / ps, 6) AS z_statistic, round(pe - {_Z} * ps, 6) AS overall_conf_lower, round(pe + {_Z} * ps, 6) AS overall_conf_upper"
add("pool_simple", lambda s, d: E.pool(_effects(s, d), "simple_average"), f"WITH {_EFFECTS}, a AS (SELECT avg(treatment_effect) AS pe, sqrt(avg(std_error * std_error)) AS ps, count(*) AS n FROM ef) SELECT {_TAIL} FROM a")
add(
    "pool_fixed",
    lambda s, d: E.pool(_effects(s, d), "weighted_average"),
    f"WITH {_EFFECTS}, a AS (SELECT sum(treatment_effect / (std_error * std_error)) / sum(1 / (std_error * std_error)) AS pe, sqrt(1 / sum(1 / (std_error * std_error))) AS ps, count(*) AS n, sum(1 / (std_error * std_error)) AS w FROM ef) SELECT {_TAIL}, round(w, 6) AS total_weight FROM a",
)
add(
    "pool_random_effects",
    lambda s, d: E.pool(_effects(s, d), "meta_analysis"),
    f"""WITH {_EFFECTS}, w AS (SELECT treatment_effect AS e, 1 / (std_error * std_error) AS w FROM ef), f AS (SELECT sum(w) AS sw, sum(w * w) AS sww, sum(w * e) / sum(w) AS m FROM w),
    q AS (SELECT sum(w * (e - m) * (e - m)) AS q, count(*) AS n, any_value(sw) AS sw, any_value(sww) AS sww FROM w, f), t AS (SELECT q, greatest(0, (q - (n - 1)) / (sw - sww / sw)) AS tau, 100 * greatest(0, (q - (n - 1)) / q) AS i2 FROM q),
    a AS (SELECT sum(e / (1 / w + tau)) / sum(1 / (1 / w + tau)) AS pe, sqrt(1 / sum(1 / (1 / w + tau))) AS ps, count(*) AS n, any_value(q) AS q, any_value(tau) AS tau, any_value(i2) AS i2 FROM w, t)
    SELECT {_TAIL}, round(q, 6) AS q_statistic, round(tau, 6) AS tau_squared, round(i2, 6) AS i_squared FROM a""",
)
add("effect_heterogeneity", lambda s, d: s.createDataFrame([E.heterogeneity(_effects(s, d))]).select("q_statistic", F.col("df").cast("long").alias("df"), "i_squared"),
    f"""WITH {_EFFECTS}, w AS (SELECT treatment_effect AS e, 1 / (std_error * std_error) AS w FROM ef), f AS (SELECT sum(w * e) / sum(w) AS m FROM w), q AS (SELECT sum(w * (e - m) * (e - m)) AS q, count(*) AS n FROM w, f)
    SELECT round(q, 6) AS q_statistic, n - 1 AS df, round(100 * greatest(0, (q - (n - 1)) / q), 6) AS i_squared FROM q""")  # fmt: skip
add("synthetic_control_weights", lambda s, d: s.createDataFrame(E.synthetic_control(A.grouped_segments(s, d).withColumn("year", F.year("inizio")), "durata", "area", "year", "BUILDING", 1999)[0], "donor string, weight double"))


# --- discontinuities -----------------------------------------------------------------------------------------------------
_lines = lambda s, d: R.centred(A.table(s, d, "lineitem"), "l_quantity", 25.0, "l_extendedprice")
_X = "x AS (SELECT *, l_quantity - 25.0 AS x FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)"
for method, factor in {"rot": 1.0, "mserd": 0.8, "cerrd": 1.2}.items():
    add(f"rdd_bandwidth_{method}", lambda s, d, method=method: R.bandwidth(_lines(s, d), method), f"WITH {_X} SELECT round({factor} * 1.84 * stddev_samp(x) * pow(count(x), -0.2), 6) AS bandwidth, count(x) AS n FROM x")
add(
    "rdd_bins",
    lambda s, d: R.bins(_lines(s, d), "l_extendedprice", 4.0).select("bin", "mean", "se", "n", "side"),
    f"""WITH {_X}, b AS (SELECT floor(x / 4.0 + 0.5) * 4.0 AS bin, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) / sqrt(count(*)) AS se, count(*) AS n FROM x GROUP BY 1)
    SELECT bin, round(m, 6) AS mean, round(se, 6) AS se, n, CASE WHEN bin >= 0 THEN 'right' ELSE 'left' END AS side FROM b WHERE n >= 3""",
)
add("rdd_density_counts", lambda s, d: R.density_counts(_lines(s, d), 5.0), f"WITH {_X} SELECT count(CASE WHEN x < 0 AND x >= -10 THEN 1 END) AS n_left, count(CASE WHEN x >= 0 AND x <= 10 THEN 1 END) AS n_right, count(x) AS n FROM x")
add("rdd_histogram", lambda s, d: R.histogram(_lines(s, d), 10),
    f"""WITH {_X}, r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 10 AS w FROM x), k AS (SELECT CAST(least(10, greatest(1, ceil((x - lo) / w))) AS INTEGER) AS bin, lo, w FROM x, r)
    SELECT bin, round(any_value(lo) + (bin - 0.5) * any_value(w), 6) AS mid, count(*) AS n, CASE WHEN any_value(lo) + (bin - 0.5) * any_value(w) < 0 THEN 'left' ELSE 'right' END AS side FROM k GROUP BY bin""")  # fmt: skip
_side = lambda c: f"(regr_intercept(l_extendedprice, x) FILTER ({c}))"
add(
    "rdd_jump_linear",
    lambda s, d: s.createDataFrame([(R.sharp(A.table(s, d, "lineitem"), "l_extendedprice", "l_quantity", 25.0, kernel="rectangular", h=10.0)["estimate"],)], "estimate double").withColumn("estimate", F.round("estimate", 3)),
    f"WITH {_X} SELECT round({_side('x >= 0')} - {_side('x < 0')}, 3) AS estimate FROM x WHERE abs(x) <= 10",
)


def _table(s: SparkSession, rows: list[dict], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]
    return s.createDataFrame([tuple(r[n] for n in names) for r in rows], columns)


_EST = "estimate double, std_error double, t_statistic double, p_value double, ci_lower double, ci_upper double, bandwidth double"


def _line_sql(h: str, kernel: str, centre: str = "0.0") -> str:
    """The jump of two weighted lines, one a side, within h of a centre: with weights in the distance, from weighted sums."""
    x = f"(x - ({centre}))"
    w = {"triangular": f"greatest(0.0, 1 - abs({x}) / ({h}))", "rectangular": "1.0", "epanechnikov": f"greatest(0.0, 0.75 * (1 - ({x} / ({h})) * ({x} / ({h}))))"}[kernel]
    end = lambda side: f"(SELECT (sum(w * x * x) * sum(w * y) - sum(w * x) * sum(w * x * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) FROM (SELECT {x} AS x, l_extendedprice / 1000 AS y, {w} AS w FROM x, h WHERE abs({x}) <= {h}) WHERE {side})"
    return f"({end('x >= 0')} - {end('x < 0')})"


_H = f"{_X}, h AS (SELECT 0.8 * 1.84 * stddev_samp(x) * pow(count(x), -0.2) AS h FROM x)"
_thousands = lambda s, d: A.table(s, d, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") / 1000)
_EST4 = lambda df: df.withColumn("estimate", F.round("estimate", 4))
add(
    "rdd_grid",
    lambda s, d: _EST4(_table(s, R.robustness(_thousands(s, d), "l_extendedprice", "l_quantity", 25.0, (1.0, 1.5, 2.0, 3.0), (1,)), "check string, value string, estimate double, bandwidth double")),
    f"WITH {_H} "
    + " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", '{value}' AS value, round({_line_sql(f'h * {m}', kernel)}, 4) AS estimate, round(h * {m}, 6) AS bandwidth FROM h"
        for check, value, kernel, m in [*[("bandwidth", m, "triangular", m) for m in (1.0, 1.5, 2.0, 3.0)], ("order", 1, "triangular", 1.0), *[("kernel", k, k, 1.0) for k in R.KERNELS]]
    ),
)
add(
    "rdd_placebo_grid",
    lambda s, d: _EST4(_table(s, R.placebo(_thousands(s, d), "l_extendedprice", "l_quantity", 25.0, [12.0, 15.0, 35.0, 40.0]), "cutoff double, estimate double, bandwidth double")),
    f"WITH {_H} " + " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS cutoff, round({_line_sql('h', 'triangular', f'{c - 25.0}')}, 4) AS estimate, round(h, 6) AS bandwidth FROM h" for c in (12.0, 15.0, 35.0, 40.0)),
)
add("rdd_estimate", lambda s, d: _table(s, [R.sharp(A.table(s, d, "lineitem"), "l_extendedprice", "l_quantity", 25.0)], _EST))
add("rdd_fuzzy", lambda s, d: _table(s, [R.fuzzy(A.table(s, d, "lineitem").withColumn("t", ((F.col("l_quantity") >= 25) & (F.col("l_orderkey") % 4 > 0)).cast("int")), "l_extendedprice", "t", "l_quantity", 25.0)], _EST))
add("rdd_robustness", lambda s, d: _table(s, R.robustness(A.table(s, d, "lineitem"), "l_extendedprice", "l_quantity", 25.0, (0.75, 1.25), (1, 2)), f"check string, value string, {_EST}"))
add("rdd_placebo", lambda s, d: _table(s, R.placebo(A.table(s, d, "lineitem"), "l_extendedprice", "l_quantity", 25.0, [15.0, 35.0]), f"cutoff double, {_EST}"))
add("rdd_density_test", lambda s, d: _table(s, [R.density_test(_lines(s, d))], "method string, bin_size double, density_left double, density_right double, test_statistic double, p_value double, log_density_jump double"))
add(
    "rdd_density_jump",
    lambda s, d: _table(s, [R.density_test(_lines(s, d))], "bin_size double, density_left double, density_right double, log_density_jump double, test_statistic double"),
    f"""WITH {_X}, b AS (SELECT 2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) * pow(count(x), -1.0 / 3) AS w, count(x) AS n FROM x), k AS (SELECT w, n, count(*) FILTER (x < 0 AND x >= -2 * w) AS l, count(*) FILTER (x >= 0 AND x <= 2 * w) AS r FROM x, b GROUP BY w, n)
    SELECT round(w, 6) AS bin_size, round(l / (2 * w * n), 6) AS density_left, round(r / (2 * w * n), 6) AS density_right, round(ln(r / l), 6) AS log_density_jump, round(ln(r / l) / sqrt(1 / l + 1 / r), 6) AS test_statistic FROM k""",
)
add("imputed_means", lambda s, d: M.impute(A.segments(s, d).select("cf", "prior", "retribuzione", "stato"), ["prior"], "median").groupBy("stato").agg(F.avg("prior").alias("mean_prior"), F.count("prior").alias("n")),
    f"WITH {SEGMENTS}, m AS (SELECT median(prior) AS m FROM segments) SELECT stato, round(avg(coalesce(CAST(prior AS DOUBLE), m)), 6) AS mean_prior, count(*) AS n FROM segments, m GROUP BY stato")
add("missing_correlation", lambda s, d: M.missing_correlation(A.segments(s, d), ["retribuzione", "prior"]),
    f"WITH {SEGMENTS} SELECT 'retribuzione' AS a, 'prior' AS b, round(corr(CAST(retribuzione IS NULL AS DOUBLE), CAST(prior IS NULL AS DOUBLE)), 6) AS correlation FROM segments")
_SMD = "SELECT '{0}' AS variable, '{2}' AS sample, abs((avg({0}) FILTER (is_treated) - avg({0}) FILTER (NOT is_treated)) / sqrt((var_samp({0}) FILTER (is_treated) + var_samp({0}) FILTER (NOT is_treated)) / 2)) AS d FROM {1}"
add(
    "love_plot",
    lambda s, d: M.love_plot(M.balance(_persons(s, d), ["n_orders", "mean_price"]), M.balance(M.coarsened_exact(_persons(s, d), ["area", "mean_price"], seed=None), ["n_orders", "mean_price"])),
    f"""WITH {_MATCHED}, ra AS (SELECT *, row_number() OVER (PARTITION BY strata_id, is_treated ORDER BY cf) AS r FROM bo), kept AS (SELECT * FROM ra WHERE r <= least(n_treated, n_control)),
    u AS ({" UNION ALL ".join(_SMD.format(v, t, n) for t, n in (("persons", "before"), ("kept", "after")) for v in ("n_orders", "mean_price"))}) SELECT variable, sample, round(d, 6) AS abs_std_diff FROM u""",
)
_MEANS = "SELECT '{0}' AS outcome, is_treated, period, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS sd, count({0}) AS n FROM pn GROUP BY 2, 3"
add("group_means", lambda s, d: E.group_means(_panel(s, d), ["employment_rate", "days_employed"]), f"WITH {_PANEL} {_MEANS.format('employment_rate')} UNION ALL {_MEANS.format('days_employed')}")
