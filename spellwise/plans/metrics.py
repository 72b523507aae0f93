"""Queries over survival, careers and period metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import career as R
from ..operators import impact_metrics as I
from ..operators import plotdata as P
from ..operators import survival as V
from ..sources import adapters as A
from .base_sql import CONTRACTS, PERIODS, SEGMENTS
from .registry import add, rounded

_timed = lambda s, d: V.with_durations(A.contracts(s, d))
_km = lambda s, d: V.kaplan_meier(_timed(s, d))
_grid = lambda s: s.createDataFrame([(t,) for t in (0, 31, 60, 90, 119, 400)], "time int")


def _km_sql(group: str, source: str, name: str) -> str:
    """The survival table of `source` by `group`."""
    return f"""{name}_m AS (
        SELECT {group} AS g, t AS time, count(*) AS m, CAST(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS d FROM {source} GROUP BY 1, 2
    ), {name}_n AS (
        SELECT *, CAST(sum(m) OVER (PARTITION BY g ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM {name}_m
    ), {name}_s AS (
        SELECT g, time, n, d, max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w AS gone, sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w AS ls,
            sum(CASE WHEN d < n THEN d / (n * CAST(n - d AS DOUBLE)) ELSE 0 END) OVER w AS v
        FROM {name}_n WINDOW w AS (PARTITION BY g ORDER BY time ROWS UNBOUNDED PRECEDING)
    ), {name} AS (
        SELECT g, time, n, d, CASE WHEN gone = 1 THEN 0.0 ELSE exp(ls) END AS s, CASE WHEN gone = 0 THEN sqrt(v) END AS se FROM {name}_s
    ), {name}_ci AS (
        SELECT *, CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-1.959963984540054 * se / ln(s))) END AS lo, CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.959963984540054 * se / ln(s))) END AS hi FROM {name}
    )"""


_TIMED = f"""WITH {CONTRACTS}, timed AS (
    SELECT contract_type, CAST(fine - inizio + 1 AS INTEGER) AS t, CASE WHEN fine = (SELECT max(fine) FROM contracts) THEN 1 ELSE 0 END AS c, cf, id FROM contracts
)"""
_KM = f"{_TIMED}, {_km_sql('contract_type', 'timed', 'km')}"
add(
    "km_curve",
    _km,
    f"{_KM} SELECT g AS contract_type, time, n AS n_risk, d AS n_event, round(s, 6) AS survival_prob, round(se, 6) AS std_error, round(lo, 6) AS lower_ci, round(hi, 6) AS upper_ci FROM km_ci",
)
_MEDIAN = """ev AS (SELECT *, lead(time) OVER (PARTITION BY g ORDER BY time) AS nt FROM km_ci WHERE d > 0),
    hit AS (SELECT g, min(CASE WHEN s <= 0.5 + 1e-9 THEN time END) AS t, min(CASE WHEN lo <= 0.5 + 1e-9 THEN time END) AS l, min(CASE WHEN hi <= 0.5 + 1e-9 THEN time END) AS u FROM ev GROUP BY g),
    med AS (SELECT hit.g, CAST(CASE WHEN abs(s - 0.5) <= 1e-9 AND nt IS NOT NULL THEN (time + nt) / 2 ELSE time END AS DOUBLE) AS m, CAST(l AS DOUBLE) AS l, CAST(u AS DOUBLE) AS u FROM hit LEFT JOIN ev ON ev.g = hit.g AND ev.time = hit.t)"""
add("km_median", lambda s, d: V.median_survival(_km(s, d)), f"{_KM}, {_MEDIAN} SELECT g AS contract_type, m AS median_survival, l AS median_ci_lower, u AS median_ci_upper FROM med")
add(
    "survival_attached",
    lambda s, d: V.add_survival(A.contracts(s, d)).select("id", "survival_time", "censored", "contract_type_median", "survival_prob"),
    f"{_KM}, {_MEDIAN} SELECT id, t AS survival_time, c AS censored, m AS contract_type_median, round(s, 6) AS survival_prob FROM timed JOIN km ON km.g = contract_type AND km.time = t JOIN med ON med.g = contract_type",
)
_AT = "grid(x) AS (VALUES (0), (31), (60), (90), (119), (400)), wanted AS (SELECT DISTINCT g, x FROM km CROSS JOIN grid)"
add(
    "survival_lookup",
    lambda s, d: V.survival_at(_km(s, d), _grid(s)),
    f"{_KM}, {_AT} SELECT w.g AS contract_type, x AS time, round(coalesce(arg_max(s, time), 1.0), 6) AS survival_prob FROM wanted w LEFT JOIN km ON km.g = w.g AND time <= x GROUP BY w.g, x",
)
add(
    "risk_table",
    lambda s, d: V.risk_table(_km(s, d), _grid(s)),
    f"{_KM}, {_AT} SELECT w.g AS contract_type, x AS time, arg_max(n, time) AS n_risk FROM wanted w LEFT JOIN km ON km.g = w.g AND time <= x GROUP BY w.g, x",
)
_CUTS = ("1994-06-30", "1996-06-30", "1998-12-31")


def _elapsed(s, d):
    """Contracts begun by a cut date, with the days elapsed until then."""
    cuts = F.explode(F.array(*[F.lit(c).cast("date") for c in _CUTS]))
    rows = A.contracts(s, d).select("id", "contract_type", "inizio", cuts.alias("cut_date")).where("cut_date >= inizio")
    return rows.select("id", "contract_type", "cut_date", (F.datediff("cut_date", "inizio") + 1).alias("survival_time"))


add(
    "survival_asof",
    lambda s, d: V.survival_as_of(_elapsed(s, d), _km(s, d)).select("id", "cut_date", "survival_time", "survival_prob"),
    f"""{_KM}, cuts(c) AS (VALUES {", ".join(f"(DATE '{c}')" for c in _CUTS)}), el AS (SELECT id, contract_type, c AS cut_date, CAST(c - inizio + 1 AS INTEGER) AS survival_time FROM contracts CROSS JOIN cuts WHERE c >= inizio)
    SELECT id, cut_date, survival_time, round(coalesce(s, 1.0), 6) AS survival_prob FROM el ASOF LEFT JOIN km ON km.g = contract_type AND survival_time >= time""",
)
add(
    "logrank_pairs",
    lambda s, d: V.pairwise_components(_timed(s, d)),
    f"""{_KM}, gs AS (SELECT DISTINCT g FROM km_m), pr AS (SELECT least(m.g, gs.g) AS a, greatest(m.g, gs.g) AS b, time, CAST(sum(CASE WHEN m.g < gs.g THEN m ELSE 0 END) AS BIGINT) AS ma, CAST(sum(m) AS BIGINT) AS m, CAST(sum(CASE WHEN m.g < gs.g THEN d ELSE 0 END) AS BIGINT) AS ea, CAST(sum(d) AS BIGINT) AS d
        FROM km_m m JOIN gs ON gs.g <> m.g GROUP BY 1, 2, 3),
    rk AS (SELECT *, sum(ma) OVER w AS na, sum(m) OVER w AS n FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
    sm AS (SELECT a, b, CAST(sum(ea) AS BIGINT) AS o, sum(d * na / n) AS e, sum(CASE WHEN n > 1 THEN d * (na / n) * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM rk WHERE d > 0 GROUP BY a, b)
    SELECT a AS group_a, b AS group_b, o AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round((o - e) * (o - e) / nullif(v, 0), 6) AS chi_square FROM sm""",
)
for rho in (0, 1):
    add(
        f"logrank_components_rho{rho}",
        lambda s, d, rho=rho: V.logrank_components(_timed(s, d), float(rho)),
        f"""{_KM}, {_km_sql("'all'", 'timed', 'po')}, pt AS (SELECT time, n, d, pow(coalesce(lag(s) OVER (ORDER BY time), 1.0), {rho}) AS w FROM po),
        gt AS (SELECT DISTINCT km.g, pt.time FROM km CROSS JOIN pt WHERE pt.d > 0),
        og AS (SELECT gt.g, gt.time, coalesce(arg_min(km.n, km.time), 0) AS ng, coalesce(max(CASE WHEN km.time = gt.time THEN km.d END), 0) AS dg FROM gt LEFT JOIN km ON km.g = gt.g AND km.time >= gt.time GROUP BY gt.g, gt.time)
        SELECT g AS contract_type, round(sum(w * dg), 6) AS observed, round(sum(w * pt.d * ng / pt.n), 6) AS expected FROM og JOIN pt USING (time) GROUP BY g""",
    )
add(
    "survival_steps",
    lambda s, d: P.survival_steps(_km(s, d)),
    f"""{_KM}, r AS (
        SELECT g, time, s, lo, hi, d FROM km_ci UNION ALL SELECT DISTINCT g, 0, 1.0, 1.0, 1.0, 1 FROM km
    ) SELECT g AS contract_type, CAST(time AS INTEGER) AS time, round(s, 6) AS survival_prob, round(lo, 6) AS lower_ci, round(hi, 6) AS upper_ci, CAST(lead(time) OVER (PARTITION BY g ORDER BY time) AS INTEGER) AS next_time, d = 0 AS censor_mark FROM r""",
)


def _logrank(s, d):
    rows = _timed(s, d)
    tests = [V.logrank_test(rows, rho) for rho in (0.0, 1.0)]
    return s.createDataFrame([(t.rho, t.chi_square, t.df, t.p_value) for t in tests], "rho double, chi_square double, df int, p_value double")


add("logrank_tests", _logrank)
add("logrank_pairwise", lambda s, d: s.createDataFrame(V.pairwise_logrank(_timed(s, d)), "group_a string, group_b string, p_value double"))


# --- careers ---------------------------------------------------------------------------------------------------------
def _success_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""valid AS (SELECT * FROM {source} WHERE over_id > 0 AND durata >= 1),
    med AS (SELECT ct, median(durata) AS m FROM valid WHERE ct IS NOT NULL GROUP BY ct),
    sc AS (SELECT ct AS qct, CASE WHEN (SELECT max(m) > min(m) FROM med) THEN 0.1 + 0.9 * (m - (SELECT min(m) FROM med)) / (SELECT max(m) - min(m) FROM med) ELSE 0.5 END AS quality FROM med),
    r0 AS (SELECT v.*, coalesce(quality, 0.5) AS q, CASE WHEN prior IS NULL THEN 0.5 ELSE greatest(0, least(1, prior / 3)) END AS i FROM valid v LEFT JOIN sc ON qct = ct),
    r AS (SELECT *, CASE WHEN q > lag(q) OVER w * 1.05 THEN 1 ELSE 0 END + CASE WHEN i > lag(i) OVER w * 1.05 THEN 1 ELSE 0 END AS better FROM r0 WINDOW w AS (PARTITION BY {keys} ORDER BY inizio, fine)),
    ty AS (SELECT {keys}, ct, sum(durata) AS dd FROM r GROUP BY {keys}, ct),
    tp AS (SELECT {keys}, dd / sum(dd) OVER (PARTITION BY {keys}) AS p FROM ty),
    en AS (SELECT {keys}, count(*) AS k, sum(-p * ln(p + 1e-10)) AS h FROM tp GROUP BY {keys}),
    su AS (SELECT {keys}, count(*) AS n, CAST(sum(durata) AS BIGINT) AS days, sum(q * durata) / sum(durata) AS q, sum(i * durata) / sum(durata) AS i, avg(durata) AS mean, var_samp(durata) AS var,
        coalesce(sum(CASE WHEN q > 0.7 THEN durata END), 0) / sum(durata) AS high, sum(better) AS better FROM r GROUP BY {keys}),
    f0 AS (SELECT a.*, CASE WHEN n > 1 THEN greatest(0, least(1, 1 - least(1, var / mean / 2))) ELSE 0.5 END AS s, greatest(0, least(1, 0.6 * high + 0.4 * CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END)) AS g FROM su a JOIN en b ON {on}),
    success AS (SELECT {keys}, days AS total_employment_days, round(q, 6) AS contract_quality_score, round(i, 6) AS employment_intensity_score, round(s, 6) AS career_stability_score, round(g, 6) AS growth_opportunity_score,
        round(sqrt(least(1, pow(sqrt(q), 0.35) * pow(pow(i, 1.5), 0.25) * pow(1 / (1 + exp(-4 * (s - 0.5))), 0.25) * pow(g, 0.15))), 6) AS career_success_index,
        round(CASE WHEN n <= 1 THEN 0 ELSE 1 / (1 + exp(-6 * (better / (2 * (n - 1)) - 0.3))) END, 6) AS career_advancement_index FROM f0)"""


add("career_success", lambda s, d: R.success(A.segments(s, d)), f"WITH {SEGMENTS}, {_success_sql('segments', 'cf')} SELECT * FROM success")
add("career_success_by_period", lambda s, d: R.success(A.period_segments(s, d), "period"), f"WITH {PERIODS}, {_success_sql('periods', 'cf, period')} SELECT * FROM success")

_TRANSITIONS = """tv AS (SELECT * FROM segments WHERE over_id > 0), tm AS (SELECT ct AS mct, median(durata) AS m FROM tv WHERE ct IS NOT NULL GROUP BY ct),
    tx AS (SELECT tv.*, coalesce(m, (SELECT median(durata) FROM tv)) AS x, prior >= 1 AS full_ FROM tv LEFT JOIN tm ON mct = ct),
    tl AS (SELECT *, lag(x) OVER w AS px, lag(full_) OVER w AS pf, lag(retribuzione) OVER w AS ps FROM tx WINDOW w AS (PARTITION BY cf ORDER BY inizio, fine)),
    ts AS (SELECT cf, count(*) - 1 AS n, count(CASE WHEN x > px * 1.1 THEN 1 END) AS ud, count(CASE WHEN x < px * 0.9 THEN 1 END) AS dd, count(CASE WHEN NOT pf AND full_ THEN 1 END) AS uf, count(CASE WHEN pf AND NOT full_ THEN 1 END) AS df,
        count(CASE WHEN retribuzione > ps * 1.05 THEN 1 END) AS us, count(CASE WHEN retribuzione < ps * 0.95 THEN 1 END) AS ds FROM tl GROUP BY cf),
    moves AS (SELECT cf, n AS total_transitions, ud AS duration_improvements, dd AS duration_deteriorations, uf AS fulltime_improvements, df AS fulltime_deteriorations, us AS salary_improvements, ds AS salary_deteriorations,
        round(coalesce((ud + uf + us) / nullif(n, 0), 0), 6) AS composite_improvement_rate, round(coalesce((ud + uf + us) / nullif(n, 0), 0) / 3, 6) AS career_advancement_index FROM ts)"""
add("career_transitions", lambda s, d: R.job_transitions(A.segments(s, d)), f"WITH {SEGMENTS}, {_TRANSITIONS} SELECT * FROM moves")


def _stability_sql(source: str, keys: str, name: str = "stability") -> str:
    return f"""sf AS (SELECT *, CASE WHEN over_id > 0 THEN 1 ELSE 0 END AS e FROM {source} WHERE durata >= 1),
    sg AS (SELECT *, CASE WHEN e = lag(e) OVER w THEN 0 ELSE 1 END AS ch FROM sf WINDOW w AS (PARTITION BY {keys} ORDER BY inizio, fine)),
    sr AS (SELECT *, sum(ch) OVER (PARTITION BY {keys} ORDER BY inizio, fine ROWS UNBOUNDED PRECEDING) AS run FROM sg),
    sp AS (SELECT {keys}, run, e, sum(durata) AS d, count(*) AS m FROM sr GROUP BY {keys}, run, e),
    ss AS (SELECT {keys}, CAST(sum(m) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN e = 1 THEN d END), 0) AS BIGINT) AS emp, CAST(coalesce(sum(CASE WHEN e = 0 THEN d END), 0) AS BIGINT) AS un,
        count(CASE WHEN e = 1 THEN 1 END) AS ej, count(CASE WHEN e = 0 THEN 1 END) AS ui, coalesce(avg(CASE WHEN e = 1 THEN d END), 0) AS ae, coalesce(avg(CASE WHEN e = 0 THEN d END), 0) AS au,
        CAST(coalesce(max(CASE WHEN e = 1 THEN d END), 0) AS BIGINT) AS me, CAST(coalesce(max(CASE WHEN e = 0 THEN d END), 0) AS BIGINT) AS mu FROM sp GROUP BY {keys}),
    {name} AS (SELECT {keys}, emp AS days_employed, un AS days_unemployed, emp + un AS total_days, n AS total_observations, round(emp / (emp + un), 6) AS employment_rate, ej AS employment_spells, ui AS unemployment_spells,
        round(ae, 6) AS avg_employment_spell, round(au, 6) AS avg_unemployment_spell, me AS max_employment_spell, mu AS max_unemployment_spell,
        round(CASE WHEN n <= 1 THEN 0 ELSE ej / greatest((emp + un) / 365.25, 1 / 365.25) END, 6) AS job_turnover_rate,
        round(CASE WHEN n <= 1 THEN emp / (emp + un) ELSE least(1, 0.4 * emp / (emp + un) + 0.3 * least(1, me / 365) + 0.2 * greatest(0, 1 - least(1, ej / 4)) + 0.1 * least(1, ae / 90)) END, 6) AS employment_stability_index FROM ss)"""


def _complexity_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""cl AS (SELECT *, abs(CASE WHEN over_id > 0 THEN 1 ELSE 0 END - lag(CASE WHEN over_id > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY inizio, fine)) AS flip FROM {source}),
    cc AS (SELECT {keys}, prior, count(*) AS c FROM {source} WHERE over_id > 0 GROUP BY {keys}, prior),
    cp AS (SELECT {keys}, c / sum(c) OVER (PARTITION BY {keys}) AS p FROM cc),
    ch AS (SELECT {keys}, CASE WHEN count(*) > 1 THEN sum(-p * ln(p + 1e-10)) ELSE 0 END AS h FROM cp GROUP BY {keys}),
    cs AS (SELECT {keys}, CAST(coalesce(max(CASE WHEN over_id > 0 THEN arco END), 0) AS DOUBLE) AS mx, coalesce(avg(CASE WHEN over_id > 0 THEN arco END), 0) AS av, CAST(coalesce(sum(CASE WHEN over_id > 0 AND arco > 1 THEN durata END), 0) AS DOUBLE) AS conc,
        CAST(coalesce(sum(CASE WHEN over_id > 0 THEN durata END), 0) AS DOUBLE) AS days, sum(flip) AS flips, sum(durata) AS ad, count(CASE WHEN over_id > 0 THEN 1 END) AS jobs FROM cl GROUP BY {keys}),
    cx AS (SELECT a.*, coalesce(h, 0) AS h, coalesce(conc / nullif(days, 0), 0) AS rate, CASE WHEN flips IS NULL THEN 0 ELSE least(1, flips / greatest(1, ad / 365.25) / 4) END AS fr FROM cs a LEFT JOIN ch b ON {on}),
    complexity AS (SELECT {keys}, mx AS max_concurrent_jobs, round(av, 6) AS avg_concurrent_jobs, conc AS concurrent_employment_days, days AS total_employment_days, round(rate, 6) AS concurrent_employment_rate, round(h, 6) AS employment_diversity_index,
        round(CASE WHEN jobs = 0 THEN 0 ELSE fr END, 6) AS career_fragmentation_index,
        round(CASE WHEN jobs = 0 THEN 0 ELSE sqrt(least(1, 0.25 * least(1, sqrt(greatest(0, mx - 1))) + 0.25 / (1 + exp(-15 * (rate - 0.05))) + 0.3 * (1 - exp(-3 * h)) + 0.2 * least(1, pow(fr, 0.7)))) END, 6) AS career_complexity_index FROM cx)"""


add("career_stability", lambda s, d: R.stability(A.segments(s, d)), f"WITH {SEGMENTS}, {_stability_sql('segments', 'cf')} SELECT * FROM stability")
add("career_complexity", lambda s, d: R.complexity(A.segments(s, d)), f"WITH {SEGMENTS}, {_complexity_sql('segments', 'cf')} SELECT * FROM complexity")
_CATEGORY = """CASE WHEN regexp_matches(metric_name, 'quality|contract_quality|intensity|stability_score|growth_opportunity|performance_index') THEN 'quality'
    WHEN regexp_matches(metric_name, 'transition|improvement|deterioration|progression') THEN 'transitions' WHEN regexp_matches(metric_name, 'employment_rate|employment_spells|turnover|employment_stability') THEN 'stability'
    WHEN regexp_matches(metric_name, 'concurrent|diversity|complexity|fragmentation') THEN 'complexity' ELSE 'other' END"""
add(
    "career_comprehensive_long",
    lambda s, d: R.comprehensive(A.segments(s, d), metrics=("stability", "complexity"), form="long"),
    f"""WITH {SEGMENTS}, {_stability_sql('segments', 'cf')}, {_complexity_sql('segments', 'cf')}, wide AS (SELECT s.*, c.* EXCLUDE (cf) FROM complexity c JOIN stability s USING (cf)),
    dbl AS (SELECT cf, CAST(COLUMNS(* EXCLUDE (cf)) AS DOUBLE) FROM wide), long AS (UNPIVOT dbl ON COLUMNS(* EXCLUDE (cf)) INTO NAME metric_name VALUE metric_value)
    SELECT cf, metric_name, metric_value, {_CATEGORY} AS metric_category FROM long""",
)
add("career_comprehensive_wide", lambda s, d: R.comprehensive(A.segments(s, d)).select("cf", "career_success_index", "total_transitions", "employment_rate", "career_complexity_index"),
    f"""WITH {SEGMENTS}, {_success_sql('segments', 'cf')}, {_TRANSITIONS}, {_stability_sql('segments', 'cf')}, {_complexity_sql('segments', 'cf')}
    SELECT cf, career_success_index, total_transitions, employment_rate, career_complexity_index FROM complexity LEFT JOIN stability USING (cf) LEFT JOIN moves USING (cf) LEFT JOIN success USING (cf)""")  # fmt: skip


def _unified_sql(source: str, keys: str) -> str:
    return f"""u7 AS (SELECT * FROM {source} WHERE over_id > 0 AND durata >= 7), {_success_sql("u7", keys)}, {_stability_sql("u7", keys)}, {_complexity_sql("u7", keys)}
    SELECT {keys}, su.* EXCLUDE ({keys}), employment_rate, CAST(max_employment_spell AS DOUBLE) AS max_employment_spell, job_turnover_rate,
        round(least(1, 0.4 + 0.3 * least(1, max_employment_spell / 365) + 0.15 + 0.1 * least(1, max_employment_spell / 90)), 6) AS employment_stability_index,
        max_concurrent_jobs, avg_concurrent_jobs, concurrent_employment_days, concurrent_employment_rate, employment_diversity_index, career_fragmentation_index, career_complexity_index
    FROM success su JOIN stability USING ({keys}) JOIN complexity USING ({keys})"""


add("career_unified", lambda s, d: R.unified(A.segments(s, d)), f"WITH {SEGMENTS}, {_unified_sql('segments', 'cf')}")
add("career_unified_by_period", lambda s, d: R.unified(A.period_segments(s, d), "period"), f"WITH {PERIODS}, {_unified_sql('periods', 'cf, period')}")


# --- period metrics ----------------------------------------------------------------------------------------------------
_PERM, _TEMP, _INTERN = ["1-URGENT", "2-HIGH"], ["4-NOT SPECIFIED", "5-LOW"], ["3-MEDIUM"]
_in = lambda codes: "ct IN (" + ", ".join(f"'{c}'" for c in codes) + ")"


def _quality_sql(three: bool) -> str:
    score = "CASE WHEN pe THEN 1.0 WHEN it THEN 0.5 WHEN te THEN 0.0 ELSE 0.25 END" if three else "CASE WHEN pe THEN 1.0 WHEN te THEN 0.0 ELSE 0.5 END"
    moves = (
        "count(CASE WHEN lt AND pe THEN 1 END) AS m0, count(CASE WHEN lp AND te THEN 1 END) AS m1, count(CASE WHEN lt AND it THEN 1 END) AS m2, count(CASE WHEN li AND pe THEN 1 END) AS m3"
        if three
        else "count(CASE WHEN sc - ls > 0.3 THEN 1 END) AS m0, count(CASE WHEN sc - ls < -0.3 THEN 1 END) AS m1, 0 AS m2, 0 AS m3"
    )
    rates = (
        "round(p / d, 6) AS permanent_contract_rate, round(i / d, 6) AS internship_contract_rate, round(t / d, 6) AS temporary_contract_rate, i AS internship_contract_days"
        if three
        else "round(coalesce(p / nullif(p + t, 0), 0), 6) AS permanent_contract_rate"
    )
    return f"""q0 AS (SELECT *, coalesce({_in(_PERM)}, false) AS pe, coalesce({_in(_TEMP)}, false) AS te, {f"coalesce({_in(_INTERN)}, false)" if three else "false"} AS it FROM periods WHERE over_id > 0),
    q1 AS (SELECT *, {score} AS sc FROM q0),
    q2 AS (SELECT *, row_number() OVER w AS rn, lag(pe) OVER w AS lp, lag(te) OVER w AS lt, lag(it) OVER w AS li, lag(sc) OVER w AS ls FROM q1 WINDOW w AS (PARTITION BY cf, period ORDER BY inizio, fine)),
    q3 AS (SELECT cf, period, CAST(coalesce(sum(CASE WHEN pe THEN durata END), 0) AS BIGINT) AS p, CAST(coalesce(sum(CASE WHEN te THEN durata END), 0) AS BIGINT) AS t, CAST(coalesce(sum(CASE WHEN it THEN durata END), 0) AS BIGINT) AS i,
        CAST(sum(durata) AS BIGINT) AS d, avg(sc) AS q, count(*) AS n, {moves}, regr_slope(sc, rn) AS slope FROM q2 GROUP BY cf, period),
    quality AS (SELECT cf, period, p AS permanent_contract_days, t AS temporary_contract_days, d AS total_employment_days, round(q, 6) AS average_contract_quality, n AS contract_observations, {rates},
        m0 AS temp_to_perm_transitions, m1 AS perm_to_temp_transitions, m2 AS temp_to_internship_transitions, m3 AS internship_to_perm_transitions,
        round(CASE WHEN n >= 3 THEN coalesce(slope, 0) ELSE 0 END, 6) AS contract_stability_trend, round(m0 / greatest(1, n / 4), 6) AS contract_improvement_rate FROM q3)"""


add("contract_quality_three_tier", lambda s, d: I.contract_quality(A.period_segments(s, d), _PERM, _TEMP, _INTERN), f"WITH {PERIODS}, {_quality_sql(True)} SELECT * FROM quality")
add("contract_quality_two_tier", lambda s, d: I.contract_quality(A.period_segments(s, d), _PERM, _TEMP), f"WITH {PERIODS}, {_quality_sql(False)} SELECT * FROM quality")
add("impact_stability", lambda s, d: I.stability_metrics(A.period_segments(s, d)), f"WITH {PERIODS}, {_stability_sql('periods', 'cf, period')} SELECT * FROM stability")
add("impact_complexity", lambda s, d: I.complexity_metrics(A.period_segments(s, d)), f"WITH {PERIODS}, {_complexity_sql('periods', 'cf, period')} SELECT * FROM complexity")
_PATTERNS = """pe AS (SELECT *, CASE WHEN over_id > 0 THEN 1 ELSE 0 END AS e FROM periods),
    pg AS (SELECT *, CASE WHEN e = 1 THEN inizio - lag(fine) OVER (PARTITION BY cf, period, e ORDER BY inizio, fine) END AS gap, e - lag(e) OVER w AS flip, prior - lag(prior) OVER w AS dp FROM pe WINDOW w AS (PARTITION BY cf, period ORDER BY inizio, fine)),
    ps AS (SELECT cf, period, count(*) AS n, avg(CASE WHEN gap > 0 THEN gap END) AS ag, median(CASE WHEN gap > 0 THEN gap END) AS mg, count(CASE WHEN e = 0 THEN 1 END) AS idle, count(CASE WHEN flip > 0 THEN 1 END) AS found, count(CASE WHEN dp <> 0 THEN 1 END) AS chg,
        count(CASE WHEN dp > 0 THEN 1 END) AS up, count(CASE WHEN dp < 0 THEN 1 END) AS down, count(CASE WHEN flip <> 0 THEN 1 END) AS flips, sum(durata) AS days, coalesce(sum(CASE WHEN e = 1 THEN durata END), 0) AS worked FROM pg GROUP BY cf, period),
    patterns AS (SELECT cf, period, round(CASE WHEN n > 1 THEN ag END, 6) AS avg_time_to_next_job, CASE WHEN n > 1 THEN CAST(mg AS DOUBLE) END AS median_time_to_next_job, round(CASE WHEN n > 1 THEN found / nullif(idle, 0) END, 6) AS job_search_success_rate,
        CAST(CASE WHEN n > 1 THEN chg ELSE 0 END AS DOUBLE) AS contract_type_changes, CAST(CASE WHEN n > 1 THEN up ELSE 0 END AS DOUBLE) AS upward_transitions, CAST(CASE WHEN n > 1 THEN down ELSE 0 END AS DOUBLE) AS downward_transitions,
        round(CASE WHEN n > 1 THEN flips / greatest(1, days / 365.25) ELSE 0 END, 6) AS transition_frequency, round(CASE WHEN n > 1 THEN worked / greatest(1, days) ELSE 1 END, 6) AS employment_continuity_index FROM ps)"""
add("transition_patterns", lambda s, d: I.transition_patterns(A.period_segments(s, d)), f"WITH {PERIODS}, {_PATTERNS} SELECT * FROM patterns")
_SUCCESS = """index_ AS (SELECT cf, period, greatest(0, least(1, 0.35 * coalesce(q.average_contract_quality, 0.5) + 0.25 * coalesce(s.employment_rate, 0.5) + 0.25 * coalesce(s.employment_stability_index, 0.5) + 0.15 * least(1, coalesce(q.contract_improvement_rate, 0.3)))) AS v
    FROM quality q LEFT JOIN stability s USING (cf, period))"""
add(
    "success_index",
    lambda s, d: I.success_index(rounded(I.contract_quality(p := A.period_segments(s, d), _PERM, _TEMP)), rounded(I.stability_metrics(p))),
    f"WITH {PERIODS}, {_quality_sql(False)}, {_stability_sql('periods', 'cf, period')}, {_SUCCESS} SELECT cf, period, round(v, 6) AS career_success_index FROM index_",
)
add(
    "impact_metrics_wide",
    lambda s, d: I.comprehensive(A.period_segments(s, d), _PERM, _TEMP).select("cf", "period", "employment_rate", "permanent_contract_rate", "career_complexity_index", "transition_frequency"),
    f"""WITH {PERIODS}, {_quality_sql(False)}, {_stability_sql('periods', 'cf, period')}, {_complexity_sql('periods', 'cf, period')}, {_PATTERNS}
    SELECT cf, period, employment_rate, permanent_contract_rate, career_complexity_index, transition_frequency FROM stability FULL JOIN quality USING (cf, period) FULL JOIN complexity USING (cf, period) FULL JOIN patterns USING (cf, period)""",
)
_RATES = ("employment_rate", "permanent_contract_rate", "career_complexity_index", "transition_frequency")
add(
    "impact_metrics_long_rates",
    lambda s, d: I.comprehensive(A.period_segments(s, d), _PERM, _TEMP, form="long").where(F.col("metric_name").isin(*_RATES)).select("cf", "period", "metric_name", "metric_value"),
    f"""WITH {PERIODS}, {_quality_sql(False)}, {_stability_sql('periods', 'cf, period')}, {_complexity_sql('periods', 'cf, period')}, {_PATTERNS},
    wide AS (SELECT cf, period, employment_rate, permanent_contract_rate, career_complexity_index, transition_frequency FROM stability FULL JOIN quality USING (cf, period) FULL JOIN complexity USING (cf, period) FULL JOIN patterns USING (cf, period))
    {" UNION ALL ".join(f"SELECT cf, period, '{m}' AS metric_name, CAST({m} AS DOUBLE) AS metric_value FROM wide WHERE {m} IS NOT NULL" for m in _RATES)}""",
)
_IMPACT_CATEGORY = """CASE WHEN regexp_matches(metric_name, 'employment|spell|turnover|stability') THEN 'stability' WHEN regexp_matches(metric_name, 'contract|permanent|temporary|quality') THEN 'quality'
    WHEN regexp_matches(metric_name, 'concurrent|diversity|complexity|fragmentation') THEN 'complexity' WHEN regexp_matches(metric_name, 'transition|continuity|search|time') THEN 'transitions'
    WHEN regexp_matches(metric_name, 'career_success_index|career_advancement_index') THEN 'career_success' WHEN regexp_matches(metric_name, '^career_|employment_intensity_score|growth_opportunity_score') THEN 'career_metrics' ELSE 'other' END"""
add(
    "impact_metrics_long_all",
    lambda s, d: I.comprehensive(A.period_segments(s, d), _PERM, _TEMP, form="long").where("metric_name <> 'career_success_index'"),  # that one from unrounded scores: see success_index
    f"""WITH {PERIODS}, {_quality_sql(False)}, {_stability_sql('periods', 'cf, period')}, {_complexity_sql('periods', 'cf, period')}, {_PATTERNS},
    wide AS (SELECT * FROM stability FULL JOIN quality USING (cf, period) FULL JOIN (SELECT * EXCLUDE (total_employment_days) FROM complexity) USING (cf, period) FULL JOIN patterns USING (cf, period)),
    dbl AS (SELECT cf, period, CAST(COLUMNS(* EXCLUDE (cf, period)) AS DOUBLE) FROM wide), long AS (SELECT * FROM dbl UNPIVOT INCLUDE NULLS (metric_value FOR metric_name IN (COLUMNS(* EXCLUDE (cf, period)))))
    SELECT cf, period, metric_name, metric_value, {_IMPACT_CATEGORY} AS metric_category FROM long""",
)
add("impact_metrics_long", lambda s, d: I.comprehensive(A.period_segments(s, d), _PERM, _TEMP, form="long"))
add(
    "survival_comparison_groups",
    lambda s, d: V.comparison_groups(V.median_survival(_km(s, d)), 3),
    f"""{_KM}, {_MEDIAN}, ra AS (SELECT *, row_number() OVER (ORDER BY m NULLS LAST, g) AS r, count(*) OVER () AS n FROM med),
    sl AS (SELECT *, floor((r - 1) / greatest(1.0, (n - 1) / 2.0)) AS slot FROM ra), kk AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY r) AS k FROM sl)
    SELECT g AS contract_type, m AS median_survival, l AS median_ci_lower, u AS median_ci_upper FROM kk WHERE k = 1 OR r = n""",
)
add(
    "survival_forest",
    lambda s, d: V.forest_data(V.median_survival(_km(s, d))),
    f"""{_KM}, {_MEDIAN} SELECT g AS contract_type, m AS median_survival, l AS median_ci_lower, u AS median_ci_upper, coalesce(l <= m AND m <= u, false) AS ci_valid,
        CAST(row_number() OVER (ORDER BY m DESC, g) AS INTEGER) AS place, round(avg(m) OVER (), 6) AS overall_median FROM med WHERE m IS NOT NULL""",
)
add(
    "survival_frames",
    lambda s, d: V.curve_frames(_km(s, d), 10),
    f"{_KM} SELECT g AS contract_type, time, round(s, 6) AS survival_prob, CAST(frame AS INTEGER) AS frame FROM km CROSS JOIN generate_series(1, 10) f(frame) WHERE time <= (SELECT max(time) FROM km) * frame / 10",
)
