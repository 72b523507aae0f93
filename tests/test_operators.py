"""Exact values, invariants and recovered effects."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spellwise.functions import columns as C
from spellwise.functions import stats
from spellwise.operators import career, estimation, events, matching, network, panel, plotdata, rdd, segments, survival, transitions
from spellwise.sources import adapters, generate, writers

D = datetime.date


def contracts(spark, rows):
    return spark.createDataFrame(rows, "id long, cf string, inizio date, fine date, prior int, contract_type string")


def test_durations_and_censoring(spark):
    rows = contracts(spark, [(1, "a", D(2020, 1, 1), D(2020, 1, 31), 1, "x"), (2, "b", D(2020, 6, 1), D(2020, 12, 31), 0, "x"), (3, "c", D(2020, 3, 1), D(2020, 5, 31), 1, "y")])
    got = {r.id: (r.survival_time, r.censored) for r in survival.with_durations(rows).collect()}
    assert got == {1: (31, 0), 2: (214, 1), 3: (92, 0)}


def test_all_censored_when_all_end_together(spark):
    rows = contracts(spark, [(k, "a", D(2020, k, 1), D(2020, 12, 31), 1, "x") for k in (1, 2, 3)])
    assert {r.censored for r in survival.with_durations(rows).collect()} == {1}


def test_step_lookup(spark):
    table = spark.createDataFrame([("x", 10, 0.95, 9), ("x", 20, 0.85, 8), ("x", 30, 0.70, 7), ("x", 40, 0.55, 6), ("x", 50, 0.40, 5)], "contract_type string, time int, survival_prob double, n_risk int")
    grid = spark.createDataFrame([(t,) for t in (0, 10, 15, 20, 50, 100)], "time int")
    assert {r.time: r.survival_prob for r in survival.survival_at(table, grid).collect()} == {0: 1.0, 10: 0.95, 15: 0.95, 20: 0.85, 50: 0.40, 100: 0.40}


def test_survival_falls_and_stays_inside_its_bounds(spark, sf):
    rows = survival.kaplan_meier(survival.with_durations(adapters.contracts(spark, sf))).orderBy("contract_type", "time").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        if a.contract_type == b.contract_type:
            assert b.survival_prob <= a.survival_prob + 1e-12
    assert all(r.lower_ci is None or r.lower_ci <= r.survival_prob <= r.upper_ci for r in rows)


def test_sweep(spark):
    rows = contracts(spark, [(1, "a", D(2020, 1, 1), D(2020, 1, 10), 1, "x"), (2, "a", D(2020, 1, 6), D(2020, 1, 15), 1, "y"), (3, "a", D(2020, 1, 21), D(2020, 1, 25), 1, "z")])
    got = [tuple(r) for r in segments.sweep(rows).orderBy("inizio").select("arco", "over_id", "durata").collect()]
    assert got == [(1, 1, 5), (2, 1, 5), (1, 1, 5), (0, 0, 5), (1, 2, 5)]
    both = segments.consolidate(segments.build_segments(rows.withColumn("retribuzione", F.lit(1.0))), "both").orderBy("inizio")
    assert [r.durata for r in both.collect()] == [15, 5, 5]


def test_chain_values(spark):
    df = spark.createDataFrame([("a->b->c",), ("a",), (None,), ("",)], "x string")
    last = [r[0] for r in df.select(C.chain_value(F.col("x"))).collect()]
    first = [r[0] for r in df.select(C.chain_value(F.col("x"), "first")).collect()]
    assert last == ["c", "a", None, ""] and first == ["a", "a", None, ""]


def test_matrix_sums_to_the_weights(spark, sf):
    edges = transitions.transitions(adapters.segments(spark, sf))
    total = edges.agg(F.sum("weight")).first()[0]
    assert transitions.transition_matrix(edges).agg(F.sum("value")).first()[0] == total
    rows = transitions.transition_matrix(edges, "row").groupBy("from").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 or r.s == 0 for r in rows)
    assert len(transitions.pivoted(transitions.transition_matrix(edges)).columns) == 1 + edges.select("to").union(edges.select("from")).distinct().count()


def test_empty_histories(spark, sf):
    none = adapters.segments(spark, sf).where("false")
    assert transitions.transitions(none).count() == 0
    assert career.success(none).count() == career.stability(none).count() == career.complexity(none).count() == 0


def test_indices_lie_in_the_unit_interval(spark, sf):
    rows = adapters.segments(spark, sf)
    for df, c in ((career.success(rows), "career_success_index"), (career.stability(rows), "employment_stability_index"), (career.complexity(rows), "career_complexity_index")):
        low, high = df.agg(F.min(c), F.max(c)).first()
        assert 0 <= low <= high <= 1


def test_distribution_tails():
    assert math.isclose(stats.normal_sf2(1.96), 0.04999579, abs_tol=1e-8)
    assert math.isclose(stats.chi2_sf(3.841459, 1), 0.05, abs_tol=1e-6)
    assert math.isclose(stats.t_sf2(2.228139, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(stats.t_quantile(0.975, 10), 2.228139, abs_tol=1e-5)
    assert math.isclose(stats.f_sf(4.964603, 1, 10), 0.05, abs_tol=1e-6)


def test_did_recovers_an_effect(spark):
    h = lambda *c: (F.xxhash64(*c) % 1000) / 1000.0
    rows = spark.range(600).select(F.col("id").alias("cf"), (F.col("id") % 2 == 0).alias("is_treated"), F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("period"))
    y = 100 + 10 * h("cf") + 5 * (F.col("period") == "post").cast("int") + 60 * (F.col("is_treated") & (F.col("period") == "post")).cast("int") + h("cf", "period")
    found = estimation.difference_in_differences(rows.withColumn("y", y).withColumn("z", F.lit("text")), ["y", "missing"])
    assert abs(found[0]["treatment_effect"] - 60) < 0.5 and found[0]["significant"]
    assert found[1]["error"]


def test_string_periods_keep_their_sign(spark):
    rows = spark.createDataFrame([(1, True, "pre", 1.0), (1, True, "post", 3.0), (2, False, "control", 1.0)], "cf int, is_treated boolean, period string, y double")
    assert estimation.did_means(rows, "y").first().did == 2.0
    with pytest.raises(ValueError):
        estimation.did_panel(rows.withColumn("period", F.lit("later")))


def test_event_study_finds_the_jump(spark):
    rows = spark.range(300).select(F.col("id").alias("cf"), (F.col("id") % 2 == 0).alias("is_treated"), F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("event_time"))
    y = F.col("event_time") * 1.0 + F.when(F.col("is_treated") & (F.col("event_time") >= 0), 7.0).otherwise(0.0) + (F.xxhash64("cf", "event_time") % 100) / 1000.0
    found = {e["event_time"]: e for e in estimation.event_study(rows.withColumn("y", y), ["y"])}
    assert abs(found[-3]["coefficient"]) < 0.1 and abs(found[2]["coefficient"] - 7) < 0.1 and found[-1]["coefficient"] == 0
    assert estimation.pre_trend_test(list(found.values()))["df"] == 2


def test_pooling_and_adjustment(spark):
    e = spark.createDataFrame([("a", "m", 1.0, 0.5, 0.01, 10), ("b", "m", 2.0, 0.5, 0.04, 10), ("c", "m", 3.0, 0.5, 0.03, 10)], "outcome string, method string, treatment_effect double, std_error double, p_value double, n_obs int")
    assert estimation.pool(e, "weighted_average").first().pooled_effect == pytest.approx(2.0)
    assert estimation.heterogeneity(e)["q_statistic"] == pytest.approx(8.0)
    assert [r.adjusted_p_value for r in estimation.adjust_p(e, "holm").orderBy("outcome").collect()] == pytest.approx([0.03, 0.06, 0.06])
    assert [r.adjusted_p_value for r in estimation.adjust_p(e, "fdr").orderBy("outcome").collect()] == pytest.approx([0.03, 0.04, 0.04])


def test_rdd_recovers_a_jump(spark):
    rows = spark.range(4000).select((F.col("id") % 200 - 100).cast("double").alias("r"), F.xxhash64("id").alias("h")).withColumn("y", 0.1 * F.col("r") + F.when(F.col("r") >= 0, 5.0).otherwise(0.0) + (F.col("h") % 100) / 100.0)
    got = rdd.sharp(rows, "y", "r", 0.0)
    assert abs(got["estimate"] - 5) < 4 * got["std_error"] < 0.5
    full = rows.withColumn("t", (F.col("r") >= 0).cast("int"))
    assert abs(rdd.fuzzy(full, "y", "t", "r", 0.0)["estimate"] - got["estimate"]) < 1e-6


def test_day_zero_is_neither_before_nor_after(spark):
    rows = spark.createDataFrame([(1, D(2020, 1, 1), 1, 0), (1, D(2020, 6, 1), 1, 1), (1, D(2021, 1, 1), 1, 0), (2, D(2020, 1, 1), 1, 0)], "cf int, inizio date, over_id int, x int")
    got = {r.inizio: r for r in events.treatment_events(rows, ["x = 1"]).where("cf = 1").collect()}
    assert got[D(2020, 1, 1)].pre_event_period and got[D(2021, 1, 1)].post_event_period
    zero = got[D(2020, 6, 1)]
    assert zero.in_event_window and not zero.pre_event_period and not zero.post_event_period
    for condition in ({"column": "x", "operator": "==", "value": 1}, lambda df: df["x"] == 1):
        assert events.treatment_events(rows, [condition]).where("is_treated").count() == 3


def test_matching_improves_balance(spark):
    rows = spark.range(2000).select(F.col("id").alias("cf"), (F.xxhash64("id") % 1000 / 100.0).alias("x")).withColumn("is_treated", F.pmod(F.xxhash64("cf", F.lit(1)), F.lit(100)) < F.when(F.col("x") > 0, 45).otherwise(15))
    before = abs(matching.balance(rows, ["x"]).first().std_mean_diff)
    pairs = matching.propensity_match(rows, ["x"]).pairs
    kept = rows.join(pairs.select(F.col("treated_id").alias("cf")).union(pairs.select("control_id")), "cf")
    assert abs(matching.balance(kept, ["x"]).first().std_mean_diff) < before / 2
    assert pairs.select("control_id").distinct().count() == pairs.count()
    cem = matching.coarsened_exact(rows, ["x"])
    assert abs(matching.balance(cem, ["x"]).first().std_mean_diff) < before / 2


def test_panel_keeps_persons(spark, sf):
    metrics = career.stability(adapters.period_segments(spark, sf), "period").select("cf", "period", "employment_rate")
    who = metrics.select("cf").distinct().withColumn("is_treated", F.col("cf") % 2 == 0)
    made = panel.build_panel(metrics, who)
    assert made.count() == metrics.count() and made.select("cf").distinct().count() == who.count()


def test_graph_metrics(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "c", 1), ("b", "a", 1), ("c", "b", 1)], "from string, to string, weight long")
    got = network.path_metrics(edges)
    assert got["b"][0] == got["c"][0] == 4.0 and got["a"][0] == 0.0
    two = spark.createDataFrame([("a", "b", 9), ("b", "c", 9), ("a", "c", 9), ("x", "y", 9), ("y", "z", 9), ("x", "z", 9), ("c", "x", 1)], "from string, to string, weight long")
    labels, modularity = network.communities(two)
    assert labels["a"] == labels["b"] == labels["c"] != labels["x"] and modularity > 0.4


def test_synthetic_control(spark):
    rows = spark.createDataFrame([(u, t, {"t": 2.0 * t + (5 if t > 5 else 0), "p": 1.0 * t, "q": 3.0 * t}[u]) for u in "tpq" for t in range(1, 9)], "unit string, time int, y double")
    weights, path = estimation.synthetic_control(rows, "y", "unit", "time", "t", 6)
    assert sum(w for _, w in weights) == pytest.approx(1, abs=1e-3)
    assert path[-1][3] == pytest.approx(5, abs=0.1) and abs(path[0][3]) < 0.1


def test_generator_is_repeatable(spark):
    a = generate.histories(spark, 50, 500)
    b = generate.histories(spark, 50, 500).repartition(3)
    assert a.exceptAll(b).count() == 0 and a.count() == 500
    checks = generate.validate(a).first()
    assert checks.dates_in_order and checks.durations_match and checks.coding_holds


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("y", 1.23456, 0.5, 0.02, 0.1, 2.2)], "outcome string, treatment_effect double, std_error double, p_value double, conf_lower double, conf_upper double")
    table = writers.summary_table(df)
    assert tuple(table.first()) == ("y", 1.235, 0.5, 0.02, "**", "[0.100, 2.200]")
    assert spark.read.csv(writers.write_csv({"effects": table}, str(tmp_path))[0], header=True).count() == 1
    writers.write_parquet({"effects": table}, str(tmp_path / "bundle"), {"a": 1})
    assert spark.read.parquet(str(tmp_path / "bundle/effects")).count() == 1
    labelled = writers.rounded_table(df.withColumn("variable", F.col("outcome")), 2, {"y": "Outcome"}).first()
    assert labelled.variable == "Outcome" and labelled.treatment_effect == 1.23 and writers.rounded_table(df, 1, {"z": "Z"}, "outcome").first().outcome == "y"
    assert "| y |" in writers.report({"Effects": table}, str(tmp_path / "r.md"), "Report")


def test_bundles(spark, tmp_path):
    import shutil

    folder = str(tmp_path / "b")
    tables = {"a": spark.range(50).withColumn("t", F.lit(None).cast("string")), "b": spark.range(0).withColumn("x", F.lit(1.5))}
    writers.write_bundle(tables, folder, {"model": "did", "alpha": 0.05})
    found, metadata = writers.read_bundle(spark, folder)
    assert metadata == {"model": "did", "alpha": 0.05} and found["a"].exceptAll(tables["a"]).count() == 0 and found["a"].count() == 50 and found["b"].count() == 0
    with pytest.raises(ValueError, match="holds a bundle"):
        writers.write_bundle(tables, folder)
    spark.range(49).withColumn("t", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{folder}/a")
    with pytest.raises(ValueError, match="not as its manifest"):
        writers.read_bundle(spark, folder)
    half = str(tmp_path / "half")
    writers.write_bundle(tables, half)
    shutil.rmtree(f"{half}/manifest.json")
    with pytest.raises(ValueError, match="no manifest"):
        writers.read_bundle(spark, half)


def test_written_tables_can_be_forgotten(spark, monkeypatch):
    import os

    from spellwise.functions import tables

    monkeypatch.setattr(tables, "_FOLDERS", [])
    assert tables.written(spark.range(5)).count() == 5
    (folder,) = tables._FOLDERS
    assert os.path.isdir(folder.removeprefix("file:"))
    tables.forget(spark)
    assert not os.path.exists(folder.removeprefix("file:")) and not tables._FOLDERS


def test_colors():
    assert plotdata.contrast("#000000", "#FFFFFF") == pytest.approx(21)
    assert plotdata.status_colors(["occ_ft", "other"])["other"] == "#757575"


# --- estimates against NumPy -------------------------------------------------------------------------------------------
def dummies(ids):
    names = sorted(set(ids))
    return np.array([[float(i == n) for n in names] for i in ids])


def ols(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    dof = len(y) - np.linalg.matrix_rank(x)
    return beta, e, float(e @ e) / dof, np.linalg.pinv(x.T @ x)


def made_panel(seed=3, persons=60):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(persons):
        t, own, c = int(i % 3 == 0), rnd.normal(), rnd.normal()
        for p in (0, 1):
            if i % 11 == 0 and p:
                continue
            y = own + 0.5 * p + 1.5 * t * p + 0.3 * c * p + rnd.normal() * 0.4
            rows.append((i, bool(t), p, float(y), None if i == 5 else float(2 * y + rnd.normal()), float(c * p)))
    return rows


@pytest.mark.parametrize("cluster", [False, True])
def test_did_equals_a_regression_with_dummies(spark, cluster):
    rows = made_panel()
    df = spark.createDataFrame(rows, "cf long, is_treated boolean, period int, y double, z double, c double")
    got = estimation.difference_in_differences(df, ["y", "z"], controls=["c"], cluster=cluster)
    for k, name in ((3, "y"), (4, "z")):
        own = [r for r in rows if r[k] is not None]
        t, p, y, c = (np.array([float(r[j]) for r in own]) for j in (1, 2, k, 5))
        ids = [r[0] for r in own]
        x = np.column_stack([p, t * p, c, dummies(ids)])
        beta, e, s2, inverse = ols(x, y)
        covariance = s2 * inverse
        if cluster:
            groups = sorted(set(ids))
            scores = np.array([x[[i for i, d in enumerate(ids) if d == g]].T @ e[[i for i, d in enumerate(ids) if d == g]] for g in groups])
            covariance = inverse @ (scores.T @ scores) @ inverse * len(groups) / (len(groups) - 1)
        r = next(r for r in got if r["outcome"] == name)
        assert r["treatment_effect"] == pytest.approx(beta[1], rel=1e-8) and r["n_obs"] == len(own)
        assert r["std_error"] == pytest.approx(covariance[1, 1] ** 0.5, rel=1e-6)


def test_two_way_fit_equals_a_regression_with_dummies(spark):
    """60 unbalanced periods, persons of one to 40 rows, some twice in a period."""
    rnd = np.random.default_rng(15)
    rows = []
    for i in range(80):
        for t in rnd.choice(60, size=int(rnd.integers(1, 40)), replace=bool(i % 4 == 0)):
            a, b = float(rnd.normal() + t / 20), float(rnd.normal() + i / 30)
            rows.append((i, f"p{t:02d}", a, b, float(1.2 * a - 0.7 * b + i / 10 + t % 7 + rnd.normal())))
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0, 1.0), (1, "p01", None, 1.0, 1.0)], "cf long, period string, a double, b double, y double").repartition(4)
    fit = estimation.two_way_fit(df, "y", {"a": F.col("a"), "b": F.col("b")})
    periods = dummies([r[1] for r in rows])[:, 1:]
    x = np.column_stack([[r[2] for r in rows], [r[3] for r in rows], dummies([r[0] for r in rows]), periods])
    beta, _, s2, inverse = ols(x, np.array([r[4] for r in rows]))
    assert fit.n == len(rows) and fit.coefficients == pytest.approx(beta[:2], rel=1e-7)
    assert [fit.row(n)[1] for n in "ab"] == pytest.approx([(s2 * inverse[k, k]) ** 0.5 for k in (0, 1)], rel=1e-6)
    assert estimation.two_way_fit(df.where("false"), "y", {"a": F.col("a")}).n == 0


def test_event_study_equals_a_regression_with_dummies(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, i % 2 == 0, t, float(rnd.normal() + (i % 2 == 0) * max(0, t + 1) + 0.1 * t + i / 10)) for i in range(40) for t in range(-3, 3) if rnd.random() > 0.1]
    df = spark.createDataFrame(rows, "cf long, is_treated boolean, event_time int, y double")
    got = {r["event_time"]: r for r in estimation.event_study(df, ["y"])}
    times = [t for t in range(-3, 3) if t != -1]
    x = np.column_stack([*[[float(r[2] == t) for r in rows] for t in times], *[[float(r[2] == t and r[1]) for r in rows] for t in times], dummies([r[0] for r in rows])])
    beta, _, s2, inverse = ols(x, np.array([r[3] for r in rows]))
    for k, t in enumerate(times):
        assert got[t]["coefficient"] == pytest.approx(beta[len(times) + k], rel=1e-7, abs=1e-9)
        assert got[t]["std_error"] == pytest.approx((s2 * inverse[len(times) + k, len(times) + k]) ** 0.5, rel=1e-6)


def brute_logrank(rows, rho):
    groups, times = sorted({g for g, *_ in rows}), sorted({t for _, t, c in rows if c == 0})
    s, u, v = 1.0, np.zeros(len(groups)), np.zeros((len(groups), len(groups)))
    for t in times:
        n, d = sum(x >= t for _, x, _ in rows), sum(x == t and c == 0 for _, x, c in rows)
        ng = np.array([sum(x >= t and g == h for g, x, _ in rows) for h in groups], float)
        dg = np.array([sum(x == t and c == 0 and g == h for g, x, c in rows) for h in groups], float)
        w = s**rho
        u += w * (dg - d * ng / n)
        if n > 1:
            v += w * w * d * (n - d) / (n - 1) * (np.diag(ng / n) - np.outer(ng, ng) / n**2)
        s *= 1 - d / n
    k = len(groups) - 1
    return float(u[:k] @ np.linalg.pinv(v[:k, :k]) @ u[:k]), k


@pytest.mark.parametrize("rho", [0.0, 1.0])
def test_logrank_against_brute_force(spark, rho):
    rnd = np.random.default_rng(2)
    rows = [("abc"[i % 3], int(rnd.integers(1, 25) + (i % 3) * 3), int(rnd.random() < 0.2)) for i in range(120)]
    df = spark.createDataFrame(rows, "contract_type string, survival_time int, censored int")
    found = survival.logrank_test(df, rho)
    chi, k = brute_logrank(rows, rho)
    assert found.chi_square == pytest.approx(chi, rel=1e-8) and found.df == k
    pairs = survival.pairwise_logrank(df)
    assert [(a, b) for a, b, _ in pairs] == [("a", "b"), ("a", "c"), ("b", "c")]
    from spellwise.functions import stats

    for a, b, p in pairs:
        assert p == pytest.approx(stats.chi2_sf(brute_logrank([r for r in rows if r[0] in (a, b)], 0.0)[0], 1), rel=1e-7)


def test_rdd_equals_a_weighted_regression(spark):
    rnd = np.random.default_rng(4)
    x = rnd.uniform(-1, 1, 400)
    y = 1 + 2 * x + 0.7 * (x >= 0) + rnd.normal(size=400) * 0.2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    got = rdd.sharp(df, "y", "x", 0.0, kernel="triangular", h=0.5)
    w = np.sqrt(np.maximum(0, 1 - np.abs(x) / 0.5))
    side = (x >= 0).astype(float)
    design = np.column_stack([np.ones_like(x), side, x, x * side])
    beta, *_ = np.linalg.lstsq(design * w[:, None], y * w, rcond=None)
    assert got["estimate"] == pytest.approx(beta[1], rel=1e-7)


def brute_match(scores, caliper, ratio=1, replace=False):
    """The nearest pair of all that are free, again and again; of equals the one with fewer persons between, then the first."""
    places = {who: k for k, (_, who) in enumerate(sorted((s, i) for i, s, _ in scores))}
    room = {i: ratio if t else 1 for i, _, t in scores}
    pairs = sorted((abs(s - q), abs(places[i] - places[j]), min(places[i], places[j]), i, j) for i, s, t in scores if t for j, q, u in scores if not u if caliper is None or abs(s - q) <= caliper)
    if replace:
        value, out = {i: s for i, s, _ in scores}, {}
        for d, _, _, i, j in sorted(pairs, key=lambda p: (p[3], p[0], value[p[4]], p[4])):
            out.setdefault(i, j)
        return sorted(out.items())
    out = []
    for _, _, _, i, j in pairs:
        if room[i] and room[j]:
            room[i], room[j] = room[i] - 1, room[j] - 1
            out.append((i, j))
    return sorted(out)


def made_persons(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for i in range(300):
        x, area = float(np.round(rnd.normal(), 1)), "ab"[i % 2]
        rows.append((i, bool(rnd.random() < 1 / (1 + np.exp(1 - x))), x, area))
    return spark.createDataFrame(rows, "cf long, is_treated boolean, x double, area string")


@pytest.mark.parametrize("options", [{}, {"caliper": None}, {"ratio": 2}, {"replace": True}, {"exact": ["area"]}, {"trim": True}])
def test_propensity_match_takes_the_nearest_first(spark, options):
    """The scores are at the optimum of the likelihood, and the pairs are those of brute force."""
    df = made_persons(spark)
    match = matching.propensity_match(df, ["x"], **options)
    all_scores = matching.propensity_scores(df, ["x"]).collect()
    p, t, x = (np.array([float(r[c]) for r in all_scores]) for c in ("propensity_score", "treated", "x"))
    assert abs((t - p).sum()) < 1e-3 and abs(((t - p) * x).sum()) < 1e-3
    scores = [(r.cf, r.propensity_score, r.treated, r["area"] if "exact" in options else "") for r in match.scores.collect()]
    width = np.std([s for _, s, _, _ in scores], ddof=1)
    caliper = None if options.get("caliper", 0.2) is None else 0.2 * width
    want = []
    for area in sorted({a for *_, a in scores}):
        want += brute_match([(i, s, k) for i, s, k, a in scores if a == area], caliper, options.get("ratio", 1), options.get("replace", False))
    assert sorted((r.treated_id, r.control_id) for r in match.pairs.collect()) == sorted(want)


@pytest.mark.parametrize(("block", "options"), [(16, {}), (90, {"ratio": 2}), (40, {"exact": ["area"]})])
def test_pairs_do_not_depend_on_blocks(spark, monkeypatch, block, options):
    """Many cuts through dense scores, ties and sparse controls give the pairs of brute force."""
    rnd = np.random.default_rng(block)
    rows = [(i, float(np.round(rnd.normal(), 2)), int(rnd.random() < (0.5 if i % 3 else 0.05)), "ab"[i % 2]) for i in range(120)] + [(1000 + i, 9.0, i % 2, "a") for i in range(30)] + [(2000 + i, 12 + i / 1000, int(i == 49), "a") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, s double, treated int, e0 string").repartition(3)
    monkeypatch.setattr(matching, "BLOCK", block)
    keys, ratio = ["e0"] if "exact" in options else [], options.get("ratio", 1)
    got = matching._pairs_nearest_first(df, keys, 0.3, ratio)
    want = []
    for area in sorted({r[3] for r in rows}) if keys else [None]:
        want += brute_match([r[:3] for r in rows if area in (None, r[3])], 0.3, ratio)
    assert sorted((r.treated_id, r.control_id) for r in got.collect()) == sorted(want)


def test_propensity_match_and_missing_values(spark):
    gaps = made_persons(spark).withColumn("x", F.when(F.col("cf") % 10 == 0, None).otherwise(F.col("x")))
    for how in ("mean_impute", "missing_indicator"):
        assert matching.propensity_match(gaps, ["x"], missing=how).scores.count() == 300
    assert matching.propensity_match(gaps, ["x"]).scores.count() == 270


# --- orders over whole tables ------------------------------------------------------------------------------------------
def test_orders_in_parts(spark, monkeypatch):
    from spellwise.functions import ordering

    rnd = np.random.default_rng(6)
    rows = [(i, float(rnd.integers(0, 50)) if i % 17 else None, int(rnd.integers(1, 9)), "ab"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, x double, w long, g string").repartition(5)
    for down in (False, True):
        got = {r.id: r.w_upto for r in ordering.running_sums(df, "x", ["w"], ties="id", descending=down).collect()}
        at = 0
        for i, x, w, _ in sorted(rows, key=lambda r: (r[1] is None, (-r[1] if down else r[1]) if r[1] is not None else 0, r[0])):
            at += w
            assert got[i] == at
    numbers = ordering.numbered(df, F.xxhash64("id"), "id", "k").orderBy(F.xxhash64("id")).collect()
    assert [r.k for r in numbers] == list(range(1, 2001))
    for parts in (256, 3):
        monkeypatch.setattr(ordering, "PARTS", parts)
        found = ordering.exact_quantiles(df, ["x", "w"], [0.5, 0.13], ["g"], {"x": F.col("w")}).collect()
        assert len(found) == 4
        for r in found:
            own = [q for q in rows if q[3] == r.g]
            values = np.repeat([q[1] for q in own if q[1] is not None], [q[2] for q in own if q[1] is not None]) if r.variable == "x" else [q[2] for q in own]
            assert r.quantiles == pytest.approx(np.quantile(values, [0.5, 0.13]))
        assert ordering.quantiles(df, "x", [0, 0.13, 0.5, 1]) == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], [0, 0.13, 0.5, 1]))
    assert ordering.exact_quantiles(df.where("x IS NULL"), ["x"], [0.5]).count() == 0


def test_parts_are_even(spark):
    """Three distinct values, or an outlier, leave no part with much more than its share."""
    from spellwise.functions import ordering

    df = spark.range(40_000).withColumns({"three": (F.col("id") % 3).cast("double"), "far": F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 7)})
    for x in ("three", "far"):
        sizes = [r["count"] for r in ordering._parted(df, [F.col(x), F.col("id")]).groupBy("__part").count().collect()]
        assert len(sizes) > 200 and max(sizes) < 4 * 40_000 / ordering.PARTS
    many_nulls = df.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("far")))
    sizes = [r["count"] for r in ordering._parted(many_nulls, [F.col("x"), F.col("id")]).groupBy("__part").count().collect()]
    assert max(sizes) < 4 * 40_000 / ordering.PARTS
    upto = ordering.running_sums(df.withColumn("one", F.lit(1).cast("long")), "three", ["one"], ties="id")
    assert [r.id for r in upto.orderBy("one_upto").collect()] == sorted(range(40_000), key=lambda i: (i % 3, i))


@pytest.mark.parametrize("parts", [256, 4])
def test_as_of_against_brute_force(spark, monkeypatch, parts):
    from spellwise.functions import ordering

    monkeypatch.setattr(ordering, "PARTS", parts)
    rnd = np.random.default_rng(3)
    left = [(i, "b" if i % 3 else "a" if i % 2 else None, float(rnd.integers(0, 40)) if i % 11 else None) for i in range(400)] + [(1000 + i, "b", 7.0) for i in range(500)]
    right = [("ab"[k % 2] if k % 5 else None, float(rnd.integers(3, 45)) if k % 7 else None, float(k)) for k in range(60)]
    a = spark.createDataFrame(left, "id long, g string, t double").repartition(4)
    b = spark.createDataFrame(right, "g string, t double, v double")
    got = {r.id: r.v for r in ordering.as_of(a, b, ["g"], "t", ["v"]).collect()}
    for i, g, t in left:
        best = max(((q, v) for h, q, v in right if h == g and q is not None and t is not None and q <= t), default=None)
        assert got[i] == (best[1] if best else None), i
    assert len(got) == len(left)
    plan = ordering.as_of(a, b, ["g"], "t", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def jobs_of(spark, work):
    """Spark jobs that something starts."""
    group = f"count-{id(work)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_pairs_and_grids_take_few_jobs(spark):
    """The number of jobs does not grow with groups, bandwidths or cutoffs."""
    rnd = np.random.default_rng(12)
    rows = lambda k: spark.createDataFrame([(f"g{i % k}", int(rnd.integers(1, 30)), int(rnd.random() < 0.2)) for i in range(400)], "contract_type string, survival_time int, censored int")
    few, many = (jobs_of(spark, lambda df=rows(k): survival.pairwise_logrank(df)) for k in (3, 9))
    assert many <= few + 1
    df = spark.createDataFrame([(float(a), float(a + rnd.normal())) for a in rnd.uniform(-1, 1, 500)], "x double, y double")
    few, many = (jobs_of(spark, lambda m=m: rdd.robustness(df, "y", "x", 0.0, m, (1,), ("triangular",))) for m in ((1.0,), (0.3, 0.5, 0.8, 1.0, 1.3, 1.6)))
    assert many <= few + 1


def test_grids_equal_single_fits(spark):
    rnd = np.random.default_rng(8)
    x = np.round(rnd.uniform(-1, 1, 900), 2)
    df = spark.createDataFrame([(float(a), float(1 + a + a * a + (a >= 0) + rnd.normal() * 0.3)) for a in x] + [(None, 1.0), (0.1, None)], "x double, y double")
    for r in rdd.robustness(df, "y", "x", 0.0, (0.5, 1.25), (2, 3), ("rectangular", "epanechnikov")):
        order = int(r["value"]) if r["check"] == "order" else 1
        one = rdd.sharp(df, "y", "x", 0.0, order, r["value"] if r["check"] == "kernel" else "triangular", r["bandwidth"])
        for c in ("estimate", "std_error", "p_value", "n_total", "r_squared"):
            assert r[c] == pytest.approx(one[c], rel=1e-6, abs=1e-9), (r["check"], r["value"], c)
    for r in rdd.placebo(df, "y", "x", 0.0, [-0.5, 0.6]):
        one = rdd.sharp(df, "y", "x", r["cutoff"], h=r["bandwidth"])
        assert r["estimate"] == pytest.approx(one["estimate"], rel=1e-6) and r["std_error"] == pytest.approx(one["std_error"], rel=1e-6)


@pytest.mark.parametrize("neighbours", [1, 5])
def test_similarity_edges_meet_across_parts(spark, monkeypatch, neighbours):
    monkeypatch.setattr(network, "_LINE", 7)
    rnd = np.random.default_rng(1)
    rows = [(i, 1, float(rnd.integers(0, 12))) for i in range(120)]
    df = spark.createDataFrame(rows, "cf long, over_id long, complexity_score double").repartition(3)
    line = sorted(rows, key=lambda r: (r[2], r[0]))
    want = {(a[0], b[0]) for k, a in enumerate(line) for b in line[k + 1 : k + 1 + neighbours] if 1 / (1 + abs(a[2] - b[2])) > 0.3}
    assert {(r.from_cf, r.to_cf) for r in network.similarity_edges(df, neighbours=neighbours).collect()} == want
    assert network.similarity_edges(df.where("false")).count() == 0


def test_synthetic_inference_and_effects(spark):
    path = [(t, float(t), float(t) - g, g) for t, g in zip(range(10), [0.1, -0.2, 0.1, 0.0, 0.2, -0.1, 0.1, 3.0, 3.2, 2.8], strict=True)]
    found = estimation.conformal_inference(path, 7)
    assert found["average_effect"] == pytest.approx(3.0) and found["p_value"] == pytest.approx(0.1) and found["ci_lower"] == pytest.approx(2.8)
    assert estimation.conformal_inference(path[:7], 7)["p_value"] is None
    did = [{"outcome": "y", "treatment_effect": 1.0, "std_error": 0.5, "p_value": 0.04, "n_obs": 10, "error": None}, {"outcome": "z", "treatment_effect": None, "std_error": None, "p_value": None, "n_obs": None, "error": "x"}]
    study = [{"outcome": "y", "event_time": t, "coefficient": 2.0, "std_error": 0.5 if t >= 0 else 0.3, "p_value": 0.01} for t in (-2, 0, 1)]
    study += [{"outcome": "y", "event_time": 2, "coefficient": 4.0, "std_error": 0.1, "p_value": 0.01}]
    gaps = [{"outcome": "y", "time_period": t, "treatment_effect": g} for t, g in ((-1, 9.0), (0, 2.0), (1, 4.0))]
    effects = {r.effect_id: r for r in estimation.effects_of(spark, did, study, gaps).collect()}
    assert set(effects) == {"did_y", "event_study_y", "synth_y"}
    after = effects["event_study_y"]
    assert after.treatment_effect == pytest.approx(3.0) and after.std_error == pytest.approx(((0.25 + 0.01) / 2) ** 0.5) and after.method == "Event Study"
    assert effects["synth_y"].treatment_effect == pytest.approx(3.0) and effects["synth_y"].std_error == pytest.approx(2**0.5 / 2**0.5)
    assert after.p_value < 0.01 and effects["synth_y"].p_value == pytest.approx(0.0026998, rel=1e-4)
    assert estimation.pool(estimation.effects_of(spark, did, study, gaps), "simple_average").first().pooled_effect == pytest.approx((1 + 3 + 3) / 3)


def test_network_analysis(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("b", "a", 3), ("b", "c", 1), ("c", "d", 4), ("d", "c", 4)], "from string, to string, weight long")
    found = network.network_analysis(edges)
    assert found["summary"]["n_nodes"] == 4 and found["n_communities"] == 2 and found["centrality"]["strength"]["top"][0] == ("a", 8.0) or found["centrality"]["strength"]["top"][0][0] in "bcd"
    assert [r.node for r in network.top_nodes(edges, 2).collect()] == [n for n, _ in found["centrality"]["strength"]["top"][:2]]


def test_min_duration_keeps_unemployment(spark):
    rows = spark.createDataFrame([(0, 5), (1, 5), (2, 40), (0, 90)], "arco int, durata int")
    assert sorted(map(tuple, segments.min_duration(rows, 30).collect())) == [(0, 5), (0, 90), (2, 40)]


def test_recommendations_name_what_is_off(spark):
    rows = spark.createDataFrame(
        [(1, True, D(2020, 1, 1), True, 0.0, None), (1, True, D(2020, 1, 1), True, None, None), (2, True, D(2020, 2, 1), False, 5.0, 1)],
        "cf int, is_treated boolean, treatment_event_date date, in_event_window boolean, days_to_event double, x int",
    )
    quality = events.data_quality(rows)
    q = quality.first()
    assert (q.n_treated_rows, q.n_treated_persons, q.duplicate_events, q.invalid_windows, q.events_per_person) == (3, 2, 1, 1, 1.5)
    balance = spark.createDataFrame([("x", 0.3)], "variable string, std_mean_diff double")
    assert len(events.recommendations(quality, balance)) == 3  # nearly all treated, unlike, values missing
    none = events.data_quality(rows.limit(0))
    assert none.first().completeness is None and events.recommendations(none) == []


def test_a_bandwidth_with_rows_on_one_side_has_no_jump(spark):
    df = spark.createDataFrame([(float(x), 1.0 + x) for x in range(1, 11) for _ in range(25)], "x double, y double")
    assert rdd.sharp(df, "y", "x", 5.0, h=0.7)["estimate"] is None
    assert [r["estimate"] for r in rdd.robustness(df, "y", "x", 5.0, (0.1,), (1,), ())][:1] == [None]
    found = rdd.placebo(df.unionAll(spark.createDataFrame([(5.0, 6.0)] * 40000, df.schema)), "y", "x", 5.0, [3.0, 5.0])
    assert [(r["cutoff"], r["estimate"]) for r in found] == [(3.0, None), (5.0, None)]


def test_a_fuzzy_jump_without_rows_on_one_side_is_null_and_does_not_raise(spark):
    df = spark.createDataFrame([(float(x), 1.0 + x, int(x >= 5)) for x in range(1, 11) for _ in range(5)], "x double, y double, t int")
    found = rdd.fuzzy(df, "y", "t", "x", 5.0, h=0.7)
    assert found["estimate"] is None and found["first_stage"] is None and found["n_total"] == 5
    assert rdd.fuzzy(df, "y", "t", "x", 5.5, h=0.2)["n_total"] == 0
    with pytest.raises(ValueError, match="weak"):
        rdd.fuzzy(df.withColumn("t", F.lit(1)), "y", "t", "x", 5.0, h=2.5)


def test_mean_prices_of_persons_do_not_depend_on_the_order_of_rows(spark, sf, tmp_path):
    from spellwise.plans import causal

    orders, customers = adapters.table(spark, sf, "orders").coalesce(1), adapters.table(spark, sf, "customer")
    copies = [orders.orderBy(F.xxhash64("o_orderkey", F.lit(k))).withColumn("o_custkey", F.col("o_custkey") * 4 + k).coalesce(1) for k in range(4)]
    copies[0].unionAll(copies[1]).unionAll(copies[2]).unionAll(copies[3]).write.parquet(f"{tmp_path}/orders.parquet")
    customers.withColumn("c_custkey", F.explode(F.array(*[F.col("c_custkey") * 4 + k for k in range(4)]))).write.parquet(f"{tmp_path}/customer.parquet")
    means = causal._persons(spark, str(tmp_path)).groupBy(F.floor(F.col("cf") / 4)).agg(F.count_distinct("mean_price").alias("n"))
    assert {r.n for r in means.collect()} == {1}


def test_parts_by_person_follow_the_number_of_contracts(spark, sf, monkeypatch):
    rows = adapters.contracts(spark, sf)
    expected = sorted(map(str, segments.build_segments(rows).collect()))
    monkeypatch.setattr(segments, "FEW_ROWS", 100)
    monkeypatch.setattr(segments, "PART_ROWS", 50)
    assert segments.sweep(rows).rdd.getNumPartitions() == math.ceil(rows.count() / 50)  # not joined to a few by their size
    assert sorted(map(str, segments.build_segments(rows).collect())) == expected
