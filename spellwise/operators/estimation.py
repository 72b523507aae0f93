"""Causal estimates: fixed-effects least squares, difference in differences, event studies, synthetic control, pooling."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats, tables


@dataclasses.dataclass
class Fit:
    """Coefficients of a least-squares fit."""

    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    n: int
    dof: int
    r_squared: float
    kept: list[int] | None = None  # columns that the earlier ones do not explain; None: not told

    def row(self, name: str) -> tuple[float, float]:
        k = self.names.index(name)
        return float(self.coefficients[k]), float(np.sqrt(max(0.0, self.covariance[k, k])))


def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Coefficients, inverse and kept columns of normal equations; a column that the earlier ones explain is left out, with 0."""
    k = len(b)
    kept: list[int] = []
    for i in range(k):
        trial = [*kept, i]
        scale = np.sqrt(np.outer(np.diag(a)[trial], np.diag(a)[trial]))
        if a[i, i] > 1e-12 and np.linalg.eigvalsh(a[np.ix_(trial, trial)] / np.where(scale > 0, scale, 1))[0] > 1e-9:
            kept = trial
    inverse = np.zeros((k, k))
    if kept:
        inverse[np.ix_(kept, kept)] = np.linalg.inv(a[np.ix_(kept, kept)])
    return inverse @ b, inverse, kept


def within_products(rows: DataFrame, id_col: str, ys: list[str], x: dict[str, Column]) -> DataFrame:
    """One row per person: of each outcome the sums of products of outcome and regressors, demeaned within the person.

    Columns n, yy, b{i} and a{i}_{j} follow the outcome's number.  A row without the outcome does not count for it; all
    outcomes are read in one pass and one shuffle by person.
    """
    k, aggregates = len(x), []
    flat = rows.select(id_col, *[F.col(y).cast("double").alias(f"y{o}") for o, y in enumerate(ys)], *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x.values())])
    for o in range(len(ys)):
        y = F.col(f"y{o}")
        known = lambda c: F.sum(F.when(y.isNotNull(), c))  # noqa: B023, E731
        n = F.count(y)
        centred = lambda u, v: known(u * v) - known(u) * known(v) / F.greatest(n, F.lit(1))  # noqa: B023, E731
        xs = [F.col(f"x{i}") for i in range(k)]
        aggregates += [n.alias(f"{o}_n"), centred(y, y).alias(f"{o}_yy"), *[centred(xs[i], y).alias(f"{o}_b{i}") for i in range(k)]]
        aggregates += [centred(xs[i], xs[j]).alias(f"{o}_a{i}_{j}") for i in range(k) for j in range(i, k)]
    return flat.groupBy(id_col).agg(*aggregates)


def within_fits(persons: DataFrame, names: list[str], outcomes: int, cluster: bool = False, use: list[list[int]] | None = None) -> list[Fit]:
    """Fits of all outcomes from their within_products, in one aggregate, and one more for clusters by person.

    use lists the regressors of each outcome (all by default).  Persons' effects are demeaned away and cost a degree of freedom each.
    """
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = lambda o, c: F.coalesce(F.sum(f"{o}_{c}"), F.lit(0.0)).alias(f"{o}_{c}")
    r = persons.agg(*[f for o in range(outcomes) for f in (F.coalesce(F.sum(f"{o}_n"), F.lit(0)).alias(f"{o}_n"), F.count_if(F.col(f"{o}_n") > 0).alias(f"{o}_persons"), total(o, "yy"), *[total(o, f"b{i}") for i in range(k)], *[total(o, f"a{i}_{j}") for i, j in pairs])]).first()
    fits, answers = [], []
    for o in range(outcomes):
        a, b = np.zeros((k, k)), np.array([r[f"{o}_b{i}"] for i in range(k)])
        for i, j in pairs:
            a[i, j] = a[j, i] = r[f"{o}_a{i}_{j}"]
        out = [i for i in range(k) if use is not None and i not in use[o]]
        a[out, :] = a[:, out] = 0.0
        b[out] = 0.0
        beta, inverse, kept = solved(a, b)
        rss = max(0.0, r[f"{o}_yy"] - 2 * beta @ b + beta @ a @ beta)
        n, dof = r[f"{o}_n"], r[f"{o}_n"] - len(kept) - r[f"{o}_persons"]
        covariance = inverse * (rss / dof if dof > 0 else float("nan"))
        fits.append(Fit(names, beta, covariance, n, dof, float(1 - rss / r[f"{o}_yy"]) if r[f"{o}_yy"] else 0.0))
        answers.append((beta, inverse))
    if cluster:
        entry = lambda o, i, j: F.col(f"{o}_a{min(i, j)}_{max(i, j)}")
        scores = persons.select(*[(F.col(f"{o}_b{i}") - sum((F.lit(float(answers[o][0][j])) * entry(o, i, j) for j in range(k)), F.lit(0.0))).alias(f"{o}_s{i}") for o in range(outcomes) for i in range(k)])
        m = scores.agg(*[F.coalesce(F.sum(F.col(f"{o}_s{i}") * F.col(f"{o}_s{j}")), F.lit(0.0)).alias(f"{o}_m{i}_{j}") for o in range(outcomes) for i, j in pairs]).first()
        for o in range(outcomes):
            meat = np.zeros((k, k))
            for i, j in pairs:
                meat[i, j] = meat[j, i] = m[f"{o}_m{i}_{j}"]
            groups = r[f"{o}_persons"]
            fits[o].covariance = answers[o][1] @ meat @ answers[o][1] * (groups / max(1, groups - 1))
    return fits


#: Periods of a two-way fit; the effects of all stand in each task.
MOST_PERIODS = 20_000


def two_way_fit(rows: DataFrame, y: str, x: dict[str, Column], id_col: str = "cf", period: str = "period", rounds: int = 200, tolerance: float = 1e-10) -> Fit:
    """Least squares with effects of persons and of periods, for any number of periods and unbalanced rows.

    Both effects are demeaned away in turns until they settle: a pass demeans by person what is left after the periods' effects and
    sums it by period, and conjugate gradients turn the sums into the next effects, for the outcome and all regressors in the same passes.
    So a pass sends on one row a period, where a dummy for each would take a square of them.  Persons are packed once, by one
    shuffle, and a person has few rows.  Rows with a null in any column are left out; periods and persons are taken to hang together (one period is the base).
    """
    names, flat = list(x), rows.select(F.col(id_col).alias("id"), F.col(period).alias("t"), F.col(y).cast("double").alias("v0"), *[c.cast("double").alias(f"v{i + 1}") for i, c in enumerate(x.values())]).dropna()
    k = len(names) + 1
    flat = tables.written(flat)
    times = [r.t for r in flat.select("t").distinct().orderBy("t").limit(MOST_PERIODS + 1).collect()]
    if len(times) > MOST_PERIODS:
        raise ValueError(f"a two-way fit takes {MOST_PERIODS} periods at most")
    if not times:
        return Fit(names, np.zeros(k - 1), np.zeros((k - 1, k - 1)), 0, 0, 0.0)
    numbers = rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(times)], rows.select(F.col(period).alias("t"), F.lit(0).alias("at")).schema)
    packed = tables.written(flat.join(F.broadcast(numbers), "t").groupBy("id").agg(F.collect_list(F.struct("at", *[f"v{i}" for i in range(k)])).alias("own")))  # MOST_PERIODS rows

    def demeaned(value) -> list[Column]:
        """Of each variable and person the array of value(row, variable) less its mean."""
        def centred(i: int) -> Column:
            values = F.transform("own", lambda r: value(r, i))
            mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
            both = F.array(F.struct(values.alias("a"), mean.alias("m")))
            return F.transform(both, lambda z: F.transform(z["a"], lambda v: v - z["m"]))[0]

        return [centred(i) for i in range(k)]

    def by_period(value) -> np.ndarray:
        """Sums by period of what is demeaned by person."""
        table = packed.select(F.col("own.at").alias("at"), *[d.alias(f"d{i}") for i, d in enumerate(demeaned(value))])
        sums = table.select(F.explode(F.arrays_zip("at", *[f"d{i}" for i in range(k)])).alias("r")).groupBy("r.at").agg(*[F.sum(f"r.d{i}").alias(f"s{i}") for i in range(k)])
        out = np.zeros((len(times), k))
        for r in sums.collect():  # a row a period
            out[r["at"]] = [r[f"s{i}"] for i in range(k)]
        return out

    of_period = lambda e: (lambda r, i: F.get(F.array(*[F.lit(float(v)) for v in e[:, i]]), r["at"]))
    effects = np.zeros((len(times), k))
    left = by_period(lambda r, i: r[f"v{i}"])
    step, size = left.copy(), (left**2).sum(0)
    goal = tolerance**2 * np.maximum(size, 1e-300)
    for _ in range(rounds):
        going = size > goal
        if not going.any():
            break
        moved = by_period(of_period(step))
        along = (step * moved).sum(0)
        a = np.where(going & (along > 0), size / np.where(along > 0, along, 1.0), 0.0)
        effects, left = effects + a * step, left - a * moved
        now = (left**2).sum(0)
        step = left + np.where(size > 0, now / np.where(size > 0, size, 1.0), 0.0) * step
        size = now
    kept_of = of_period(effects)
    whole = packed.select(*[d.alias(f"d{i}") for i, d in enumerate(demeaned(lambda r, i: r[f"v{i}"] - kept_of(r, i)))])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [F.sum(F.aggregate(F.zip_with(f"d{i}", f"d{j}", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)).alias(f"p{i}_{j}") for i, j in pairs]
    r = whole.agg(F.count("*").alias("persons"), F.sum(F.size("d0")).alias("n"), *products).first()
    a = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(1, k)] for i in range(1, k)]).reshape(k - 1, k - 1)
    b = np.array([r[f"p0_{i}"] for i in range(1, k)])
    beta, inverse, kept = solved(a, b)
    rss = max(0.0, r.p0_0 - 2 * beta @ b + beta @ a @ beta)
    dof = r.n - len(kept) - r.persons - (len(times) - 1)
    return Fit(names, beta, inverse * (rss / dof if dof > 0 else float("nan")), r.n, dof, float(1 - rss / r.p0_0) if r.p0_0 else 0.0)


def least_squares(rows: DataFrame, y: Column, x: dict[str, Column], weight: Column | None = None, absorbed: int = 0, cluster: Column | None = None, centred: bool = True) -> Fit:
    """Weighted least squares from one aggregate of cross products; only k x k sums come to the driver.

    Collinear columns get coefficient 0.  absorbed counts fixed effects that were demeaned away.  With a cluster the
    covariance is the sandwich of summed scores.
    """
    names = list(x)
    w = weight if weight is not None else F.lit(1.0)
    flat = rows.select(y.cast("double").alias("y"), w.cast("double").alias("w"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x.values())], *([cluster.alias("g")] if cluster is not None else [])).where("y IS NOT NULL AND w > 0")
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i, j in pairs] + [F.sum(F.col("w") * F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)]
    r = flat.agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"), *sums).first()
    a = np.zeros((k, k))
    for i, j in pairs:
        a[i, j] = a[j, i] = r[f"a{i}_{j}"] or 0.0
    b = np.array([r[f"b{i}"] or 0.0 for i in range(k)])
    beta, inverse, kept = solved(a, b)
    rss = max(0.0, (r.yy or 0.0) - 2 * beta @ b + beta @ a @ beta)
    dof = r.n - len(kept) - absorbed
    tss = ((r.yy or 0.0) - (r.sy**2 / r.sw if r.sw else 0.0)) if centred else r.yy or 0.0
    if cluster is None:
        covariance = inverse * (rss / dof if dof > 0 else float("nan"))
    else:
        e = F.col("y") - sum((F.lit(float(beta[i])) * F.col(f"x{i}") for i in kept), F.lit(0.0))
        scores = flat.groupBy("g").agg(*[F.sum(F.col("w") * e * F.col(f"x{i}")).alias(f"s{i}") for i in range(k)])
        m = scores.agg(F.count("*").alias("groups"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
        meat = np.zeros((k, k))
        for i, j in pairs:
            meat[i, j] = meat[j, i] = m[f"m{i}_{j}"]
        covariance = inverse @ meat @ inverse * (m.groups / max(1, m.groups - 1))
    return Fit(names, beta, covariance, r.n, dof, float(1 - rss / tss) if tss else 0.0, kept)


def did_panel(panel: DataFrame, treat: str = "is_treated", period: str = "period") -> DataFrame:
    """Adds t and p (0 or 1).  pre and post are 0 and 1; control rows count in both; other text periods raise."""
    kind = panel.schema[period].dataType.simpleString()
    rows = panel
    if kind == "string":
        odd = rows.where(~F.col(period).isin("pre", "post", "control")).limit(1).count()
        if odd:
            raise ValueError("text periods must be pre, post or control")
        places = F.when(F.col(period) == "control", F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col(period) == "post").cast("int")))
        rows = rows.withColumn("p", F.explode(places))
    else:
        first = rows.agg(F.min(period)).first()[0]
        rows = rows.withColumn("p", (F.col(period) != F.lit(first)).cast("int"))
    return rows.withColumn("t", F.col(treat).cast("int"))


def difference_in_differences(panel: DataFrame, outcomes: list[str], treat: str = "is_treated", period: str = "period", id_col: str = "cf", controls: list[str] | None = None, cluster: bool = False) -> list[dict]:
    """Two-way fixed effects (person and period) estimates of each outcome; a failed outcome has its error.

    Demeaning within persons and a period dummy equal both effects for two periods.  The period effect is left out where
    treatment and period nearly coincide or only one period is there.  The panel is read once for all outcomes: sums by
    person, from which the fits and the clustered errors follow.
    """
    rows, out = did_panel(panel, treat, period), {}
    known = [y for y in outcomes if y in rows.columns and not isinstance(rows.schema[y].dataType, (T.ArrayType, T.MapType, T.StructType))]
    for y in outcomes:
        if y not in known:
            out[y] = {"error": f"no column {y}" if y not in rows.columns else f"{y} is no number"}
    x = {"period": F.col("p"), "effect": F.col("t") * F.col("p")} | {c: F.col(c) for c in controls or []}
    persons = within_products(rows, id_col, known, x)
    side = lambda y, c: F.when(F.col(y).isNotNull(), c)
    shape = rows.groupBy(id_col).agg(*[f for o, y in enumerate(known) for f in (F.count(side(y, F.lit(1))).alias(f"{o}_c"), F.sum(side(y, F.col("t"))).alias(f"{o}_t"), F.sum(side(y, F.col("p"))).alias(f"{o}_p"), F.sum(side(y, F.col("t") * F.col("p"))).alias(f"{o}_tp"))])
    table = persons.join(shape, id_col).persist()  # both are by person: one shuffle
    try:
        sums = table.agg(*[F.coalesce(F.sum(f"{o}_{c}"), F.lit(0)).alias(f"{o}_{c}") for o in range(len(known)) for c in ("c", "t", "p", "tp")]).first() if known else None
        use = []
        for o in range(len(known)):
            n, t, p, tp = (float(sums[f"{o}_{c}"]) for c in ("c", "t", "p", "tp"))
            spread = (t - t * t / n) * (p - p * p / n) if n else 0.0  # t and p are 0 or 1
            alike = spread > 0 and abs(tp - t * p / n) / spread**0.5 > 0.9
            use.append([i for i, name in enumerate(x) if name != "period" or 0 < p < n and not alike])
        for y, fit in zip(known, within_fits(table, list(x), len(known), cluster, use) if known else [], strict=True):
            b, se = fit.row("effect")
            z = b / se if se else float("nan")
            p_value = stats.normal_sf2(z)
            out[y] = {"treatment_effect": b, "std_error": se, "t_statistic": z, "p_value": p_value, "conf_lower": b - 1.96 * se, "conf_upper": b + 1.96 * se, "significant": p_value < 0.05, "n_obs": fit.n, "r_squared": fit.r_squared}
    finally:
        table.unpersist()
    columns = ("treatment_effect", "std_error", "t_statistic", "p_value", "conf_lower", "conf_upper", "significant", "n_obs", "r_squared", "error")
    return [{"outcome": y} | {c: out[y].get(c) for c in columns} for y in outcomes]


def did_means(panel: DataFrame, outcome: str, treat: str = "is_treated", period: str = "period") -> DataFrame:
    """The four cell means and their double difference, one row."""
    rows = did_panel(panel, treat, period)
    cell = lambda t, p: F.avg(F.when((F.col("t") == t) & (F.col("p") == p), F.col(outcome)))
    out = rows.agg(cell(1, 0).alias("treated_pre"), cell(1, 1).alias("treated_post"), cell(0, 0).alias("control_pre"), cell(0, 1).alias("control_post"))
    return out.withColumn("did", F.col("treated_post") - F.col("treated_pre") - F.col("control_post") + F.col("control_pre"))


def event_bins(rows: DataFrame, unit: str = "month", window: tuple[int, int] = (-12, 12), days: str = "days_to_event") -> DataFrame:
    """Adds event_time: days to the event in days, weeks or months of 30 days, inside the window.  Controls need pseudo-event times."""
    width = {"day": 1, "week": 7, "month": 30}[unit]
    out = rows.withColumn("event_time", F.floor(F.col(days) / width).cast("int"))
    return out.where(F.col("event_time").between(*window))


def event_study(rows: DataFrame, outcomes: list[str], treat: str = "is_treated", id_col: str = "cf", omit: int = -1) -> list[dict]:
    """Effects of each event time against the omitted one, with fixed effects of person and event time, and the zero reference row."""
    if rows.where(~F.col(treat).cast("boolean")).limit(1).count() == 0:
        raise ValueError("controls need an event_time of their own")
    times = sorted(r[0] for r in rows.select("event_time").distinct().collect())
    name = lambda t: f"lead_{-t}" if t < 0 else f"lag_{t}"
    x = {f"at_{name(t)}": (F.col("event_time") == t).cast("double") for t in times if t != omit}
    x |= {name(t): ((F.col("event_time") == t) & F.col(treat).cast("boolean")).cast("double") for t in times if t != omit}
    persons, out = within_products(rows, id_col, outcomes, x).persist(), []
    try:
        fits = within_fits(persons, list(x), len(outcomes))
    finally:
        persons.unpersist()
    for y, fit in zip(outcomes, fits, strict=True):
        for t in times:
            b, se = (0.0, 0.0) if t == omit else fit.row(name(t))
            z = b / se if se else 0.0
            out.append({"outcome": y, "event_time": t, "coefficient": b, "std_error": se, "t_statistic": z, "p_value": stats.normal_sf2(z), "conf_lower": b - 1.96 * se, "conf_upper": b + 1.96 * se})
    return out


def pre_trend_test(estimates: list[dict]) -> dict | None:
    pre = [e for e in estimates if e["event_time"] < 0 and e["std_error"]]
    if not pre:
        return None
    f = sum((e["coefficient"] / e["std_error"]) ** 2 for e in pre) / len(pre)
    return {"test_statistic": f, "df": len(pre), "p_value": stats.f_sf(f, len(pre), float("inf"))}


def dynamic_summary(estimates: DataFrame) -> DataFrame:
    """Mean effects before and after, at 0 and at the last event time; one row an outcome."""
    t, b = F.col("event_time"), F.col("coefficient")
    return estimates.groupBy("outcome").agg(F.avg(F.when(t < 0, b)).alias("pre_treatment_avg"), F.avg(F.when(t > 0, b)).alias("post_treatment_avg"), F.max(F.when(t == 0, b)).alias("immediate_effect"), F.max_by(F.when(t > 0, b), F.when(t > 0, t)).alias("long_term_effect"))


def adjust_p(effects: DataFrame, method: str) -> DataFrame:
    """Adds adjusted_p_value: bonferroni, holm, fdr or none.  A null p stays null and counts for bonferroni only."""
    p = F.col("p_value")
    whole = Window.partitionBy()  # effects are few
    if method == "bonferroni":
        return effects.withColumn("adjusted_p_value", F.when(p.isNotNull(), F.least(F.lit(1.0), p * F.count("*").over(whole))))
    if method not in ("holm", "fdr"):
        return effects.withColumn("adjusted_p_value", p)
    m = F.count("p_value").over(whole)
    order = Window.partitionBy().orderBy(F.asc_nulls_last("p_value"), *[c for c in ("outcome", "method") if c in effects.columns])
    ranked = effects.withColumns({"__r": F.row_number().over(order), "__m": m})
    if method == "holm":
        x = F.max((F.col("__m") - F.col("__r") + 1) * p).over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        x = F.min(F.col("__m") * p / F.col("__r")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("adjusted_p_value", F.when(p.isNotNull(), F.least(F.lit(1.0), x))).drop("__r", "__m")


def pool(effects: DataFrame, how: str = "meta_analysis", weights: str = "inv_var", confidence: float = 0.95) -> DataFrame:
    """The pooled effect in one row: simple_average, weighted_average or meta_analysis (DerSimonian-Laird), with Q and I squared."""
    w = {"inv_var": F.try_divide(F.lit(1.0), F.col("std_error") * F.col("std_error")), "n_obs": F.coalesce(F.col("n_obs").cast("double"), F.avg("n_obs").over(Window.partitionBy())) if weights == "n_obs" else None, "equal": F.lit(1.0)}[weights]
    rows = effects.withColumns({"w": w, "e": F.col("treatment_effect"), "v": F.col("std_error") * F.col("std_error")})
    methods = F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("methods_used")
    if how == "simple_average":
        out = rows.agg(F.avg("e").alias("pooled_effect"), F.sqrt(F.avg("v")).alias("pooled_se"), F.count("*").alias("n_effects"), methods)
    elif how == "weighted_average":
        out = rows.agg((F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("pooled_effect"), F.sqrt(1 / F.sum("w")).alias("pooled_se"), F.count("*").alias("n_effects"), methods, F.sum("w").alias("total_weight"))
    else:
        fixed = rows.agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), (F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("mean"))
        q = rows.join(F.broadcast(fixed))  # one row
        q = q.groupBy("sw", "sww").agg(F.sum(F.col("w") * F.pow(F.col("e") - F.col("mean"), F.lit(2))).alias("q"), F.count("*").alias("n"))
        tau = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("n") - 1), F.col("sw") - F.col("sww") / F.col("sw")), F.lit(0.0)))
        q = q.select(F.col("q").alias("q_statistic"), tau.alias("tau_squared"), (100 * F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("n") - 1), F.col("q")), F.lit(0.0)))).alias("i_squared"))
        both = rows.join(F.broadcast(q)).withColumn("a", 1 / (1 / F.col("w") + F.col("tau_squared")))
        out = both.groupBy("q_statistic", "tau_squared", "i_squared").agg((F.sum(F.col("a") * F.col("e")) / F.sum("a")).alias("pooled_effect"), F.sqrt(1 / F.sum("a")).alias("pooled_se"), F.count("*").alias("n_effects"), methods)
    z = stats.normal_quantile(1 - (1 - confidence) / 2)
    b, se = F.col("pooled_effect"), F.col("pooled_se")
    return out.withColumns({"z_statistic": b / se, "overall_conf_lower": b - z * se, "overall_conf_upper": b + z * se})


def effects_of(spark, did: list[dict] | None = None, study: list[dict] | None = None, synthetic: list[dict] | None = None) -> DataFrame:
    """The effects table that pool and adjust_p take, from results of the estimators: one effect an outcome and estimator.

    Event times of one study are no independent studies: their effect is the mean over the times after the event, with the root of the mean squared
    error as its error.  That of a synthetic control is the mean gap from the treatment on (rows of outcome, time_period, counted from it, and
    treatment_effect) with the error of that mean.  Both have normal p-values.  Rows with an error or without a standard error are left out.
    """
    rows = [("did", r["outcome"], "DiD", r["treatment_effect"], r["std_error"], r["p_value"], r["n_obs"]) for r in did or [] if r.get("error") is None]

    def mean_of(kind: str, method: str, found: list[dict], error) -> None:
        for y in sorted({r["outcome"] for r in found}):
            own = [r for r in found if r["outcome"] == y]
            effects = [r["effect"] for r in own if r["effect"] is not None]
            if effects and (se := error(own, effects)):
                effect = sum(effects) / len(effects)
                rows.append((kind, y, method, effect, se, stats.normal_sf2(effect / se), None))

    after = [{"outcome": r["outcome"], "effect": r["coefficient"], "se": r["std_error"]} for r in study or [] if r["event_time"] > 0]
    known = lambda own: [r["se"] ** 2 for r in own if r["se"] is not None]
    mean_of("event_study", "Event Study", after, lambda own, _: (sum(known(own)) / len(known(own))) ** 0.5 if known(own) else None)
    gaps = [{"outcome": r["outcome"], "effect": r["treatment_effect"]} for r in synthetic or [] if r["time_period"] >= 0]
    mean_of("synth", "Synthetic Control", gaps, lambda own, effects: float(np.std(effects, ddof=1)) / len(own) ** 0.5 if len(effects) > 1 else None)
    schema = "effect_id string, outcome string, method string, treatment_effect double, std_error double, p_value double, n_obs long"
    return spark.createDataFrame([(f"{kind}_{y}", y, *rest) for kind, y, *rest in rows if rest[2]], schema)


def heterogeneity(effects: DataFrame) -> dict:
    """Cochran's Q with its p-value."""
    r = pool(effects, "meta_analysis").first()
    df = r.n_effects - 1
    p = stats.chi2_sf(r.q_statistic, df)
    return {"q_statistic": r.q_statistic, "df": df, "p_value": p, "significant_heterogeneity": p < 0.05, "i_squared": r.i_squared}


#: Cells of units x times that may come to the driver.
MOST_CELLS = 1_000_000


def synthetic_control(panel: DataFrame, outcome: str, unit: str, time: str, treated_unit, first_treated, rounds: int = 2000, ridge: float = 0.0) -> tuple[list[tuple], list[tuple]]:
    """Donor weights (non-negative, sum 1) that fit the treated unit before treatment, and the gap at each time.

    The panel is first averaged to units x times, which is what comes to the driver (more than MOST_CELLS raise); the
    fit is by projected gradient.  With a ridge the weights are augmented by a ridge fit of what is left before treatment.
    """
    cells = panel.groupBy(unit, time).agg(F.avg(outcome).alias("y")).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of units and times: aggregate the units first")
    value = {(r[unit], r[time]): r["y"] for r in cells}
    times = sorted({r[time] for r in cells if (treated_unit, r[time]) in value})
    donors = sorted({r[unit] for r in cells if r[unit] != treated_unit and all((r[unit], t) in value for t in times)})
    y = np.array([value[treated_unit, t] for t in times], float)
    x = np.array([[value[d, t] for d in donors] for t in times], float)
    pre = np.array([t < first_treated for t in times])
    w = np.full(len(donors), 1 / max(1, len(donors)))
    a, b = x[pre], y[pre]
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-12) if a.size else 0.0
    for _ in range(rounds):
        w = _to_simplex(w - step * (a.T @ (a @ w - b)))
    if ridge > 0 and a.size:
        w = w + a.T @ np.linalg.solve(a @ a.T + ridge * np.eye(len(b)), b - a @ w)
    gaps = y - x @ w
    return [(d, float(v)) for d, v in zip(donors, w, strict=True) if v > 0.001], [(t, float(o), float(o - g), float(g)) for t, o, g in zip(times, y, gaps, strict=True)]


def conformal_inference(path: list[tuple], first_treated, confidence: float = 0.95) -> dict:
    """What the gaps of synthetic_control say: the average effect after treatment, its p-value by moving blocks, and bounds.

    The statistic is the mean absolute gap after treatment; its rank among all cyclic shifts of the gaps is the p-value
    (Chernozhukov, Wuethrich and Zhu, 2021).  Bounds are the average effect plus and minus the conformal quantile of the
    absolute gaps before treatment; pre_rmse and pre_r_squared measure the balance before it.
    """
    gaps = np.array([g for *_, g in path], float)
    seen = np.array([y for _, y, *_ in path], float)
    after = np.array([t >= first_treated for t, *_ in path])
    n, post = len(gaps), int(after.sum())
    if not post or post == n:
        return {"average_effect": None, "p_value": None, "ci_lower": None, "ci_upper": None, "pre_rmse": None, "pre_r_squared": None, "n_pre": n - post, "n_post": post}
    order = np.concatenate([gaps[~after], gaps[after]])
    statistic = [float(np.abs(np.roll(order, k)[-post:]).mean()) for k in range(n)]
    p = sum(v >= statistic[0] - 1e-12 for v in statistic) / n
    before = np.sort(np.abs(gaps[~after]))
    place = min(len(before), int(np.ceil((len(before) + 1) * confidence)))
    half, effect = float(before[place - 1]), float(gaps[after].mean())
    spread = float(((seen[~after] - seen[~after].mean()) ** 2).sum())
    rss = float((gaps[~after] ** 2).sum())
    return {"average_effect": effect, "p_value": p, "ci_lower": effect - half, "ci_upper": effect + half, "pre_rmse": (rss / len(before)) ** 0.5, "pre_r_squared": 1 - rss / spread if spread else None, "n_pre": n - post, "n_post": post}


def _to_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    css = np.cumsum(u) - 1
    k = np.flatnonzero(u - css / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - css[k] / (k + 1), 0)


def group_means(panel: DataFrame, outcomes: list[str], treat: str = "is_treated", period: str = "period") -> DataFrame:
    """Mean, spread and size of each outcome by treatment and period: the data of trend and comparison charts."""
    long = panel.select(treat, period, *[F.col(c).cast("double").alias(c) for c in outcomes]).unpivot([treat, period], outcomes, "outcome", "value")
    return long.groupBy("outcome", treat, period).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
