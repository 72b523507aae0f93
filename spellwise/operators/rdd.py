"""Regression discontinuity: bandwidths, sharp and fuzzy estimates, robustness, placebo cutoffs and the density test."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ordering, stats
from .estimation import Fit, least_squares, solved

KERNELS = ("triangular", "rectangular", "epanechnikov")


def centred(rows: DataFrame, running: str, cutoff: float, *more: str) -> DataFrame:
    """Complete rows with x, the running variable less the cutoff."""
    keep = [running, *more]
    return rows.dropna(subset=keep).withColumn("x", F.col(running).cast("double") - F.lit(float(cutoff)))


def bandwidth(rows: DataFrame, method: str = "rot") -> DataFrame:
    """One row: the rule-of-thumb bandwidth 1.84 sd n^(-1/5) of x, times .8 (mserd) or 1.2 (cerrd)."""
    factor = {"mserd": 0.8, "cerrd": 1.2}.get(method, 1.0)
    return rows.agg((factor * 1.84 * F.stddev_samp("x") * F.pow(F.count("x"), F.lit(-0.2))).alias("bandwidth"), F.count("x").alias("n"))


def kernel_weight(kernel: str, h: float) -> Column:
    u = F.col("x") / h
    if kernel == "rectangular":
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), 1 - F.abs(u)) if kernel == "triangular" else F.greatest(F.lit(0.0), 0.75 * (1 - u * u))


def _fit(rows: DataFrame, outcome: str, order: int, kernel: str, h: float, covariates: list[str] | None) -> Fit:
    inside = rows.where(F.abs("x") <= h)
    above = (F.col("x") >= 0).cast("double")
    x = {"one": F.lit(1.0), "above": above}
    for p in range(1, order + 1):
        x |= {f"x{p}": F.pow(F.col("x") / h, F.lit(p)), f"above_x{p}": above * F.pow(F.col("x") / h, F.lit(p))}
    x |= {c: F.col(c).cast("double") for c in covariates or []}
    return least_squares(inside, F.col(outcome), x, kernel_weight(kernel, h))


def _jump(fit: Fit) -> tuple[float | None, float | None]:
    """The jump and its error; None where the bandwidth has rows on one side only, which no jump follows from."""
    return fit.row("above") if fit.names.index("above") in fit.kept else (None, None)


def _estimate(b: float | None, se: float | None, df: int, alpha: float) -> dict:
    if b is None:
        return {"parameter": "treatment_effect"} | dict.fromkeys(("estimate", "std_error", "t_statistic", "p_value", "ci_lower", "ci_upper"))
    t = b / se if se else float("nan")
    half = stats.t_quantile(1 - alpha / 2, df) * se if df > 0 else float("nan")
    return {"parameter": "treatment_effect", "estimate": b, "std_error": se, "t_statistic": t, "p_value": stats.t_sf2(t, df), "ci_lower": b - half, "ci_upper": b + half}


def sharp(rows: DataFrame, outcome: str, running: str, cutoff: float, order: int = 1, kernel: str = "triangular", h: float | None = None, method: str = "mserd", covariates: list[str] | None = None, alpha: float = 0.05) -> dict:
    """The jump at the cutoff by local polynomial weighted least squares; None if the bandwidth has rows on one side only."""
    own = centred(rows, running, cutoff, outcome, *(covariates or []))
    h = h or bandwidth(own, method).first().bandwidth
    fit = _fit(own, outcome, order, kernel, h, covariates)
    b, se = _jump(fit)
    return _estimate(b, se, fit.dof, alpha) | {"bandwidth": h, "n_total": fit.n, "r_squared": fit.r_squared}


def fuzzy(rows: DataFrame, outcome: str, treatment: str, running: str, cutoff: float, order: int = 1, kernel: str = "triangular", h: float | None = None, method: str = "mserd", alpha: float = 0.05) -> dict:
    """The Wald ratio of the jumps of outcome and treatment, with the delta-method error; None if the bandwidth has rows on one side only."""
    own = centred(rows, running, cutoff, outcome, treatment).withColumn("__t", F.col(treatment).cast("double"))
    h = h or bandwidth(own, method).first().bandwidth
    first, reduced = _fit(own, "__t", order, kernel, h, None), _fit(own, outcome, order, kernel, h, None)
    (fs, se_fs), (rf, se_rf) = _jump(first), _jump(reduced)
    if fs is None:
        return _estimate(None, None, first.dof, alpha) | {"bandwidth": h, "first_stage": None, "n_total": reduced.n}
    if abs(fs) < 1e-10:
        raise ValueError("the first stage is too weak")
    b = rf / fs
    return _estimate(b, math.sqrt(se_rf**2 + b * b * se_fs**2) / abs(fs), min(first.dof, reduced.dof), alpha) | {"bandwidth": h, "first_stage": fs, "n_total": reduced.n}


#: Kernels as polynomials of the distance in bandwidths.
_KERNEL = {"rectangular": (1.0,), "triangular": (1.0, -1.0), "epanechnikov": (0.75, 0.0, -0.75)}


class Moments:
    """Sums of powers of x and the outcome by cutoff, side and ring of distance: all that estimates at these cutoffs and bandwidths need."""

    def __init__(self, rows: DataFrame, outcome: str, cutoffs: list[float], widths: list[float], order: int) -> None:
        """rows have x; one pass.  Rings are the distances between two widths, and each width itself."""
        self.widths, self.powers = sorted(set(widths)), 2 * order + 3
        far = self.widths[-1]
        near = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("x") - F.lit(float(c))).alias("d")) for k, c in enumerate(cutoffs)]), lambda c: F.abs(c["d"]) <= far)
        met = rows.select(F.col(outcome).cast("double").alias("y"), F.explode(near).alias("c")).select("y", "c.*").where("y IS NOT NULL")
        ring = sum((2 * (F.abs("d") > w).cast("int") + (F.abs("d") == w).cast("int") for w in self.widths), F.lit(0))
        u = F.col("d") / far
        sums = [F.sum(F.pow(u, F.lit(p)) * F.pow(F.col("y"), F.lit(q)) if p else F.pow(F.col("y"), F.lit(q))).alias(f"m{p}_{q}") for q in (0, 1, 2) for p in range(self.powers if q < 2 else 3)]
        found = met.groupBy("k", (F.col("d") >= 0).alias("right"), ring.alias("ring")).agg(F.count("*").alias("n"), *sums).collect()  # cutoffs x sides x rings
        self.sums: dict = {}
        for r in found:
            self.sums.setdefault((r.k, r.right), []).append(r)

    def rows_within(self, k: int, h: float) -> int:
        last = 2 * self.widths.index(h) + 1
        return sum(r.n for side in (False, True) for r in self.sums.get((k, side), []) if r.ring <= last)

    def fit(self, k: int, h: float, order: int, kernel: str) -> Fit:
        """The local polynomial fit at cutoff k, as least_squares gives it."""
        at, shape = self.widths.index(h), _KERNEL[kernel]
        last = 2 * at + (1 if kernel == "rectangular" else 0)  # at the very bandwidth the other kernels are 0
        names = ["one", "above", *[f"{side}x{p}" for p in range(1, order + 1) for side in ("", "above_")]]
        power = [0, 0, *[p for p in range(1, order + 1) for _ in range(2)]]
        a, b, n, sw, sy, yy = np.zeros((len(names), len(names))), np.zeros(len(names)), 0, 0.0, 0.0, 0.0
        scale = self.widths[-1] / h
        for right in (False, True):
            own = [r for r in self.sums.get((k, right), []) if r.ring <= last]
            n += sum(r.n for r in own)
            moment = lambda p, q, own=own, right=right: sum(c * (1 if right else -1) ** e * scale ** (p + e) * sum(r[f"m{p + e}_{q}"] for r in own) for e, c in enumerate(shape) if c)
            sw, sy, yy = sw + moment(0, 0), sy + moment(0, 1), yy + moment(0, 2)
            used = [i for i, name in enumerate(names) if right or not name.startswith("above")]
            for i in used:
                b[i] += moment(power[i], 1)
                for j in used:
                    a[i, j] += moment(power[i] + power[j], 0)
        beta, inverse, kept = solved(a, b)
        rss = max(0.0, yy - 2 * beta @ b + beta @ a @ beta)
        dof = n - len(kept)
        tss = yy - sy**2 / sw if sw else 0.0
        return Fit(names, beta, inverse * (rss / dof if dof > 0 else float("nan")), n, dof, float(1 - rss / tss) if tss else 0.0, kept)


def _spread(rows: DataFrame) -> tuple[float, float, float]:
    """The mserd bandwidth and the ends of x, in one pass."""
    r = rows.agg((0.8 * 1.84 * F.stddev_samp("x") * F.pow(F.count("x"), F.lit(-0.2))).alias("h"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    return r.h, r.low, r.high


def robustness(rows: DataFrame, outcome: str, running: str, cutoff: float, multipliers: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5), orders: tuple[int, ...] = (1, 2, 3), kernels: tuple[str, ...] = KERNELS, alpha: float = 0.05) -> list[dict]:
    """Estimates under other bandwidths, orders and kernels: one pass for the bandwidth and one for all estimates."""
    own = centred(rows, running, cutoff, outcome)
    h = _spread(own)[0]
    runs = [("bandwidth", m, 1, "triangular", h * m) for m in multipliers] + [("order", p, p, "triangular", h) for p in orders] + [("kernel", k, 1, k, h) for k in kernels]
    moments = Moments(own, outcome, [0.0], [width for *_, width in runs], max([1, *orders]))
    out = []
    for check, value, order, kernel, width in runs:
        fit = moments.fit(0, width, order, kernel)
        out.append({"check": check, "value": str(value)} | _estimate(*_jump(fit), fit.dof, alpha) | {"bandwidth": width, "n_total": fit.n, "r_squared": fit.r_squared})
    return out


def placebo(rows: DataFrame, outcome: str, running: str, cutoff: float, cutoffs: list[float] | None = None, least_rows: int = 20, alpha: float = 0.05) -> list[dict]:
    """Estimates at cutoffs where nothing happens: by default spread over the range outside two bandwidths; two passes for all."""
    own = centred(rows, running, cutoff, outcome)
    h, low, high = _spread(own)
    if cutoffs is None:
        cutoffs = [cutoff + c for c in [low + (high - low) * k / 10 for k in range(1, 10)] if abs(c) > 2 * h]
    moments, out = Moments(own, outcome, [c - cutoff for c in cutoffs], [h], 1), []
    for k, c in enumerate(cutoffs):
        if moments.rows_within(k, h) >= least_rows:
            fit = moments.fit(k, h, 1, "triangular")
            out.append({"cutoff": c} | _estimate(*_jump(fit), fit.dof, alpha) | {"bandwidth": h, "n_total": fit.n, "r_squared": fit.r_squared})
    return out


def bins(rows: DataFrame, outcome: str, width: float, least: int = 3, z: float = 1.96) -> DataFrame:
    """Means of the outcome by bins of x (round half up of x / width), with standard errors, for three rows or more."""
    out = rows.groupBy((F.floor(F.col("x") / width + 0.5) * width).alias("bin")).agg(F.avg(outcome).alias("mean"), (F.stddev_samp(outcome) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).withColumns({"ci_lower": F.col("mean") - z * F.col("se"), "ci_upper": F.col("mean") + z * F.col("se"), "side": F.when(F.col("bin") >= 0, "right").otherwise("left")})


def density_test(rows: DataFrame, width: float | None = None) -> dict:
    """The jump of the log density of x at 0 over two bins a side, with a normal p-value."""
    r = rows.agg(F.count("x").alias("n")).first()
    if not width:
        low, high = ordering.quantiles(rows, "x", [0.25, 0.75])
        width = 2 * (high - low) * r.n ** (-1 / 3)
    d = density_counts(rows, width).first()
    out = {"method": "binned", "bin_size": width, "density_left": d.n_left / (2 * width * r.n), "density_right": d.n_right / (2 * width * r.n), "test_statistic": None, "p_value": None, "log_density_jump": None}
    if d.n_left and d.n_right:
        jump = math.log(d.n_right / d.n_left)
        z = jump / math.sqrt(1 / d.n_left + 1 / d.n_right)
        out |= {"log_density_jump": jump, "test_statistic": z, "p_value": stats.normal_sf2(z)}
    return out


def density_counts(rows: DataFrame, width: float) -> DataFrame:
    """Rows within two bins on each side of 0."""
    x = F.col("x")
    return rows.agg(C.count_if((x < 0) & (x >= -2 * width)).alias("n_left"), C.count_if((x >= 0) & (x <= 2 * width)).alias("n_right"), F.count("x").alias("n"))


def histogram(rows: DataFrame, count: int = 30) -> DataFrame:
    """Right-closed bins of equal width over the range of x, the lowest value included; only counts by bin leave the tasks."""
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    width = (high - low) / count or 1.0
    k = F.greatest(F.lit(1), F.ceil((F.col("x") - low) / width)).cast("int")
    out = rows.where("x IS NOT NULL").groupBy(F.least(F.lit(count), k).alias("bin")).agg(F.count("*").alias("n"))
    middle = low + (F.col("bin") - 0.5) * width
    return out.select("bin", middle.alias("mid"), "n", F.when(middle < 0, "left").otherwise("right").alias("side"))
