"""Tails of the distributions that tests need; everything here works on single fitted numbers on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, else a continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2) if df > 0 else 1.0


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return _beta_i(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def f_sf(f: float, df1: float, df2: float) -> float:
    if math.isinf(df2):
        return chi2_sf(f * df1, df1)
    return _beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """The quantile by bisection."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_sf2(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_sf2(middle, df) / 2 < p else (low, middle)
    return (low + high) / 2


def kolmogorov_sf(x: float) -> float:
    """The asymptotic tail of the Kolmogorov-Smirnov statistic scaled by sqrt(n m / (n + m))."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
