"""Tail probabilities without a statistics package: series and continued fractions of the incomplete beta and gamma functions."""

from __future__ import annotations

import math

import numpy as np

_LEGENDRE = np.polynomial.legendre.leggauss(64)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _invert(normal_cdf, p, -40.0, 40.0)


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    return _invert(lambda x: t_cdf(x, df), p, -1e4, 1e4)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


def studentised_range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) for k means and df degrees of freedom: Gauss-Legendre over the scale of the range's distribution."""
    if q <= 0:
        return 1.0
    x, w = _LEGENDRE
    z = 8.5 * x
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(normal_cdf)

    def range_cdf(r: float) -> float:
        inner = np.maximum(cdf(z) - cdf(z - r), 0) ** (k - 1)
        return float(k * np.sum(w * 8.5 * phi * inner))

    if df > 5000:
        return 1 - range_cdf(q)
    half = df / 2
    spread = 12 / math.sqrt(2 * df)
    lo, hi = max(1e-6, 1 - spread), 1 + spread
    s = (hi - lo) / 2 * x + (hi + lo) / 2
    log_density = math.log(2) + half * math.log(half) - math.lgamma(half) + (df - 1) * np.log(s) - half * s * s
    return float(1 - np.sum(w * (hi - lo) / 2 * np.exp(log_density) * np.array([range_cdf(q * v) for v in s])))
