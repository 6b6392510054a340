"""Distribution functions, from series and continued fractions; no library beyond the standard one."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def norm_ppf_of(p):
    """Normal quantiles of an array, by Newton steps from a rational first guess (Abramowitz and Stegun 26.2.23)."""
    import numpy as np

    p = np.asarray(p, dtype=float)
    low = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(low))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    erfc = np.frompyfunc(math.erfc, 1, 1)
    for _ in range(3):
        upper = 0.5 * erfc(z / math.sqrt(2)).astype(float)
        z = z + (upper - low) * math.sqrt(2 * math.pi) * np.exp(z * z / 2)
    return np.where(p < 0.5, -z, z)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * front)
    # Lentz's continued fraction for the upper function
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def t_cdf(t: float, df: float) -> float:
    tail = t_sf2(t, df) / 2
    return 1 - tail if t > 0 else tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _solve(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):  # neighbours
            break
        if f(mid) < 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_ppf(p: float, df: float) -> float:
    return _solve(lambda x: t_cdf(x, df) - p, -1e3, 1e3)


def _poisson(rate: float, shift: float, lo: int, hi: int):
    """rate**j / gamma(j + 1) * exp(-rate) for j = shift + lo to shift + hi, as an array: by logarithms of ratios from the term next to the rate."""
    import numpy as np

    start = min(hi, max(lo, int(rate - shift)))
    j = start + shift
    if j < 1000:
        log = j * math.log(rate) - rate - math.lgamma(j + 1)
    else:  # Stirling's series: lgamma and the powers lose more digits the larger they are
        d = (rate - j) / j
        log = j * (math.log1p(d) - d) - 0.5 * math.log(2 * math.pi * j) - 1 / (12 * j) + 1 / (360 * j**3)
    steps = math.log(rate) - np.log(np.arange(lo + 1, hi + 1) + shift)
    up, down = np.cumsum(steps[start - lo :]), np.cumsum(steps[: start - lo][::-1])[::-1]
    return np.exp(log + np.concatenate([-down, [0.0], up]))


def ncx2_cdf(x: float, df: float, nc: float) -> float:
    """Non-central chi-square: a Poisson mixture of central ones.

    The central ones are sums of the same kind of terms, from their own index upwards.
    Only terms within nine deviations of the largest count, so the work grows with the
    square root of x and nc.
    """
    if nc <= 0:
        return gamma_p(df / 2, x / 2)
    if x <= 0:
        return 0.0
    import numpy as np

    spans = []
    for rate, shift in ((nc / 2, 0.0), (x / 2, df / 2)):
        wide = 9 * math.sqrt(rate)
        lo = max(0, int(rate - shift - wide))
        spans.append((lo, max(lo, int(rate - shift + wide) + 60)))
    (lo, hi), (first, last) = spans
    upper = np.concatenate([np.cumsum(_poisson(x / 2, df / 2, first, last)[::-1])[::-1], [0.0]])
    k = np.clip(np.arange(lo, hi + 1), first, last + 1) - first
    return min(1.0, float(_poisson(nc / 2, 0.0, lo, hi) @ upper[k]))


def ncx2_nc(x: float, df: float, p: float) -> float:
    """The non-centrality at which ncx2_cdf(x) = p; 0 where none is so small."""
    if ncx2_cdf(x, df, 0) <= p:
        return 0.0
    return _solve(lambda nc: p - ncx2_cdf(x, df, nc), 0.0, 4 * x + 200)


def type7(values, p: float) -> float:
    """Quantile by linear interpolation at (n - 1) p of the sorted values."""
    v = sorted(values)
    h = (len(v) - 1) * p
    lo = math.floor(h)
    return v[lo] + (h - lo) * (v[min(lo + 1, len(v) - 1)] - v[lo])
