"""Extreme-value distributions in NumPy: fits by L-moments, distribution functions, quantiles, goodness of fit."""

from __future__ import annotations

import math

import numpy as np

EULER = 0.5772156649015329


def l_moments(x: np.ndarray) -> tuple[float, float, float]:
    """First two sample L-moments and the L-skewness."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    i = np.arange(n)
    b0 = x.mean()
    b1 = (i * x).sum() / (n * (n - 1))
    b2 = (i * (i - 1) * x).sum() / (n * (n - 1) * (n - 2))
    l2 = 2 * b1 - b0
    return b0, l2, (6 * b2 - 6 * b1 + b0) / l2 if l2 else 0.0


def _gev(x):
    l1, l2, t3 = l_moments(x)
    c = 2 / (3 + t3) - math.log(2) / math.log(3)
    k = 7.8590 * c + 2.9554 * c * c
    if abs(k) < 1e-6:
        scale = l2 / math.log(2)
        return 0.0, l1 - EULER * scale, scale
    g = math.gamma(1 + k)
    scale = l2 * k / ((1 - 2**-k) * g)
    return k, l1 - scale * (1 - g) / k, scale


def _gumbel(x):
    l1, l2, _ = l_moments(x)
    scale = l2 / math.log(2)
    return 0.0, l1 - EULER * scale, scale


def _weibull(x):
    """Weibull with three parameters: a reversed GEV fit of the mirrored sample."""
    k, loc, scale = _gev(-np.asarray(x, float))
    k = max(k, 1e-3)
    shape, width = 1 / k, scale / k
    return shape, -(loc + width), width


def _genpareto(x):
    l1, l2, t3 = l_moments(x)
    k = (1 - 3 * t3) / (1 + t3)
    scale = (1 + k) * (2 + k) * l2
    return k, l1 - (2 + k) * l2, scale


def _pearson3(x):
    l1, l2, t3 = l_moments(x)
    a = abs(t3)
    if a < 1e-6:
        return 0.0, l1, l2 * math.sqrt(math.pi)
    if a < 1 / 3:
        z = 3 * math.pi * t3 * t3
        alpha = (1 + 0.2906 * z) / (z + 0.1882 * z * z + 0.0442 * z**3)
    else:
        z = 1 - a
        alpha = (0.36067 * z - 0.59567 * z * z + 0.25361 * z**3) / (1 - 2.78861 * z + 2.56096 * z * z - 0.77045 * z**3)
    sd = math.sqrt(math.pi) * math.sqrt(alpha) * l2 * math.exp(math.lgamma(alpha) - math.lgamma(alpha + 0.5))
    return math.copysign(2 / math.sqrt(alpha), t3), l1, sd


FITS = {"gev": _gev, "gumbel": _gumbel, "weibull": _weibull, "genpareto": _genpareto, "pearson3": _pearson3}


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return min(1.0, front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def cdf(kind: str, p: tuple, x: float) -> float:
    k, loc, scale = p
    if kind in ("gev", "gumbel"):
        y = (x - loc) / scale
        if k == 0:
            return math.exp(-math.exp(-y))
        z = 1 - k * y
        return math.exp(-(z ** (1 / k))) if z > 0 else (1.0 if k > 0 else 0.0)
    if kind == "weibull":
        z = (x - loc) / scale
        return 1 - math.exp(-(z**k)) if z > 0 else 0.0
    if kind == "genpareto":
        y = (x - loc) / scale
        if y <= 0:
            return 0.0
        if abs(k) < 1e-9:
            return 1 - math.exp(-y)
        z = 1 - k * y
        return 1 - z ** (1 / k) if z > 0 else 1.0
    if abs(k) < 1e-6:
        return 0.5 * math.erfc(-(x - loc) / scale / math.sqrt(2))
    alpha = 4 / (k * k)
    y = alpha + 2 / k * (x - loc) / scale  # of a gamma with shape alpha and scale 1
    return gamma_p(alpha, y) if k > 0 else 1 - gamma_p(alpha, y)


def quantile(kind: str, p: tuple, q: float) -> float:
    k, loc, scale = p
    if kind in ("gev", "gumbel"):
        y = -math.log(q)
        return loc + scale * (1 - y**k) / k if k else loc - scale * math.log(y)
    if kind == "weibull":
        return loc + scale * (-math.log(1 - q)) ** (1 / k)
    if kind == "genpareto":
        return loc + scale * (1 - (1 - q) ** k) / k if abs(k) > 1e-9 else loc - scale * math.log(1 - q)
    low, high = loc - 50 * scale, loc + 50 * scale
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(kind, p, mid) < q else (low, mid)
    return (low + high) / 2


def ks_p_value(d: float, n: float) -> float:
    """Kolmogorov's asymptotic series with the usual correction for small samples."""
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * t * t) for j in range(1, 101))))


def ks_fit(kind: str, p: tuple, x: np.ndarray) -> tuple[float, float]:
    x = np.sort(np.asarray(x, float))
    f = np.array([cdf(kind, p, v) for v in x])
    n = len(x)
    d = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    return float(d), ks_p_value(d, n)


def ks_two(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    d = np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)).max()
    return float(d), ks_p_value(d, len(a) * len(b) / (len(a) + len(b)))


def gamma_fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a gamma distribution by maximum likelihood (Thom's start, Newton steps)."""
    x = np.asarray(x, float)
    a = math.log(x.mean()) - np.log(x).mean()
    shape = (1 + math.sqrt(1 + 4 * a / 3)) / (4 * a) if a > 0 else 1e6
    for _ in range(30):
        h = 1e-5 * shape
        digamma = (math.lgamma(shape + h) - math.lgamma(shape - h)) / (2 * h)
        trigamma = (math.lgamma(shape + h) - 2 * math.lgamma(shape) + math.lgamma(shape - h)) / (h * h)
        step = (math.log(shape) - digamma - a) / (1 / shape - trigamma)
        if not math.isfinite(step):
            break
        new = shape - step
        shape = new if new > 0 else shape / 2
        if abs(step) < 1e-8 * shape:
            break
    return shape, float(x.mean()) / shape
