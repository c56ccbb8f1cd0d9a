"""Rank and circular statistics in plain Python and numpy, for vectors of one group each."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def average_ranks(x: Sequence[float]) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return ((ends - counts + 1 + ends) / 2)[inverse]


def wilcoxon(x: Sequence[float], y: Sequence[float] | None = None) -> tuple[float, float]:
    """(statistic, two-sided p) of the signed-rank test; zeros are dropped. Exact without ties up to 50 pairs, else normal."""
    d = np.asarray(x, dtype=np.float64) - (0 if y is None else np.asarray(y, dtype=np.float64))
    had_zero = bool((d == 0).any())
    d = d[d != 0]
    n = len(d)
    if n == 0:
        return float("nan"), float("nan")
    ranks = average_ranks(np.abs(d))
    plus, minus = ranks[d > 0].sum(), ranks[d < 0].sum()
    w = min(plus, minus)
    _, ties = np.unique(np.abs(d), return_counts=True)
    if n <= 50 and (ties == 1).all() and not had_zero:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return float(w), min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    variance = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return float(w), math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * variance))


def mann_whitney(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    """(U of x, two-sided p): exact for small samples without ties, else normal with continuity and tie correction."""
    a, b = len(x), len(y)
    if not a or not b:
        return float("nan"), float("nan")
    both = np.concatenate([np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)])
    u = average_ranks(both)[:a].sum() - a * (a + 1) / 2
    _, ties = np.unique(both, return_counts=True)
    top = max(u, a * b - u)
    if min(a, b) <= 8 and (ties == 1).all():
        ways = np.zeros((a + 1, a * b + 1))  # [size of a subset of the ranks, its U]
        ways[0, 0] = 1
        for rank in range(1, a + b + 1):
            for k in range(min(a, rank), 0, -1):
                shift = rank - k
                if shift <= a * b:
                    ways[k, shift:] += ways[k - 1, : a * b + 1 - shift]
        return float(u), min(1.0, 2 * float(ways[a, int(round(top)) :].sum()) / math.comb(a + b, a))
    n = a + b
    spread = math.sqrt(a * b / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
    return float(u), 1.0 if spread == 0 else min(1.0, math.erfc((top - a * b / 2 - 0.5) / spread / math.sqrt(2)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def spearman(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    """(rho, two-sided p by the t distribution)."""
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    a, b = average_ranks(x), average_ranks(y)
    a, b = a - a.mean(), b - b.mean()
    scale = math.sqrt((a @ a) * (b @ b))
    if scale == 0:
        return float("nan"), float("nan")
    rho = float(a @ b) / scale
    return rho, spearman_p(rho, n)


def spearman_p(rho: float, n: int) -> float:
    free = n - 2
    return 0.0 if abs(rho) >= 1 else beta_inc(free / 2, 0.5, free / (free + rho * rho * free / (1 - rho * rho)))


def rayleigh_p(n: int, resultant: float) -> float:
    z = n * resultant**2
    return float(np.clip(math.exp(-z) * (1 + (2 * z - z * z) / (4 * n)), 0.0, 1.0))


def bootstrap_ci(x: Sequence[float], rng: np.random.Generator | None = None, draws: int = 2000) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of means of resamples; NaN below two values. Order matters: sort by key first."""
    x = np.asarray(x, dtype=np.float64)
    if len(x) < 2:
        return float("nan"), float("nan")
    rng = np.random.default_rng(0) if rng is None else rng
    means = x[rng.integers(0, len(x), (draws, len(x)))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)
