"""Two-sided p-values of rank correlations, one row per size pair."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value / a


def spearman_p(rho: float, n: int) -> float:
    """Student t with n - 2 degrees of freedom."""
    if n <= 2 or math.isnan(rho):
        return math.nan
    if abs(rho) >= 1.0:
        return 0.0
    t2 = rho * rho * (n - 2) / ((1.0 - rho) * (1.0 + rho))
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def inversions_at_most(n: int, k: int) -> int:
    """Permutations of n items with at most k inversions."""
    counts = [1] + [0] * k
    for size in range(2, n + 1):
        running, row = 0, []
        for i in range(k + 1):
            running += counts[i]
            if i >= size:
                running -= counts[i - size]
            row.append(running)
        counts = row
    return sum(counts)


def kendall_p(concordant: int, discordant: int, n: int, x: tuple, y: tuple) -> float:
    """Exact without ties for few items, else the normal approximation.

    ``x`` and ``y`` hold the tie sums t(t-1)/2, t(t-1)(t-2), t(t-1)(2t+5).
    """
    if n < 2:
        return math.nan
    total = n * (n - 1) // 2
    fewer = min(discordant, total - discordant)
    if x[0] == 0 and y[0] == 0 and (n <= 33 or fewer <= 1):
        return min(1.0, 2 * inversions_at_most(n, fewer) / math.factorial(n))
    m = n * (n - 1.0)
    variance = (m * (2 * n + 5) - x[2] - y[2]) / 18 + 2 * x[0] * y[0] / m
    if n > 2:
        variance += x[1] * y[1] / (9 * m * (n - 2))
    if variance <= 0:
        return math.nan
    return math.erfc(abs(concordant - discordant) / math.sqrt(2 * variance))


@F.pandas_udf(DoubleType())
def spearman_p_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([spearman_p(r, int(k)) for r, k in zip(rho.fillna(math.nan), n)], dtype="float64")


@F.pandas_udf(DoubleType())
def kendall_p_udf(frame: pd.DataFrame) -> pd.Series:
    return pd.Series(
        [
            kendall_p(
                int(r.concordant), int(r.discordant), int(r.n), (r.x0, r.x1, r.x2), (r.y0, r.y1, r.y2)
            )
            for r in frame.itertuples()
        ],
        dtype="float64",
    )
