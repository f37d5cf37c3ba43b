"""Tail probabilities as Arrow functions, applied to one row per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if not df > 0 or math.isnan(t):
        return math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def signed_rank_exact(n: int, w: float) -> float:
    """Two-sided p of the signed-rank statistic min(W+, W-) for n differences without ties."""
    total = n * (n + 1) // 2
    ways = np.zeros(total + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k] if k <= total else ways[k:]
    below = ways[: int(math.floor(w)) + 1].sum() / 2.0**n
    return float(min(1.0, 2 * below))


def _nullable(values: list[float]) -> pd.Series:
    return pd.Series([None if v is None or math.isnan(v) else v for v in values], dtype="object").astype("Float64")


@F.pandas_udf(DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; NULL where undefined."""
    return _nullable([math.nan if pd.isna(a) or pd.isna(b) else t_two_sided(float(a), float(b)) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal; NULL where undefined."""
    return _nullable([math.nan if pd.isna(x) else math.erfc(abs(float(x)) / math.sqrt(2)) for x in z])


@F.pandas_udf(DoubleType())
def wilcoxon_exact_p(n: pd.Series, w: pd.Series) -> pd.Series:
    """Exact two-sided signed-rank p for at most 50 differences; NULL beyond."""
    return _nullable(
        [math.nan if pd.isna(a) or pd.isna(b) or not 0 < a <= 50 else signed_rank_exact(int(a), float(b)) for a, b in zip(n, w, strict=True)]
    )
