"""Tail probabilities by convergent series, and exact rounding tests, as vectorised column functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function: its hypergeometric series, on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > a / (a + b):
        return 1.0 - beta_share(b, a, 1.0 - x)
    term = total = 1.0
    n = 0
    while abs(term) > 1e-16 * total and n < 100_000:
        term *= (a + b + n) / (a + 1 + n) * x
        total += term
        n += 1
    return total * math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b))


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series of positive terms."""
    if x <= 0:
        return 0.0
    term = total = 1.0
    n = 0
    while term > 1e-17 * total and n < 100_000:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a + 1)))


def tail(kind: str, value: float, df1: float | None, df2: float | None) -> float | None:
    """p of a statistic: t, r and z two-tailed, F and chi2 upper tail; None where it isn't defined."""
    if kind == "z":
        return math.erfc(abs(value) / math.sqrt(2))
    if df1 is None or df1 <= 0:
        return None
    if kind == "r":
        if abs(value) >= 1:
            return None
        kind, value = "t", value * math.sqrt(df1 / (1 - value * value))
    if kind == "t":
        return beta_share(df1 / 2, 0.5, df1 / (df1 + value * value))
    if value <= 0:
        return None
    if kind == "chi2":
        return 1 - gamma_share(df1 / 2, value / 2)
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * value)) if kind == "F" and df2 and df2 > 0 else None


@F.pandas_udf(DoubleType())
def p_value(kind: pd.Series, value: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    none = lambda x: None if pd.isna(x) else float(x)
    return pd.Series([tail(k, float(v), none(a), none(b)) if k and not pd.isna(v) else None for k, v, a, b in zip(kind, value, df1, df2)], dtype="float64")


def reachable_mean(mean: str, n: int) -> bool:
    """Whether n whole numbers can have this printed mean; compared as printed, with Python's exact rounding."""
    digits = len(mean.partition(".")[2])
    middle = round(float(mean) * n)
    return any(f"{k / n:.{digits}f}" == f"{float(mean):.{digits}f}" for k in (middle - 1, middle, middle + 1) if k >= 0)


@F.pandas_udf(BooleanType())
def grim(mean: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([reachable_mean(m, int(k)) if m and k and k > 0 else None for m, k in zip(mean, n)], dtype=object)
