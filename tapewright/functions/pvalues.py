"""Tail probabilities for the handful of statistics a report ends with (Arrow-batched)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with `df` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    return _beta_tail(df / 2, 0.5, df / (df + t * t))


def kolmogorov_two_sided(d: float, n: float, m: float) -> float:
    """Asymptotic two-sample tail probability."""
    if d is None or not n or not m:
        return float("nan")
    en = math.sqrt(n * m / (n + m))
    lam = d * en
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def student_p(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def f(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([student_two_sided(a, b) for a, b in zip(ts, dfs)])

    return f(t, df)


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    @F.pandas_udf("double")
    def f(ds: pd.Series, ns: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([kolmogorov_two_sided(a, b, c) for a, b, c in zip(ds, ns, ms)])

    return f(d.cast("double"), n.cast("double"), m.cast("double"))
