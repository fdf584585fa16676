"""Small numeric column helpers that behave the same with ANSI mode on or off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column, otherwise=None) -> Column:
    """num / den as double; `otherwise` (null by default) where den is zero or null."""
    n, d = col(num).cast("double"), col(den).cast("double")
    safe = F.when(d != 0, n / F.when(d != 0, d))
    return safe if otherwise is None else F.coalesce(safe, F.lit(float(otherwise)))


def floor_div(value: str | Column, step: int) -> Column:
    """Integer floor division; also right for negative values, where `div` truncates.

    The dividend is an exact multiple of `step`, and epoch milliseconds stay below 2**53, so the
    double quotient is exact.
    """
    v, s = col(value), F.lit(step).cast("long")
    return ((v - F.pmod(v, s)) / s).cast("long")


def floor_to(value: str | Column, step: int, origin: int = 0) -> Column:
    """Largest multiple of `step` (shifted by `origin`) not above `value`."""
    v = col(value)
    o = F.lit(origin).cast("long")
    return v - F.pmod(v - o, F.lit(step).cast("long"))


def round_scaled(value: Column, digits: int) -> Column:
    """Binary half-up rounding: scale, add a half, floor (as array libraries round, unlike decimal rounding)."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, nudged off decimal ties; adding 0.0 turns a negative zero into zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`") + F.lit(1e-9), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
