"""Exact ranks, running counts and quantiles over whole columns, without a one-task sort.

Rows are first reduced to distinct values with counts, so a value holding a third of all rows costs one
row. The distinct values are cut into value ranges; running counts are taken over the range totals (a
few hundred rows) and then inside each range in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

UNB = Window.unboundedPreceding
RANGES = 128


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row (an aggregate without keys has exactly one row)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def with_range(df: DataFrame, value: str, edges: str, n: int, name: str = "_r") -> DataFrame:
    """`df` with the number of its `n` ascending edges below the value, found by halving."""
    df, step = df.withColumn(name, F.lit(0)), 1 << max(n.bit_length() - 1, 0)
    while step:
        df = df.withColumn(name, F.col(name) + F.when(F.get(edges, F.col(name) + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return df


def running_counts(df: DataFrame, value: str, counts: Mapping[str, str | Column], keys: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """(keys, value) with, per count name: cnt_<n> at the value, before_<n> below it, total_<n> overall."""
    keys = list(keys)
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[F.sum(F.col(c) if isinstance(c, str) else c).cast("long").alias(f"cnt_{n}") for n, c in counts.items()]
    )
    # The counts are asked for as well, so that all uses share one shuffle of the distinct values. Edges only deal the values out.
    edges = g.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_edges"), *[F.max(f"cnt_{n}").alias(f"_x_{n}") for n in counts])
    g = attach_scalars(g, edges).drop(*[f"_x_{n}" for n in counts])
    g = with_range(g, value, "_edges", ranges - 1).drop("_edges")
    totals = g.groupBy(*keys, "_r").agg(*[F.sum(f"cnt_{n}").alias(f"_c_{n}") for n in counts])
    part = keys or [F.lit(0)]
    below, whole = Window.partitionBy(*part).orderBy("_r").rowsBetween(UNB, -1), Window.partitionBy(*part)
    base = totals.select(
        *keys, "_r",
        *[F.coalesce(F.sum(f"_c_{n}").over(below), F.lit(0)).alias(f"_b_{n}") for n in counts],
        *[F.sum(f"_c_{n}").over(whole).alias(f"total_{n}") for n in counts],
    )
    inside = Window.partitionBy(*keys, "_r").orderBy(value).rowsBetween(UNB, -1)
    j = g.join(base, [*keys, "_r"])
    return j.select(
        *keys, value,
        *[f"cnt_{n}" for n in counts],
        *[(F.col(f"_b_{n}") + F.coalesce(F.sum(f"cnt_{n}").over(inside), F.lit(0))).alias(f"before_{n}") for n in counts],
        *[f"total_{n}" for n in counts],
    )


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank", weight: str | None = None) -> DataFrame:
    """(keys, value) -> average rank of the value, ties sharing the mean of their positions."""
    rc = running_counts(df, value, {"n": F.col(weight) if weight else F.lit(1)}, keys)
    return rc.select(*keys, value, (F.col("before_n") + (F.col("cnt_n") + 1) / 2).alias(name), F.col("total_n").alias("n"))


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (), weight: str | Column | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key: one column per name in `probs`."""
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    rc = running_counts(df, value, {"n": w}, keys)
    pos = {n: p * (F.col("total_n") - 1) for n, p in probs.items()}
    aggs = []
    for n, p in pos.items():
        lo, hi = F.floor(p), F.ceil(p)
        here = lambda k: (F.col("before_n") <= k) & (k < F.col("before_n") + F.col("cnt_n"))
        aggs += [F.max(F.when(here(lo), F.col(value))).alias(f"_lo_{n}"), F.max(F.when(here(hi), F.col(value))).alias(f"_hi_{n}"), F.max(p - lo).alias(f"_f_{n}")]
    g = rc.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])
