"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewright.functions.numeric import round_floats
from tapewright.plans.ctes import with_ctes
from tapewright.sources.canonical import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, floats: str = "") -> Callable:
    """Register `fn(tables) -> DataFrame` under `name`.

    Doubles are rounded to six decimals on both sides, after the same 1e-9 nudge, so that sums added in
    another order do not straddle a decimal tie; `floats` lists the double columns of the SQL.
    """

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: round_floats(fn(Tables(spark, sf_dir)))
        if sql is not None:
            body = sql.strip()
            if floats:
                reps = ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 6) + 0.0 AS {c}" for c in floats.split())
                body = f"SELECT * REPLACE ({reps}) FROM ({body})"
            ORACLE[name] = with_ctes(body)
        return fn

    return wrap
