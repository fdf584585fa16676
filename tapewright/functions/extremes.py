"""Highest, lowest and last value in the window behind many points, at a cost linear in rows and points.

All windows have one length L, a whole number K of cells. A window is the rest of its first cell, the K - 1 whole cells after
it, and the beginning of its last cell. The two ends are running extremes inside a cell. The K - 1 whole cells are, in the same way,
the rest of one block of K - 1 cells and the beginning of the next: running extremes over one summary row a cell. So no point ever
meets the rows of its window, and no key is in one task: a task orders a cell's rows, or a block's cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.numeric import floor_div
from tapewright.functions.timewin import UNB

HOUR = 3_600_000
_MERGE = {"hi": F.max, "lo": F.min, "last": F.max}


def _cells_in(length_ms: int, most_ms: int = HOUR) -> int:
    """The smallest number of equal cells of at most `most_ms`, in whole milliseconds; one cell where there is none near it."""
    least = -(-length_ms // most_ms)
    return next((k for k in range(least, 8 * least + 1) if length_ms % k == 0), 1)


def _running(items: DataFrame, probes: DataFrame, forward: bool, inclusive: bool) -> DataFrame:
    """(_key, hi, lo, last) of the items of a probe's block up to its position (from it on, if not `forward`)."""
    side = lambda item: F.lit(0 if item == inclusive else 1)
    rows = items.withColumn("_side", side(True)).unionByName(probes.withColumn("_side", side(False)), allowMissingColumns=True)
    pos = F.col("_pos").asc() if forward else F.col("_pos").desc()
    w = Window.partitionBy("ticker", "_block").orderBy(pos, "_side").rowsBetween(UNB, 0)
    return rows.select("_key", *[f(n).over(w).alias(n) for n, f in _MERGE.items()]).filter(F.col("_key").isNotNull() & F.col("hi").isNotNull())


def window_extremes(
    points: DataFrame, rows: DataFrame, key: str, ts: str, length_ms: int, value: str = "price", seq: str = "seq", include_start: bool = False, most_ms: int = HOUR
) -> DataFrame:
    """(key, hi, hi_ms, lo, lo_ms, last, last_ms) over the rows of the point's ticker in (ts, ts + length], or [ts, ...

    `rows` has (ticker, ts_ms, `seq`, `value`), `points` (`key`, ticker, `ts`) with distinct keys. Of equal extremes the earliest counts,
    of equal times the larger `seq` is the last. Points without rows in their window are left out.
    """
    k = _cells_in(length_ms, most_ms)
    cell_ms = length_ms // k
    v = F.col(value)
    items = rows.filter(v.isNotNull()).select(
        "ticker", floor_div("ts_ms", cell_ms).alias("_block"), F.col("ts_ms").alias("_pos"),
        F.struct(v.alias("v"), (-F.col("ts_ms")).alias("t")).alias("hi"), F.struct(v.alias("v"), F.col("ts_ms").alias("t")).alias("lo"),
        F.struct(F.col("ts_ms").alias("t"), F.col(seq).alias("s"), v.alias("v")).alias("last"),
    )
    p = points.select(F.struct(F.col(key).alias("key")).alias("_key"), "ticker", F.col(ts).alias("_pos"), floor_div(ts, cell_ms).alias("_block"))
    parts = [
        _running(items, p, False, include_start),
        _running(items, p.withColumns({"_pos": F.col("_pos") + length_ms, "_block": F.col("_block") + k}), True, True),
    ]
    if k > 1:
        cells = items.groupBy("ticker", "_block").agg(*[f(n).alias(n) for n, f in _MERGE.items()])
        cells = cells.withColumn("_pos", F.col("_block")).withColumn("_block", floor_div("_pos", k - 1))
        at = lambda c: p.select("_key", "ticker", c.alias("_pos"), floor_div(c, k - 1).alias("_block"))
        parts += [_running(cells, at(F.col("_block") + 1), False, True), _running(cells, at(F.col("_block") + k - 1), True, True)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    g = out.groupBy("_key").agg(*[f(n).alias(n) for n, f in _MERGE.items()])
    fields: dict[str, Column] = {"hi": F.col("hi.v"), "hi_ms": -F.col("hi.t"), "lo": F.col("lo.v"), "lo_ms": F.col("lo.t"), "last": F.col("last.v"), "last_ms": F.col("last.t")}
    return g.select(F.col("_key.key").alias(key), *[c.alias(n) for n, c in fields.items()])
