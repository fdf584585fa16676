"""First passages of an entry's price through levels, in two steps.

Trades are summed up once per (ticker, time bucket), whatever the number of entries. The span of an entry is made of such
summaries for the buckets inside it, and of ticks for the two buckets that it only touches. A level that is first crossed
in some bucket shows in the bucket's high, its low, its largest fall, or its last time, so the ticks of that one bucket are
opened and all others stay summaries. Nothing is ordered by entry but summaries, one row a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.numeric import floor_div
from tapewright.functions.timewin import UNB
from tapewright.operators.ticks import order_key

BUCKET = 900_000


def _ticks(trades: DataFrame, bucket_ms: int) -> DataFrame:
    return trades.select("ticker", floor_div("ts_ms", bucket_ms).alias("_b"), "ts_ms", "seq", F.col("price").alias("px"))


def _inside(include_start: bool) -> Column:
    start = F.col("ts_ms") >= F.col("entry_ms") if include_start else F.col("ts_ms") > F.col("entry_ms")
    return start & (F.col("ts_ms") <= F.col("session_end_ms"))


def _falls(falls: Sequence[float], keys: Sequence[str], rows: DataFrame) -> DataFrame:
    """Mark rows that stand `falls[i]` percent or more below an earlier one of their key."""
    if not falls:
        return rows
    w = Window.partitionBy(*keys).orderBy("ts_ms", "seq").rowsBetween(UNB, 0)
    rows = rows.withColumn("_top", F.max("px").over(w))
    return rows.withColumns({f"fall{i}": F.col("px") <= F.col("_top") * (1 - x / 100) for i, x in enumerate(falls)}).drop("_top")


def _summaries(rows: DataFrame, keys: Sequence[str], falls: Sequence[float]) -> DataFrame:
    """n, hi, lo, last_ms, last_px and fall<i> per key."""
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("ts_ms").alias("last_ms"), F.max_by("px", order_key()).alias("last_px"),
        *[F.max(f"fall{i}").alias(f"fall{i}") for i in range(len(falls))],
    )


def span_cells(entries: DataFrame, trades: DataFrame, falls: Sequence[float] = (), include_start: bool = False, bucket_ms: int = BUCKET) -> DataFrame:
    """`entries` by (entry, `_b`) with n, hi, lo, last_ms, last_px, fall<i>: the trades of (entry_ms, session_end_ms] by time bucket.

    Only buckets that have any. An entry's first and last bucket are matched with ticks, those between with summaries, in one join.
    """
    cols = entries.columns
    ticks = _ticks(trades, bucket_ms).withColumns({"n": F.lit(1).cast("long"), "hi": F.col("px"), "lo": F.col("px"), "_whole": F.lit(False)})
    cells = _summaries(_falls(falls, ["ticker", "_b"], ticks), ["ticker", "_b"], falls)
    cells = cells.withColumnsRenamed({"last_ms": "ts_ms", "last_px": "px"}).withColumns({"seq": F.lit(0).cast("long"), "_whole": F.lit(True)})
    source = ticks.unionByName(cells, allowMissingColumns=True).withColumnsRenamed({"ticker": "_ticker", "_b": "_tb", "_whole": "_tw"})
    first, last = floor_div("entry_ms", bucket_ms), floor_div("session_end_ms", bucket_ms)
    e = entries.filter(F.col("session_end_ms") >= F.col("entry_ms")).select("*", F.explode(F.sequence(first, last)).alias("_b"))
    e = e.withColumn("_whole", (F.col("_b") > first) & (F.col("_b") < last))
    rows = e.join(source, (F.col("ticker") == F.col("_ticker")) & (F.col("_b") == F.col("_tb")) & (F.col("_whole") == F.col("_tw")) & (F.col("_whole") | _inside(include_start)))
    if falls:
        marked = _falls(falls, ["entry_id", "_b"], rows.withColumnsRenamed({f"fall{i}": f"_cell{i}" for i in range(len(falls))}))
        rows = marked.withColumns({f"fall{i}": F.coalesce(f"_cell{i}", F.col(f"fall{i}") & ~F.col("_whole")) for i in range(len(falls))})
    return _summaries(rows, [*cols, "_b"], falls)


def span_stats(entries: DataFrame, trades: DataFrame, include_start: bool = False, bucket_ms: int = BUCKET) -> DataFrame:
    """(entry_id, n, hi, lo, last_ms, last_px) over (entry_ms, session_end_ms]; entries without trades have no row."""
    c = span_cells(entries.select("entry_id", "ticker", "entry_ms", "session_end_ms"), trades, (), include_start, bucket_ms)
    return c.groupBy("entry_id").agg(
        F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("last_ms").alias("last_ms"), F.max_by("last_px", "_b").alias("last_px")
    )


def first_hits(
    entries: DataFrame, trades: DataFrame, keep: Sequence[str], crossed: Sequence[Column], reasons: Sequence[Column], falls: Sequence[float] = (),
    include_start: bool = False, bucket_ms: int = BUCKET,
) -> DataFrame:
    """One row per entry with trades: `keep`, `_x<i>` and `_end`.

    `crossed[i]` tells from a bucket's hi, lo, last_ms, fall<j> and `peak_in` (highest price before it, null at first) whether exit i is in
    the bucket; it must be true exactly where `reasons[i]`, a column over ts_ms, px, peak and trough, is not null on some row. `_x<i>` is that
    first row (ts_ms, seq, px, peak, trough, reason), or null; `_end` the last row of the span (ts_ms, px, peak, trough).
    """
    # Some columns of `keep`, such as the ticker, are needed anyway.
    e = entries.select(*dict.fromkeys([*keep, "entry_id", "ticker", "entry_ms", "session_end_ms"]))
    before, whole = Window.partitionBy("entry_id").orderBy("_b").rowsBetween(UNB, -1), Window.partitionBy("entry_id")
    c = span_cells(e, trades, falls, include_start, bucket_ms)
    c = c.withColumns({"peak_in": F.max("hi").over(before), "trough_in": F.min("lo").over(before)})
    c = c.withColumns({f"_f{i}": F.min(F.when(cross, F.col("_b"))).over(whole) for i, cross in enumerate(crossed)})
    here = [F.coalesce(F.col(f"_f{i}") == F.col("_b"), F.lit(False)) for i in range(len(crossed))]
    opened = F.lit(False)
    for h in here:
        opened = opened | h
    c = c.withColumn("_open", opened)
    t = _ticks(trades, bucket_ms).withColumnsRenamed({"ticker": "_ticker", "_b": "_tb"})
    rows = c.join(t, (F.col("ticker") == F.col("_ticker")) & (F.col("_b") == F.col("_tb")) & F.col("_open") & _inside(include_start), "left")
    w = Window.partitionBy("entry_id", "_b").orderBy("ts_ms", "seq").rowsBetween(UNB, 0)
    rows = rows.withColumns({"peak": F.greatest("peak_in", F.max("px").over(w)), "trough": F.least("trough_in", F.min("px").over(w))})
    row = F.struct("ts_ms", "seq", "px", "peak", "trough")
    hits = [
        F.min(F.when(h & F.col("px").isNotNull() & r.isNotNull(), F.struct(row.alias("row"), r.alias("reason")))).alias(f"_h{i}") for i, (h, r) in enumerate(zip(here, reasons, strict=True))
    ]
    one = rows.groupBy(*keep).agg(
        *hits, F.max("last_ms").alias("_ms"), F.max_by("last_px", "_b").alias("_px"), F.max("hi").alias("_hi"), F.min("lo").alias("_lo")
    )
    end = F.struct(F.col("_ms").alias("ts_ms"), F.col("_px").alias("px"), F.col("_hi").alias("peak"), F.col("_lo").alias("trough"))
    flat = lambda i: F.when(F.col(f"_h{i}").isNotNull(), F.struct(f"_h{i}.row.*", f"_h{i}.reason"))
    return one.select(*keep, *[flat(i).alias(f"_x{i}") for i in range(len(crossed))], end.alias("_end"))
