"""OHLCV bars: from trades, from finer bars, merged from halves, and with gaps filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions import session as S
from tapewright.functions.numeric import floor_to, ratio
from tapewright.operators.ticks import order_key


def trades_to_bars(trades: DataFrame, timeframe: str = "1m", keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Session-aware OHLCV bars; closed-session trades are dropped.

    One hash aggregation with map-side combining: a hot ticker reaches the shuffle as one row per bar
    and map task.
    """
    parts = trade_partials(trades, timeframe, keys)
    return finish_bars(parts, timeframe)


def trade_partials(trades: DataFrame, timeframe: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Mergeable bars: VWAP is kept as numerator and denominator, open/close carry their order key."""
    t = trades.withColumn("_et", S.to_et_ms("ts_ms")).filter(~S.is_closed("_et"))
    t = t.withColumn("bar_start", S.bar_start("_et", timeframe)).withColumn("_k", order_key())
    return t.groupBy(*keys, "bar_start").agg(
        F.min("_k").alias("first_key"),
        F.max("_k").alias("last_key"),
        F.min_by("price", "_k").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_k").alias("close"),
        F.sum("size").alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.col("price") * F.col("size")).alias("pv"),
    )


def merge_partials(parts: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Combine several partial bars of the same slot: earliest open, latest close, summed flows."""
    return parts.groupBy(*keys, "bar_start").agg(
        F.min("first_key").alias("_fk"),
        F.max("last_key").alias("_lk"),
        F.min_by("open", "first_key").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_key").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"),
        F.sum("pv").alias("pv"),
    ).withColumnsRenamed({"_fk": "first_key", "_lk": "last_key"})


def finish_bars(parts: DataFrame, timeframe: str) -> DataFrame:
    return (
        parts.withColumn("bar_end", S.bar_end("bar_start", timeframe))
        .withColumn("session", S.classify_session("bar_start"))
        .withColumn("vwap", F.coalesce(ratio("pv", "volume"), F.col("close")))
        .drop("pv", "first_key", "last_key")
    )


def resample_bars(bars: DataFrame, timeframe: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Minute bars (US/Eastern `bar_start`) to longer session-anchored bars."""
    return (
        bars.withColumn("_slot", S.bar_start("bar_start", timeframe))
        .groupBy(*keys, "_slot")
        .agg(
            F.min_by("open", "bar_start").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_start").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("trade_count").alias("trade_count"),
        )
        .withColumnRenamed("_slot", "bar_start")
    )


def resample_calendar(bars: DataFrame, unit: str) -> DataFrame:
    """Daily bars to calendar weeks ('week', from Monday) or months ('month')."""
    day = S.et_date("bar_start")
    return (
        bars.withColumn("period", F.trunc(day, unit))
        .groupBy("ticker", "period")
        .agg(
            F.min_by("open", "bar_start").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_start").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("trade_count").alias("trade_count"),
        )
    )


def _session_slots(step_ms: int) -> Column:
    """Offsets of every bar start within a trading day, as an array of milliseconds."""
    long = lambda v: F.lit(v).cast("long")
    spans = (
        (S.PREMARKET_START_MS, S.REGULAR_START_MS),
        (S.REGULAR_START_MS, S.AFTERHOURS_START_MS),
        (S.AFTERHOURS_START_MS, S.AFTERHOURS_END_MS),
    )
    return F.concat(*[F.sequence(long(a), long(b - 1), long(step_ms)) for a, b in spans])


def fill_session_gaps(bars: DataFrame, timeframe: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Add flat zero-volume bars between consecutive bars of a ticker, skipping closed hours.

    Bars have at most one row per ticker and slot, so the per-ticker window is bounded by the calendar.
    """
    step = S.TIMEFRAME_MS[timeframe]
    w = Window.partitionBy(*keys).orderBy("bar_start")
    gaps = (
        bars.select(*keys, "bar_end", "close", F.lead("bar_start").over(w).alias("_next"))
        .filter(F.col("_next") > F.col("bar_end"))
        .withColumn("_day", F.explode(F.sequence(floor_to("bar_end", S.DAY_MS), floor_to("_next", S.DAY_MS), F.lit(S.DAY_MS).cast("long"))))
        .withColumn("_off", F.explode(_session_slots(step)))
        .withColumn("bar_start", F.col("_day") + F.col("_off"))
        .filter((F.col("bar_start") >= F.col("bar_end")) & (F.col("bar_start") < F.col("_next")))
    )
    flat = gaps.select(
        *keys,
        "bar_start",
        F.col("close").alias("open"),
        F.col("close").alias("high"),
        F.col("close").alias("low"),
        F.col("close").alias("close"),
        F.lit(0).cast("long").alias("volume"),
        F.lit(0).cast("long").alias("trade_count"),
        S.bar_end("bar_start", timeframe).alias("bar_end"),
        S.classify_session("bar_start").alias("session"),
        F.col("close").alias("vwap"),
    )
    return bars.select(*flat.columns).withColumn("filled", F.lit(False)).unionByName(flat.withColumn("filled", F.lit(True)))


def fixed_bars(trades: DataFrame, interval_ms: int, fill: bool = True) -> DataFrame:
    """Plain fixed-interval bars without sessions; empty intervals repeat the previous bar with no volume."""
    k = order_key()
    bars = (
        trades.withColumn("time_ms", floor_to("ts_ms", interval_ms))
        .withColumn("_k", k)
        .groupBy("ticker", "time_ms")
        .agg(
            F.min_by("price", "_k").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_k").alias("close"),
            F.sum("size").alias("volume"),
        )
    )
    if not fill:
        return bars
    step = F.lit(interval_ms).cast("long")
    nxt = F.lead("time_ms").over(Window.partitionBy("ticker").orderBy("time_ms"))
    # Each bar is repeated up to the slot before the next bar; the last bar stands alone.
    return (
        bars.withColumn("_last", F.coalesce(nxt - step, F.col("time_ms")))
        .withColumn("_slot", F.explode(F.sequence("time_ms", "_last", step)))
        .select(
            "ticker",
            F.col("_slot").alias("time_ms"),
            "open", "high", "low", "close",
            F.when(F.col("_slot") == F.col("time_ms"), F.col("volume")).otherwise(F.lit(0)).alias("volume"),
        )
    )


def fill_chart_gaps(bars: DataFrame, step_ms: int, max_bars: int | None = None) -> DataFrame:
    """Flat bars between a bar and the next; with `max_bars` at most so many after each (a chart's display limit)."""
    step = F.lit(step_ms).cast("long")
    nxt = F.lead("bar_start").over(Window.partitionBy("ticker").orderBy("bar_start"))
    n = F.floor((F.col("_next") - F.col("bar_start")) / step_ms).cast("int") - 1
    n = n if max_bars is None else F.least(n, F.lit(max_bars))
    base = bars.select("ticker", "bar_start", "open", "high", "low", "close", "volume")
    gaps = (
        base.withColumn("_next", nxt)
        .filter(F.col("_next") - F.col("bar_start") > step_ms)
        .withColumn("_n", n)
        .filter(F.col("_n") >= 1)
        .withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    )
    flat = gaps.select(
        "ticker",
        (F.col("bar_start") + F.col("_j") * step).alias("bar_start"),
        *[F.col("close").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(0).cast("long").alias("volume"),
    )
    return base.unionByName(flat)


def minute_grid(
    bars: DataFrame, trading_days: DataFrame, step_ms: int = 60_000, full_hours: bool = False, daily: bool = False
) -> DataFrame:
    """Every expected slot per ticker between its first and last bar day.

    `trading_days` has day_ms and close_ms (13:00 on half days). The range join is an explode of each
    ticker's own day range followed by an equi join on the day.
    """
    day = floor_to("bar_start", S.DAY_MS)
    spans = bars.groupBy("ticker").agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = spans.withColumn("day_ms", F.explode(F.sequence("_a", "_b", F.lit(S.DAY_MS).cast("long")))).select("ticker", "day_ms")
    days = days.join(trading_days.select("day_ms", "close_ms"), "day_ms")
    if daily:
        return days.select("ticker", F.col("day_ms").alias("bar_start"))
    long = lambda v: F.lit(v).cast("long")
    half = F.col("close_ms") == 13 * S.HOUR_MS
    seq = lambda a, b: F.sequence(long(a), b - 1 if isinstance(b, Column) else long(b - 1), long(step_ms))
    if full_hours:
        slots = F.when(
            half, F.concat(seq(4 * S.HOUR_MS, 13 * S.HOUR_MS), seq(16 * S.HOUR_MS, 17 * S.HOUR_MS))
        ).otherwise(seq(4 * S.HOUR_MS, 20 * S.HOUR_MS))
    else:
        slots = seq(S.REGULAR_START_MS, F.col("close_ms"))
    return days.withColumn("_slot", F.explode(slots)).select("ticker", (F.col("day_ms") + F.col("_slot")).alias("bar_start"))


def fill_onto_grid(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """Left join bars onto the grid; prices carry the last close of the same ticker, volumes become 0."""
    j = grid.join(bars.select("ticker", "bar_start", "open", "high", "low", "close", "volume", "trade_count"), ["ticker", "bar_start"], "left")
    w = Window.partitionBy("ticker").orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_c", F.last("close", ignorenulls=True).over(w))
    return j.select(
        "ticker",
        "bar_start",
        *[F.coalesce(F.col(c), F.col("_c")).alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce("volume", F.lit(0)).alias("volume"),
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
    )


def append_pending(history: DataFrame, pending: DataFrame, partial: DataFrame) -> DataFrame:
    """Stored bars plus unflushed ones (newest wins at equal start) plus a newer meaningful partial bar.

    Pending bars only replace or follow the newest stored bar; the partial one must be newer than all
    and hold at least two trades or a price range.
    """
    cols = ["ticker", "bar_start", "open", "high", "low", "close", "volume"]
    last = history.groupBy("ticker").agg(F.max("bar_start").alias("_last"))
    p = pending.join(last, "ticker", "left").filter(F.col("_last").isNull() | (F.col("bar_start") >= F.col("_last")))
    both = history.select(*cols, F.lit(0).alias("_src")).unionByName(p.select(*cols, F.lit(1).alias("_src")))
    merged = (
        both.groupBy("ticker", "bar_start")
        .agg(*[F.max_by(c, "_src").alias(c) for c in cols[2:]])
        .select(*cols)
    )
    newest = merged.groupBy("ticker").agg(F.max("bar_start").alias("_last"))
    tail = (
        partial.filter((F.col("trade_count") >= 2) | (F.col("high") != F.col("low")))
        .join(newest, "ticker", "left")
        .filter(F.col("_last").isNull() | (F.col("bar_start") > F.col("_last")))
    )
    return merged.unionByName(tail.select(*cols))


def bar_invariants(bars: DataFrame) -> DataFrame:
    """Data-quality flags of a bar."""
    return bars.withColumns(
        {
            "high_ok": F.col("high") >= F.greatest("open", "close", "low"),
            "low_ok": F.col("low") <= F.least("open", "close", "high"),
            "volume_ok": (F.col("volume") >= 0) & (F.col("trade_count") >= 0),
        }
    )


def bar_shape(bars: DataFrame, doji_share: float = 0.1) -> DataFrame:
    """Range, body and direction; a doji has a body below `doji_share` of its range, or no range."""
    span, body = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    return bars.withColumns(
        {
            "range": span,
            "body": body,
            "bullish": F.col("close") > F.col("open"),
            "bearish": F.col("close") < F.col("open"),
            "doji": (span == 0) | (body < span * doji_share),
        }
    )
