"""Snapshot validation, coverage and readiness reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapewright.functions.calendar import with_calendar
from tapewright.functions.numeric import ratio

# Validation bounds.
MAX_GAP_MS = 30_000
MIN_TICKERS, MAX_TICKERS = 100, 15_000
MIN_SNAPSHOTS, MIN_MINUTES = 100, 300


def snapshot_sizes(snap: DataFrame) -> DataFrame:
    """Rows per snapshot: one row per (date, window)."""
    return snap.groupBy("date", "window_ms").agg(F.count(F.lit(1)).alias("rows"))


def interval_report(sizes: DataFrame, max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """Spacing of a date's snapshots and the gaps above the bound."""
    w = Window.partitionBy("date").orderBy("window_ms")
    d = sizes.withColumn("_g", F.lead("window_ms").over(w) - F.col("window_ms"))
    return d.groupBy("date").agg(
        F.min("_g").alias("min_interval_ms"), F.max("_g").alias("max_interval_ms"), F.avg("_g").alias("avg_interval_ms"), F.count(F.when(F.col("_g") > max_gap_ms, 1)).alias("gap_count")
    )


def size_report(sizes: DataFrame, low: int = MIN_TICKERS, high: int = MAX_TICKERS, min_snapshots: int = MIN_SNAPSHOTS, min_minutes: float = MIN_MINUTES) -> DataFrame:
    r = F.col("rows")
    g = sizes.groupBy("date").agg(
        F.count(F.lit(1)).alias("snapshots"), F.min(r).alias("min_rows"), F.max(r).alias("max_rows"), F.avg(r).alias("avg_rows"),
        F.count(F.when(r < low, 1)).alias("low_row_count"), F.count(F.when(r > high, 1)).alias("high_row_count"), ((F.max("window_ms") - F.min("window_ms")) / 60000.0).alias("minutes"),
    )
    return g.withColumn("too_few", F.col("snapshots") < min_snapshots).withColumn("too_short", F.col("minutes") < min_minutes)


def date_verdicts(snap: DataFrame, max_gap_ms: int = MAX_GAP_MS, **bounds) -> DataFrame:
    """All checks per date and the verdict: valid when no issue was found."""
    sizes = snapshot_sizes(snap)
    nulls = snap.groupBy("date").agg(F.count(F.when(F.col("price").isNull() | F.col("ticker").isNull(), 1)).alias("null_count"))
    j = size_report(sizes, **bounds).join(interval_report(sizes, max_gap_ms), "date").join(nulls, "date")
    issues = F.array(
        F.when(F.col("gap_count") > 0, "gaps"), F.when(F.col("low_row_count") > 0, "low_rows"), F.when(F.col("high_row_count") > 0, "high_rows"),
        F.when(F.col("too_few"), "too_few_snapshots"), F.when(F.col("too_short"), "short_coverage"), F.when(F.col("null_count") > 0, "nulls"),
    )
    return j.withColumn("issues", F.concat_ws(",", F.filter(issues, lambda x: x.isNotNull()))).withColumn("is_valid", F.col("issues") == "")


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_dates"), F.count(F.when(F.col("is_valid"), 1)).alias("n_valid"), F.sum("snapshots").alias("snapshots"), F.sum("gap_count").alias("gaps"), F.avg("avg_rows").alias("mean_rows")
    )


def ticker_coverage(snap: DataFrame, share: float = 0.5) -> DataFrame:
    """Windows per ticker against the date's windows; incomplete below `share`."""
    expected = snap.select("date", "window_ms").distinct().groupBy("date").agg(F.count(F.lit(1)).alias("expected"))
    g = snap.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("windows"), F.min("window_ms").alias("first_ms"), F.max("window_ms").alias("last_ms"))
    j = g.join(expected, "date").withColumn("coverage", F.col("windows") / F.col("expected"))
    return j.withColumn("incomplete", F.col("coverage") < share)


def readiness(days: DataFrame, **tables: DataFrame) -> DataFrame:
    """Row counts per table and day, left-joined to the calendar; ready when every trading day's table has rows."""
    out = with_calendar(days.select("date"), "date").select("date", "trading_day", "early_close")
    ready = F.lit(True)
    for name, df in tables.items():
        c = df.groupBy("date").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(c, "date", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
        ready = ready & (F.col(f"n_{name}") > 0)
    return out.withColumn("ready", ready | ~F.col("trading_day"))


def symbol_coverage(snap: DataFrame, ticks: DataFrame) -> DataFrame:
    """Tickers of a date found on one side only, and counts of both."""
    a = snap.select("date", "ticker").distinct().withColumn("_a", F.lit(1))
    b = ticks.select("date", "ticker").distinct().withColumn("_b", F.lit(1))
    j = a.join(b, ["date", "ticker"], "full")
    return j.groupBy("date").agg(
        F.count("_a").alias("n_snapshot"), F.count("_b").alias("n_ticks"), F.count(F.when(F.col("_b").isNull(), 1)).alias("missing_ticks"), F.count(F.when(F.col("_a").isNull(), 1)).alias("extra_ticks")
    ).withColumn("coverage", ratio(F.col("n_snapshot") - F.col("missing_ticks"), "n_snapshot", otherwise=0.0))
