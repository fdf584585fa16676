"""Trading sessions and session-aware bar boundaries on epoch milliseconds.

`et_ms` columns hold the US/Eastern wall clock as milliseconds, so `et_ms mod 86 400 000` is the
time of day. Everything here is integer column arithmetic and stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tapewright.functions.numeric import col, floor_to

# Session edges (US/Eastern) and bar lengths.
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
PREMARKET_START_MS = 4 * HOUR_MS
REGULAR_START_MS = 9 * HOUR_MS + 1_800_000
AFTERHOURS_START_MS = 16 * HOUR_MS
AFTERHOURS_END_MS = 20 * HOUR_MS
MARKET_ZONE = "America/New_York"
TIMEFRAME_MS = {
    "10s": 10_000,
    "1m": 60_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": HOUR_MS,
    "4h": 4 * HOUR_MS,
    "1d": DAY_MS,
    "1w": 7 * DAY_MS,
}
# 1970-01-05 was a Monday.
FIRST_MONDAY_MS = 4 * DAY_MS


def utc_ms(ts_ntz: str) -> Column:
    """Epoch milliseconds of a zone-less UTC timestamp; sessions run in UTC (see `use_utc`)."""
    return F.expr(f"unix_millis(CAST({ts_ntz} AS TIMESTAMP))")


def use_utc(spark) -> None:
    """Pin the session zone, so zone-less timestamps are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def to_et_ms(ms: str | Column) -> Column:
    """UTC epoch milliseconds to US/Eastern wall-clock milliseconds, daylight saving included."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(col(ms)), MARKET_ZONE))


def et_to_utc_ms(et_ms: str | Column) -> Column:
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(col(et_ms)), MARKET_ZONE))


def ms_of_day(et_ms: str | Column) -> Column:
    return F.pmod(col(et_ms), F.lit(DAY_MS).cast("long"))


def et_date(et_ms: str | Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (floor_to(et_ms, DAY_MS) / DAY_MS).cast("int"))


def classify_session(et_ms: str | Column) -> Column:
    m = ms_of_day(et_ms)
    return (
        F.when((m >= PREMARKET_START_MS) & (m < REGULAR_START_MS), "premarket")
        .when((m >= REGULAR_START_MS) & (m < AFTERHOURS_START_MS), "regular")
        .when((m >= AFTERHOURS_START_MS) & (m < AFTERHOURS_END_MS), "afterhours")
        .otherwise("closed")
    )


def session_phase(et_ms: str | Column) -> Column:
    """Premarket phase: early before 07:00, mid before 09:00, late afterwards."""
    m = ms_of_day(et_ms)
    return F.when(m < 7 * HOUR_MS, "early").when(m < 9 * HOUR_MS, "mid").otherwise("late")


def is_closed(et_ms: str | Column) -> Column:
    m = ms_of_day(et_ms)
    return (m < PREMARKET_START_MS) | (m >= AFTERHOURS_END_MS)


def next_session_boundary(et_ms: str | Column) -> Column:
    m = ms_of_day(et_ms)
    day = col(et_ms) - m
    return day + (
        F.when(m < PREMARKET_START_MS, PREMARKET_START_MS)
        .when(m < REGULAR_START_MS, REGULAR_START_MS)
        .when(m < AFTERHOURS_START_MS, AFTERHOURS_START_MS)
        .when(m < AFTERHOURS_END_MS, AFTERHOURS_END_MS)
        .otherwise(DAY_MS + PREMARKET_START_MS)
    )


def session_start(et_ms: str | Column) -> Column:
    m = ms_of_day(et_ms)
    return (col(et_ms) - m) + (
        F.when(m >= AFTERHOURS_START_MS, AFTERHOURS_START_MS)
        .when(m >= REGULAR_START_MS, REGULAR_START_MS)
        .when(m >= PREMARKET_START_MS, PREMARKET_START_MS)
        .otherwise(0)
    )


def bar_start(et_ms: str | Column, timeframe: str) -> Column:
    """Intraday bars are anchored at their session's start; weeks begin on Monday."""
    if timeframe == "1w":
        return floor_to(et_ms, 7 * DAY_MS, origin=FIRST_MONDAY_MS)
    if timeframe == "1d":
        return floor_to(et_ms, DAY_MS)
    start = session_start(et_ms)
    return start + floor_to(col(et_ms) - start, TIMEFRAME_MS[timeframe])


def bar_end(start_et: str | Column, timeframe: str) -> Column:
    """Bars never cross a session edge; daily and weekly bars are not cut."""
    natural = col(start_et) + F.lit(TIMEFRAME_MS[timeframe]).cast("long")
    if timeframe in ("1d", "1w"):
        return natural
    return F.least(natural, next_session_boundary(start_et))
