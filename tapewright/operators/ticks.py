"""Tick-level predicates and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.numeric import ratio

# The off-exchange reporting code and the accepted reporting delay.
OFF_EXCHANGE = 4
MAX_DELAY_NS = 1_000_000_000


def on_time(delay_from: str = "part_ns", report: str = "sip_ns") -> Column:
    """False for off-exchange reports more than one second late; `delay_from` names the reference clock."""
    return (F.col("exchange") != OFF_EXCHANGE) | (F.col(report) - F.col(delay_from) <= MAX_DELAY_NS)


def drop_delayed(trades: DataFrame, delay_from: str = "part_ns") -> DataFrame:
    return trades.filter(on_time(delay_from))


def valid_quote(strict: bool = False) -> Column:
    """Both sides positive; `strict` also asks for an uncrossed market."""
    ok = (F.col("bid") > 0) & (F.col("ask") > 0)
    return ok & (F.col("ask") > F.col("bid")) if strict else ok


def quote_derived(quotes: DataFrame) -> DataFrame:
    return quotes.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": (F.col("bid") + F.col("ask")) / 2})


def weighted_mid(bid: str = "bid", ask: str = "ask", bid_size: str = "bid_size", ask_size: str = "ask_size") -> Column:
    """Mid price weighted by the opposite side's size; zero sizes give null."""
    return ratio(F.col(bid) * F.col(ask_size) + F.col(ask) * F.col(bid_size), F.col(bid_size) + F.col(ask_size))


def spread_bps() -> Column:
    mid = (F.col("bid") + F.col("ask")) / 2
    return F.when(mid > 0, (F.col("ask") - F.col("bid")) / mid * 10000).otherwise(0.0)


def order_key(ts: str = "ts_ms", seq: str = "seq") -> Column:
    """(ts, seq) as one decimal, so first/last aggregates keep fixed-width buffers and hash-aggregate.

    A struct key would force a sort of all ticks before the partial aggregation.
    """
    return F.col(ts).cast("decimal(18,0)") * F.expr("10000000000000000000BD") + F.col(seq).cast("decimal(19,0)")
