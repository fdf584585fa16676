"""Factors over bars. All take bars with (ticker, bar_start, open, high, low, close, volume).

Bars hold at most one row per ticker and slot, so windows partitioned by ticker are bounded by the
calendar, not by the number of trades. Every factor is a Column; `add_bar_factors` evaluates all of
them over one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tapewright.functions.numeric import clamp, floor_div, ratio
from tapewright.functions.timewin import UNB, window_sum_carry

DAY = 86_400_000
#: Calendar blocks whose maps compose to one map of the moving average.
SPAN_BLOCKS = 32


def bar_window(keys: tuple[str, ...] = ("ticker",), order: str = "bar_start") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def relative_volume(w: WindowSpec, lookback: int = 20) -> Column:
    """Volume over the mean of the last `lookback` bars including this one; null while warming up."""
    mean = F.avg("volume").over(w.rowsBetween(-(lookback - 1), 0))
    return F.when(F.row_number().over(w) >= lookback, ratio("volume", mean))


def price_direction() -> Column:
    """Where the close lies in the bar's range, 0 to 1; null on a flat bar."""
    return F.when(F.col("high") > F.col("low"), clamp((F.col("close") - F.col("low")) / (F.col("high") - F.col("low")), 0.0, 1.0))


def gap_percent(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    return F.when(prev > 0, (F.col("open") - prev) / prev * 100)


def volume_acceleration(w: WindowSpec, short: int = 5, long: int = 15) -> Column:
    """(recent / previous short) over (previous short / older long), current bar excluded; 0 on an empty mean."""
    recent = F.avg("volume").over(w.rowsBetween(-short, -1))
    prev = F.avg("volume").over(w.rowsBetween(-2 * short, -short - 1))
    older = F.avg("volume").over(w.rowsBetween(-2 * short - long, -2 * short - 1))
    value = F.when((recent > 0) & (prev > 0) & (older > 0), (recent / prev) / (prev / older)).otherwise(0.0)
    return F.when(F.row_number().over(w) > 2 * short + long, value)


def vwap_deviation(w: WindowSpec, period: int = 20, percent: bool = True) -> Column:
    """Close against the rolling volume-weighted close."""
    frame = w.rowsBetween(-(period - 1), 0)
    vwap = ratio(F.sum(F.col("close") * F.col("volume")).over(frame), F.sum("volume").over(frame))
    dev = ratio(F.col("close") - vwap, vwap)
    if percent:
        return F.when(F.row_number().over(w) >= period, dev * 100)
    return F.when(F.row_number().over(w) >= period, F.coalesce(dev, F.lit(0.0))).otherwise(0.0)


def momentum(w: WindowSpec, window: int = 5) -> Column:
    old = F.lag("close", window).over(w)
    return F.when(old > 0, (F.col("close") - old) / old).otherwise(0.0)


def _bar_return(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    return F.when(prev > 0, (F.col("close") - prev) / prev).when(prev.isNotNull(), 0.0)


def add_volatility(bars: DataFrame, w: WindowSpec, window: int = 20, name: str = "volatility") -> DataFrame:
    """Population deviation of the last `window` chronological returns; 0 before enough bars."""
    b = bars.withColumn("_ret", _bar_return(w))
    sd = F.stddev_pop("_ret").over(w.rowsBetween(-(window - 1), 0))
    return b.withColumn(name, F.when(F.row_number().over(w) > window, sd).otherwise(0.0)).drop("_ret")


def add_rsi(bars: DataFrame, w: WindowSpec, window: int = 14, name: str = "rsi") -> DataFrame:
    """RSI on simple averages of chronological gains and losses; 50 before enough bars or without any change."""
    b = bars.withColumn("_chg", F.col("close") - F.lag("close").over(w))
    frame = w.rowsBetween(-(window - 1), 0)
    gain = F.sum(F.greatest("_chg", F.lit(0.0))).over(frame)
    loss = F.sum(F.greatest(-F.col("_chg"), F.lit(0.0))).over(frame)
    value = F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + ratio(gain, loss)))
    return b.withColumn(name, F.when(F.row_number().over(w) > window, value).otherwise(50.0)).drop("_chg")


def volume_ratio(w: WindowSpec, window: int = 20) -> Column:
    """Volume over the mean of the previous `window` bars (missing ones count as zero); 1 without volume."""
    mean = F.coalesce(F.sum("volume").over(w.rowsBetween(-window, -1)), F.lit(0)) / window
    return ratio("volume", mean, otherwise=1.0)


def add_ema(
    bars: DataFrame,
    period: int = 20,
    keys: tuple[str, ...] = ("ticker",),
    order: str = "bar_start",
    value: str = "close",
    name: str = "ema",
    warmup: bool = True,
    block_ms: int = DAY,
) -> DataFrame:
    """Exponential moving average seeded with the first value; null before `period` rows if `warmup`.

    The recursion is a chain of affine maps, which compose. A ticker's bars are cut into calendar blocks (`order` in ms, `block_ms` each) of at
    most so many rows that decay^-rows stays far from overflow. Inside a block the average is decay^(i+1) * entry value +
    decay^i * sum(alpha * x_j / decay^j), a plain running sum whose terms all have the sign of the data. A block is one map, entry -> last
    value; the maps of SPAN_BLOCKS calendar blocks compose to one, and only those are chained from the first value on. So no row is
    numbered over a whole ticker, and no list is longer than the blocks of a span or the spans of a ticker.
    """
    alpha = 2.0 / (period + 1)
    decay = 1.0 - alpha
    most = max(1, min(2000, int(200 / -math.log(decay)))) if 0 < decay < 1 else 2000
    power = lambda n: F.pow(F.lit(decay), n.cast("double"))
    key, blk = [*keys, "_day", "_sub"], F.struct("_day", "_sub")
    day = Window.partitionBy(*keys, "_day").orderBy(order)
    b = bars.withColumn("_day", floor_div(order, block_ms)).withColumn("_i", F.row_number().over(day) - 1)
    b = b.withColumn("_sub", (F.col("_i") / most).cast("int")).withColumn("_p", F.col("_i") % most)
    term = F.lit(alpha) * F.col(value) * power(-F.col("_p"))
    inside = Window.partitionBy(*key).orderBy("_i")
    b = b.withColumn("_s", F.sum(term).over(inside.rowsBetween(UNB, 0)) * power(F.col("_p")))
    ends = b.groupBy(*key).agg(F.max_by("_s", "_i").alias("_b"), F.count(F.lit(1)).alias("_n"), F.min_by(value, "_i").alias("_first"))
    ends = ends.withColumns({"_a": power(F.col("_n")), "_span": floor_div("_day", SPAN_BLOCKS)})
    maps = lambda w: F.collect_list(F.struct("_a", "_b")).over(w.rowsBetween(UNB, -1))
    compose = lambda earlier: F.aggregate(
        earlier, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda m, e: F.struct((e["_a"] * m["a"]).alias("a"), (e["_a"] * m["b"] + e["_b"]).alias("b"))
    )
    in_span, by_span, by_block = (Window.partitionBy(*keys, *k).orderBy(o) for k, o in ((("_span",), blk), ((), "_span"), ((), blk)))
    ends = ends.withColumns({"_m": compose(maps(in_span)), "_more": F.lead(F.lit(1)).over(in_span)})
    # The last block of a span, after the map of those before it, gives the map of the span.
    whole = F.when(F.col("_more").isNull(), F.struct((F.col("_a") * F.col("_m.a")).alias("_a"), (F.col("_a") * F.col("_m.b") + F.col("_b")).alias("_b")))
    earlier = F.collect_list(whole).over(by_span.rangeBetween(UNB, -1))
    ends = ends.withColumns({"_e": F.aggregate(earlier, F.first("_first").over(by_block), lambda acc, e: e["_a"] * acc + e["_b"]), "_rows": F.sum("_n").over(by_block.rowsBetween(UNB, 0)) - F.col("_n")})
    b = b.join(ends.select(*key, (F.col("_m.a") * F.col("_e") + F.col("_m.b")).alias("_in"), "_rows"), key)
    ema = F.col("_s") + power(F.col("_p") + 1) * F.col("_in")
    if warmup:
        ema = F.when(F.col("_rows") + F.col("_p") >= period - 1, ema)
    return b.select(*bars.columns, ema.alias(name))


def session_vwap(bars: DataFrame, keys: tuple[str, ...] = ("ticker",), order: str = "bar_start") -> DataFrame:
    """Cumulative typical-price VWAP per session, its deviation in percent, growing relative volume, plain EMA(20)."""
    w = Window.partitionBy(*keys).orderBy(order)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    sums = {"_pv": typical * F.col("volume"), "_vol": F.col("volume")}
    b = window_sum_carry(bars, keys, [order], sums, floor_div(order, DAY))
    b = b.withColumn("vwap", F.coalesce(ratio("_pv", "_vol"), F.col("close"))).drop("_pv", "_vol")
    b = b.withColumn("vwap_deviation", (F.col("close") - F.col("vwap")) / F.col("vwap") * 100)
    b = b.withColumn("relative_volume", ratio("volume", F.avg("volume").over(w.rowsBetween(-19, 0)), otherwise=1.0))
    return add_ema(b, 20, keys, order, name="ema_20", warmup=False)


# A bar factor is a function of the ordered bar window; names are those the rules use.
BAR_FACTORS: dict[str, Callable[..., Column]] = {
    "relative_volume": relative_volume,
    "price_direction": lambda w: price_direction(),
    "gap_percent": gap_percent,
    "volume_acceleration": volume_acceleration,
    "vwap_deviation": vwap_deviation,
}


def add_bar_factors(bars: DataFrame, ema_period: int = 20, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The whole bar-factor set in one pass over one sort, plus the EMA."""
    w = bar_window(keys)
    b = bars.select("*", *[make(w).alias(name) for name, make in BAR_FACTORS.items()])
    return add_ema(b, ema_period, keys)
