"""Trade and quote factors as sums that can be put together: one definition for batch tables and for live streams.

A factor names what is summed over the ticks of its window (zero to begin with, a column to add, a sum to merge) and a column
over these sums that finishes it. The batch evaluation takes the sums of all windows of a (ticker, time bucket) as
differences of running sums; the live one does the same over the ticks that its state holds. Both then apply the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.factor_registry import check_params
from tapewright.functions.folds import thin_by_interval
from tapewright.functions.numeric import ratio
from tapewright.functions.rangecount import count_above
from tapewright.functions.timewin import default_bucket, with_halo
from tapewright.operators.tick_factors import tick_side
from tapewright.operators.ticks import spread_bps, valid_quote


@dataclass(frozen=True)
class TickFactor:
    """A factor over the ticks of [t - window_ms, t].

    `sums` are columns of a tick, added up over the window; `buy_sums` over its trades on the buyer's side (tick test; the first trade
    and flat prices count as buys). `above` = (column, multiplier) adds the count of ticks whose value exceeds so many times its mean in
    the window, under the name "above". A null adds zero. `finish` makes the factor from the sums by name.
    """

    window_ms: int
    finish: Callable[[Mapping[str, Column]], Column]
    sums: Mapping[str, Column] = field(default_factory=dict)
    buy_sums: Mapping[str, Column] = field(default_factory=dict)
    above: tuple[Column, float] | None = None
    source: str = "trade"

    @property
    def names(self) -> list[str]:
        return [*self.sums, *self.buy_sums, *(["above"] if self.above else [])]


_MAKERS: dict[str, Callable[..., TickFactor]] = {}


def tick_factor(name: str) -> Callable:
    """Register `fn(**params) -> TickFactor` as a trade or quote factor."""

    def wrap(fn: Callable[..., TickFactor]) -> Callable[..., TickFactor]:
        if name in _MAKERS:
            raise ValueError(f"factor {name!r} exists")
        _MAKERS[name] = fn
        return fn

    return wrap


def make(config: Mapping[str, Mapping]) -> dict[str, TickFactor]:
    """Factors by output name from a configuration {name: {factor, params}}; unknown factors, parameters and values that are no numbers are errors."""
    return {name: _MAKERS[factor](**params) for name, factor, params in check_params(config, _MAKERS, 0)}


def _one() -> Column:
    return F.lit(1).cast("long")


@tick_factor("trade_rate")
def trade_rate(window_ms: int = 20_000, min_trades: int = 5) -> TickFactor:
    return TickFactor(window_ms, lambda w: F.when(w["n"] >= min_trades, w["n"] / (window_ms / 1000.0)), {"n": _one()})


@tick_factor("large_trade_ratio")
def large_trade_ratio(window_ms: int = 20_000, min_trades: int = 5, multiplier: float = 2.0) -> TickFactor:
    return TickFactor(window_ms, lambda w: F.when(w["n"] >= min_trades, w["above"] / w["n"]), {"n": _one()}, above=(F.col("size"), multiplier))


@tick_factor("aggressor_ratio")
def aggressor_ratio(window_ms: int = 20_000, min_trades: int = 5) -> TickFactor:
    return TickFactor(window_ms, lambda w: F.when(w["n"] >= min_trades, w["buys"] / w["n"]), {"n": _one()}, {"buys": _one()})


@tick_factor("bid_ask_spread")
def bid_ask_spread(window_ms: int = 5_000) -> TickFactor:
    bps = F.when(valid_quote(), spread_bps())
    return TickFactor(window_ms, lambda w: ratio(w["bps"], w["n"]), {"bps": bps, "n": F.when(valid_quote(), 1).otherwise(0).cast("long")}, source="quote")


@tick_factor("order_imbalance")
def order_imbalance(window_ms: int = 5_000) -> TickFactor:
    return TickFactor(window_ms, lambda w: ratio(w["bid"] - w["ask"], w["bid"] + w["ask"]), {"bid": F.col("bid_size"), "ask": F.col("ask_size")}, source="quote")


@tick_factor("quote_rate")
def quote_rate(window_ms: int = 10_000, min_quotes: int = 10) -> TickFactor:
    return TickFactor(window_ms, lambda w: F.when(w["n"] >= min_quotes, w["n"] / (window_ms / 1000.0)), {"n": _one()}, source="quote")


def inputs(factors: Mapping[str, TickFactor]) -> list[Column]:
    """What is summed, per tick: `<i>_<name>` for the i-th factor, `<i>_value` for what is compared with its mean."""
    cols = []
    for i, f in enumerate(factors.values()):
        cols += [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{i}_{n}") for n, c in (*f.sums.items(), *f.buy_sums.items())]
        if f.above:
            cols.append(F.coalesce(f.above[0].cast("double"), F.lit(0.0)).alias(f"{i}_value"))
    return cols


@dataclass(frozen=True)
class Shape:
    """What the evaluation inside a task needs to know of a factor; columns stay with the driver."""

    window_ms: int
    sums: tuple[str, ...]
    buy_sums: tuple[str, ...]
    multiplier: float | None

    @property
    def names(self) -> list[str]:
        return [*self.sums, *self.buy_sums, *(["above"] if self.multiplier is not None else [])]


def shapes(factors: Mapping[str, TickFactor]) -> list[Shape]:
    return [Shape(f.window_ms, tuple(f.sums), tuple(f.buy_sums), f.above[1] if f.above else None) for f in factors.values()]


def window_sums(ticks: pd.DataFrame, at: np.ndarray, of: Sequence[Shape]) -> dict[str, np.ndarray]:
    """`<i>_<name>` over [t - window, t] for every time in `at`; `ticks` (ts_ms, is_buy, inputs) go by ts_ms. Ticks of one millisecond count together."""
    ts, buy = ticks["ts_ms"].to_numpy(np.int64), ticks["is_buy"].to_numpy(float)
    out = {}
    for i, f in enumerate(of):
        start, end = np.searchsorted(ts, at - f.window_ms), np.searchsorted(ts, at, side="right")
        for n in (*f.sums, *f.buy_sums):
            x = ticks[f"{i}_{n}"].to_numpy(float)
            running = np.concatenate([[0.0], np.cumsum(x * buy if n in f.buy_sums else x)])
            out[f"{i}_{n}"] = running[end] - running[start]
        if f.multiplier is not None:
            x = ticks[f"{i}_value"].to_numpy(float)
            running = np.concatenate([[0.0], np.cumsum(x)])
            mean = (running[end] - running[start]) / np.maximum(end - start, 1)
            out[f"{i}_above"] = count_above(x, start, end, mean * f.multiplier).astype(float)
    return out


def sums_schema(of: Sequence[Shape]) -> str:
    return ", ".join(f"`{i}_{n}` double" for i, f in enumerate(of) for n in f.names)


def finished(rows: DataFrame, factors: Mapping[str, TickFactor]) -> DataFrame:
    """(ticker, ts_ms) and the factors, from the sums of each window."""
    return rows.select("ticker", "ts_ms", *[f.finish({n: F.col(f"{i}_{n}") for n in f.names}).alias(name) for i, (name, f) in enumerate(factors.items())])


def with_sides(ticks: DataFrame, factors: Mapping[str, TickFactor]) -> DataFrame:
    """`ticks` with is_buy, taken from the prices where a factor asks for it."""
    return tick_side(ticks) if any(f.buy_sums for f in factors.values()) else ticks.withColumn("is_buy", F.lit(0))


def evaluate(ticks: DataFrame, points: DataFrame, factors: Mapping[str, TickFactor], bucket_ms: int | None = None) -> DataFrame:
    """Every factor at each distinct (ticker, ts_ms) of `points`, which need not be ticks; a window without ticks has sums of zero."""
    of = shapes(factors)
    span = max(f.window_ms for f in of)
    rows = with_sides(ticks, factors).select("ticker", "ts_ms", "is_buy", *inputs(factors), F.lit(False).alias("_point"))
    rows = rows.unionByName(points.select("ticker", "ts_ms").distinct().withColumn("_point", F.lit(True)), allowMissingColumns=True)
    halo = with_halo(rows, "ts_ms", bucket_ms or default_bucket(span), span)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        point = group["_point"].to_numpy(bool)
        at = np.sort(group.loc[point & group["_tw_own"].to_numpy(bool), "ts_ms"].to_numpy(np.int64))
        if not len(at):
            return pd.DataFrame()
        out = window_sums(group[~point].sort_values("ts_ms", kind="stable"), at, of)
        return pd.DataFrame({"ticker": [group["ticker"].iloc[0]] * len(at), "ts_ms": at, **out})

    sums = halo.groupBy("ticker", "_tw_bucket").applyInPandas(run, f"ticker string, ts_ms long, {sums_schema(of)}")
    return finished(sums, factors)


def on_arrival(ticks: DataFrame, factors: Mapping[str, TickFactor], every_ms: int = 1_000) -> DataFrame:
    """Every factor at the arrival of a tick, at least `every_ms` after the ticker's last values."""
    beat = thin_by_interval(ticks.select("ticker", "ts_ms"), ["ticker"], "ts_ms", every_ms)
    return evaluate(ticks, beat, factors)
