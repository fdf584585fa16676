"""Streaming factors: sliding trade windows and bar-close factors with per-ticker state."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapewright.functions.folds import FREE, Links
from tapewright.operators.tick_contract import TickFactor, finished, inputs, shapes, sums_schema, window_sums
from tapewright.streaming.bars import LATENESS, with_event_time

COLUMNS = ["bar_start", "open", "high", "low", "close", "volume"]


def sliding_trade_rate(trades: DataFrame, window_ms: int = 20_000, slide_ms: int = 1_000, min_trades: int = 5, lateness: str = LATENESS) -> DataFrame:
    """Trades per second over [t - window, t) for every slide, once the watermark passes t; null below `min_trades`."""
    w = F.window("event_time", f"{window_ms} milliseconds", f"{slide_ms} milliseconds")
    g = with_event_time(trades).withWatermark("event_time", lateness).groupBy("ticker", w).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"))
    rate = F.when(F.col("n") >= min_trades, F.col("n") / (window_ms / 1000.0))
    return g.select("ticker", F.unix_millis("window.end").alias("ts_ms"), "n", rate.alias("trade_rate"))


def live_tick_factors(ticks: DataFrame, factors: Mapping[str, TickFactor], every_ms: int = 1_000, lateness: str = LATENESS) -> DataFrame:
    """Every factor at the arrival of a tick, at least `every_ms` after the ticker's last values.

    The definitions are those of `operators.tick_contract`. A ticker's state is what it summed over the ticks of the longest window, its last price and
    the time of its next values; when event time has passed that window without a tick, a timer empties it but for the
    price and the time. Ticks later than the watermark are dropped; one that comes later than its neighbours counts from then on.
    """
    of = shapes(factors)
    span, names = max(f.window_ms for f in of), [f"{i}_{n}" for i, f in enumerate(of) for n in (*f.sums, *f.buy_sums, *(["value"] if f.multiplier is not None else []))]
    kept = ["ts_ms", "is_buy", *names]
    sided = any(f.buy_sums for f in of)
    price = F.col("price") if sided else F.lit(0.0)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, wake = state.get if state.exists else (b"", None, FREE)
        if state.hasTimedOut:
            state.update((b"", last, wake))
            return
        new = pd.concat(list(batches)).sort_values(["ts_ms", "seq"], kind="stable", ignore_index=True)
        prev = new["price"].shift().fillna(new["price"].iloc[0] if last is None else last)
        new["is_buy"] = (new["price"] >= prev).astype(float)
        before = pd.DataFrame(np.frombuffer(held, float).reshape(-1, len(kept)), columns=kept).astype({"ts_ms": np.int64})
        window = pd.concat([before, new[kept]]) if len(before) else new[kept]
        window = window.sort_values("ts_ms", kind="stable", ignore_index=True)
        times = new["ts_ms"].to_numpy(np.int64)
        beat = Links(times, [np.ones(len(times), bool)], [every_ms])
        at = np.array([times[p] for _, p in beat.chain(0, beat.first(0, wake))], np.int64)
        if len(at):
            wake = int(at[-1]) + every_ms
            yield pd.DataFrame({"ticker": key[0], "ts_ms": at, **window_sums(window, at, of)})
        newest = int(window["ts_ms"].iloc[-1])
        # Times in milliseconds are exact as doubles.
        state.update((window[window["ts_ms"] >= newest - span].to_numpy(float).tobytes(), float(new["price"].iloc[-1]), wake))
        state.setTimeoutTimestamp(max(newest + span, state.getCurrentWatermarkMs() + 1))

    t = with_event_time(ticks).withWatermark("event_time", lateness)
    rows = t.select("ticker", "ts_ms", "seq", price.alias("price"), "event_time", *inputs(factors))
    out = rows.groupBy("ticker").applyInPandasWithState(
        update, f"ticker string, ts_ms long, {sums_schema(of)}", "held binary, price double, wake long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return finished(out, factors)


def bar_close_factors(bars: DataFrame, lookback: int = 20, short: int = 5, long: int = 15) -> DataFrame:
    """All bar factors at every bar close, from a state of the last bars, one average and the number of bars so far.

    The definitions are those of `operators.bar_factors`. Bars at or before the last one seen are dropped,
    so history can be replayed first and live bars that overlap it follow without a break. A batch of
    a ticker's bars is worked on as columns; a ticker has at most one bar a slot.
    """
    alpha, keep = 2.0 / (lookback + 1), max(lookback, 2 * short + long)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"bars": [], "ema": None, "n": 0}
        before = pd.DataFrame(held["bars"], columns=COLUMNS)
        rows = pd.concat(list(batches))[COLUMNS].drop_duplicates("bar_start").sort_values("bar_start")
        if len(before):
            rows = rows[rows["bar_start"] > before["bar_start"].iloc[-1]]
        if rows.empty:
            return
        b = pd.concat([before, rows], ignore_index=True) if len(before) else rows.reset_index(drop=True)
        count = held["n"] - len(before) + np.arange(1, len(b) + 1)  # bars of the ticker up to each row
        vol, close, span = b["volume"].astype(float), b["close"], (b["high"] - b["low"])
        mean = lambda n, lag=0: vol.shift(lag).rolling(n).mean()
        recent, prev, older = mean(short, 1), mean(short, short + 1), mean(long, 2 * short + 1)
        vwap = (close * vol).rolling(lookback).sum() / vol.rolling(lookback).sum()
        first = held["ema"] if held["ema"] is not None else float(close.iloc[len(before)])
        new = close.iloc[len(before) :]
        ema = pd.Series([first, *new]).ewm(alpha=alpha, adjust=False).mean().iloc[1:] if held["ema"] is not None else new.ewm(alpha=alpha, adjust=False).mean()
        ready = count >= lookback
        fine = (recent > 0) & (prev > 0) & (older > 0)
        out = pd.DataFrame({
            "ticker": key[0], "bar_start": b["bar_start"],
            "relative_volume": (vol / mean(lookback)).where(ready & (mean(lookback) > 0)),
            "price_direction": ((close - b["low"]) / span).clip(0, 1).where(span > 0),
            "gap_percent": ((b["open"] - close.shift()) / close.shift() * 100).where(close.shift() > 0),
            "volume_acceleration": ((recent / prev) / (prev / older)).where(fine, 0.0).where(count > 2 * short + long),
            "vwap_deviation": ((close - vwap) / vwap * 100).where(ready),
        }).iloc[len(before) :]
        out["ema"] = np.where(ready[len(before) :], ema.to_numpy(), np.nan)
        state.update((json.dumps({"bars": b.tail(keep).to_numpy(object).tolist(), "ema": float(ema.iloc[-1]), "n": int(count[-1])}),))
        yield out.astype(object).where(out.notna(), None)

    schema = "ticker string, bar_start long, relative_volume double, price_direction double, gap_percent double, volume_acceleration double, vwap_deviation double, ema double"
    return bars.select("ticker", *COLUMNS).groupBy("ticker").applyInPandasWithState(update, schema, "held string", "append", GroupStateTimeout.NoTimeout)
