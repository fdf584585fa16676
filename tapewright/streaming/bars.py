"""Structured Streaming bars: watermarked windows, keyed state with idle close, flush and seam merge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapewright.functions import session as S
from tapewright.operators.bars import finish_bars, merge_partials
from tapewright.operators.ticks import order_key

# How long a closed bar waits for stragglers, and when an idle bar closes by the clock.
LATENESS = "200 milliseconds"
LATENESS_MS = 200
IDLE_MS = 2_000

# Lengths whose UTC-aligned windows never cross a session edge (the edges lie on half hours).
WINDOWS = {"10s": "10 seconds", "1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes"}


def with_event_time(trades: DataFrame) -> DataFrame:
    return trades.withColumn("event_time", F.timestamp_millis("ts_ms"))


def window_partials(trades: DataFrame, timeframe: str, lateness: str = LATENESS) -> DataFrame:
    """Mergeable bars per (ticker, window) under a watermark.

    In append mode a bar is emitted once the watermark passes its end, and later trades are dropped; in
    update mode every change of a bar is emitted. The watermark is the stream's, not the ticker's.
    """
    t = with_event_time(trades).withColumn("_et", S.to_et_ms("ts_ms")).filter(~S.is_closed("_et")).withColumn("_k", order_key())
    g = t.withWatermark("event_time", lateness).groupBy("ticker", F.window("event_time", WINDOWS[timeframe]))
    parts = g.agg(
        F.min("_k").alias("first_key"), F.max("_k").alias("last_key"), F.min_by("price", "_k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_k").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"), F.sum(F.col("price") * F.col("size")).alias("pv"),
    )
    return parts.withColumn("bar_start", S.to_et_ms(F.unix_millis("window.start"))).drop("window")


def window_bars(trades: DataFrame, timeframe: str, lateness: str = LATENESS) -> DataFrame:
    return finish_bars(window_partials(trades, timeframe, lateness), timeframe)


_OUT = "ticker string, bar_start long, bar_end long, open double, high double, low double, close double, volume long, trade_count long, vwap double"
_STATE = "bars string, max_ts long"


def keyed_bars(trades: DataFrame, timeframe: str, idle_ms: int = IDLE_MS, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Bars of any timeframe from keyed state: closed by the ticker's own event time, or by the clock when idle.

    The state of a ticker is its open bars (one or two); a batch's trades are folded in as they come, so
    neither their order nor their number matters for memory. A trade of an already emitted bar is dropped.
    """
    et = S.to_et_ms("ts_ms")
    t = trades.withColumn("_et", et).filter(~S.is_closed("_et"))
    t = t.select("ticker", "ts_ms", "seq", "price", "size", "_et", S.bar_start("_et", timeframe).alias("bar_start"))
    t = t.withColumn("bar_end", S.bar_end("bar_start", timeframe))

    def close(key: tuple, bars: dict, upto: float) -> pd.DataFrame:
        done = sorted(b for b, v in bars.items() if v["end"] <= upto)
        rows = [(key[0], b, bars[b]["end"], bars[b]["o"], bars[b]["h"], bars[b]["l"], bars[b]["c"], bars[b]["v"], bars[b]["n"], bars[b]["pv"] / bars[b]["v"] if bars[b]["v"] else bars[b]["c"]) for b in done]
        for b in done:
            del bars[b]
        return pd.DataFrame(rows, columns=["ticker", "bar_start", "bar_end", "open", "high", "low", "close", "volume", "trade_count", "vwap"])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        raw, seen = state.get if state.exists else ("{}", 0)
        held = json.loads(raw)
        bars = {int(k): v for k, v in held.get("bars", {}).items()}
        closed = held.get("closed", 0)
        if state.hasTimedOut:
            out = close(key, bars, float("inf"))
            closed = max([closed, *out["bar_end"].tolist()])
        else:
            for pdf in batches:
                pdf = pdf[pdf["bar_end"] > closed].sort_values(["ts_ms", "seq"])
                for b, g in pdf.groupby("bar_start"):
                    first, last = g.iloc[0], g.iloc[-1]
                    fk, lk = [int(first["ts_ms"]), int(first["seq"])], [int(last["ts_ms"]), int(last["seq"])]
                    v = bars.setdefault(int(b), {"end": int(first["bar_end"]), "fk": fk, "lk": lk, "o": float(first["price"]), "c": float(last["price"]), "h": -1e300, "l": 1e300, "v": 0, "n": 0, "pv": 0.0})
                    if fk < v["fk"]:
                        v["fk"], v["o"] = fk, float(first["price"])
                    if lk >= v["lk"]:
                        v["lk"], v["c"] = lk, float(last["price"])
                    v["h"], v["l"] = max(v["h"], float(g["price"].max())), min(v["l"], float(g["price"].min()))
                    v["v"] += int(g["size"].sum())
                    v["n"] += len(g)
                    v["pv"] += float((g["price"] * g["size"]).sum())
                if len(pdf):
                    seen = max(seen, int(pdf["_et"].max()))
            out = close(key, bars, seen - lateness_ms)
            closed = max([closed, *out["bar_end"].tolist()])
        state.update((json.dumps({"bars": bars, "closed": int(closed)}), int(seen)))
        if bars:
            state.setTimeoutDuration(idle_ms)
        if len(out):
            yield out

    return t.groupBy("ticker").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def open_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars that `keyed_bars` still held open when its stream under `path` ended: what a session's end flushes."""
    bar = "map<string, struct<end: bigint, o: double, h: double, l: double, c: double, v: bigint, n: bigint, pv: double>>"
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    held = state.select(F.col("key.ticker").alias("ticker"), F.from_json("value.groupState.bars", f"bars {bar}").alias("s"))
    v = F.col("b")
    rows = held.select("ticker", F.explode("s.bars").alias("bar_start", "b"))
    return rows.select(
        "ticker", F.col("bar_start").cast("bigint").alias("bar_start"), v["end"].alias("bar_end"), v["o"].alias("open"), v["h"].alias("high"), v["l"].alias("low"), v["c"].alias("close"),
        v["v"].alias("volume"), v["n"].alias("trade_count"), F.when(v["v"] != 0, v["pv"] / v["v"]).otherwise(v["c"]).alias("vwap"),
    )


def seam_merge(history: DataFrame, live: DataFrame, timeframe: str) -> DataFrame:
    """Stored partial bars and streamed ones, combined where both hold a part of the same bar."""
    return finish_bars(merge_partials(history.unionByName(live)), timeframe)
