"""Streaming rules with a cooldown, the activity state machine, and catalyst events joined to market data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapewright.functions.folds import FREE, Links
from tapewright.functions.rules import Rule
from tapewright.operators.events import ACTIVE_Z, STATE_HOLD_MS, is_active, rule_matches


def signals_with_cooldown(factors: DataFrame, rules: Sequence[Rule], cooldown_ms: int = 60_000) -> DataFrame:
    """Rule matches whose last kept trigger of the same (rule, ticker) is at least `cooldown_ms` old."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # Only the times of one key and micro-batch are held.
        times = sorted(int(x) for pdf in batches for x in pdf["ts_ms"])
        kept = []
        for ts in times:
            if last is None or ts - last >= cooldown_ms:
                kept.append((key[0], key[1], ts))
                last = ts
        if last is not None:
            state.update((last,))
        if kept:
            yield pd.DataFrame(kept, columns=["rule", "ticker", "ts_ms"])

    m = rule_matches(factors, rules)
    return m.groupBy("rule", "ticker").applyInPandasWithState(update, "rule string, ticker string, ts_ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def activity_stream(factors: DataFrame, z_threshold: float = ACTIVE_Z, hold_ms: int = STATE_HOLD_MS) -> DataFrame:
    """QUIET/ACTIVE transitions of a live factor stream (ticker, ts_ms, z, accel), by the machine of `events.activity_states`.

    A ticker's state is its mode and the time up to which it is held. Rows of a micro-batch go by their time; a row
    that arrives in a later batch than a newer one is judged after it.
    """
    hold = [hold_ms, 0]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, wake = state.get if state.exists else (0, FREE)
        rows = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
        on = rows["on"].to_numpy(bool)
        links = Links(rows["ts_ms"].to_numpy(), [on, ~on], hold)
        moves = [(int(links.times[m][p]), 1 - m) for m, p in links.chain(mode, links.first(mode, wake))]
        if moves:
            ts, mode = moves[-1]
            wake = ts + hold[1 - mode]
            yield pd.DataFrame({"ticker": key[0], "ts_ms": [t for t, _ in moves], "state": ["ACTIVE" if m else "QUIET" for _, m in moves]})
        state.update((mode, wake))

    rows = factors.select("ticker", "ts_ms", is_active(z_threshold).alias("on"))
    return rows.groupBy("ticker").applyInPandasWithState(update, "ticker string, ts_ms long, state string", "mode int, wake long", "append", GroupStateTimeout.NoTimeout)


def catalyst_stream(news: DataFrame, latest_market: DataFrame, profiles: DataFrame) -> DataFrame:
    """Positive catalysts joined to the newest market row and the profile of their ticker (stream-static joins)."""
    pos = news.filter(F.col("is_catalyst"))
    return pos.join(latest_market, "ticker", "left").join(profiles.select("ticker", "float_shares", "sector"), "ticker", "left")
