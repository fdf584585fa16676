"""Order-dependent folds with constant memory per key.

Rows are hash-partitioned by key, sorted inside their partition by Spark (which spills), and handed to
Python as a stream of Arrow batches. The fold carries one small state per key from batch to batch, so
no group is ever materialised, however many rows a key has.

`transitions` runs alternating state machines. A machine goes through its modes in turn. It leaves a mode at the first row
on which the mode's condition holds and which is not held back: after leaving mode m, the next mode cannot be left for
`hold[m]` milliseconds. Throttles and cooldowns are machines of one mode, activity states one of two. Rows are cut into time
buckets. What a bucket does to the machine depends only on the mode and on the time up to which it is held when it enters,
and the exit is the same for long stretches of such times, since chains that start at different rows soon meet. So each bucket is
first reduced to its map from entry to exit (in parallel), the small maps of a key are chained (one row a bucket), and then
every bucket is replayed from its true entry (in parallel again).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.numeric import floor_div


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[pd.DataFrame, dict], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run `step(rows, state) -> rows` over each key's rows in order, batch by batch.

    `state` is a dict private to the key, empty at its first batch.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for batch in batches:
            if batch.empty:
                continue
            # Rows arrive sorted by key, so each key is one run of equal rows.
            changed = (batch[keys] != batch[keys].shift()).any(axis=1)
            for _, part in batch.groupby(changed.cumsum(), sort=False):
                key = tuple(part.iloc[0][keys])
                if key != current:
                    current, state = key, {}
                out = step(part.reset_index(drop=True), state)
                if len(out):
                    yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


FREE = -(2**62)  # a machine that nothing holds back


class Links:
    """Where the machine goes from each row of one bucket on which it can change its mode."""

    def __init__(self, ts: np.ndarray, leave: list[np.ndarray], hold: Sequence[int]):
        self.ts, self.hold, self.modes = ts, hold, len(leave)
        self.rows = [np.flatnonzero(c) for c in leave]  # rows that can leave mode m
        self.times = [ts[r] for r in self.rows]
        self.next = []
        for m in range(self.modes):
            after = (m + 1) % self.modes
            held = np.searchsorted(self.times[after], self.times[m] + hold[m])
            self.next.append(np.maximum(held, np.searchsorted(self.rows[after], self.rows[m], side="right")).tolist())

    def first(self, mode: int, wake: int) -> int:
        return int(np.searchsorted(self.times[mode], wake))

    def chain(self, mode: int, at: int):
        """(mode left, position among its rows) for each change, from the given one on."""
        while at < len(self.rows[mode]):
            yield mode, at
            at, mode = self.next[mode][at], (mode + 1) % self.modes

    def exits(self) -> tuple[list, list, list]:
        """Per mode: bounds, and the exit mode and wake time of entries held until at most that bound."""
        memo: list[dict] = [{} for _ in range(self.modes)]
        span = max(self.hold)
        bounds, to_mode, to_wake = [], [], []
        for mode in range(self.modes):
            times = self.times[mode]
            last = int(np.searchsorted(times, self.ts[0] + span, side="right")) + 1
            b, em, ew = [], [], []
            for at in range(min(last, len(times))):
                if at and times[at] == times[at - 1]:
                    continue  # no entry starts at the second of two rows of one time
                path, end = [], None
                for m, p in self.chain(mode, at):
                    if p in memo[m]:
                        end = memo[m][p]
                        break
                    path.append((m, p))
                if end is None:
                    m, p = path[-1]
                    end = ((m + 1) % self.modes, int(self.times[m][p]) + self.hold[m])
                for m, p in path:
                    memo[m][p] = end
                if b and (em[-1], ew[-1]) == end:
                    b[-1] = int(times[at])
                else:
                    b.append(int(times[at]))
                    em.append(end[0])
                    ew.append(end[1])
            bounds.append(b)
            to_mode.append(em)
            to_wake.append(ew)
        return bounds, to_mode, to_wake


def _links(rows: pd.DataFrame, ts: str, order: Sequence[str], hold: Sequence[int]) -> tuple[pd.DataFrame, Links]:
    rows = rows.sort_values([ts, *order], kind="stable", ignore_index=True)
    return rows, Links(rows[ts].to_numpy(np.int64), [rows[f"_leave{m}"].to_numpy(bool) for m in range(len(hold))], hold)


def transitions(
    df: DataFrame, keys: Sequence[str], ts: str, leave: Sequence[Column], hold_ms: Sequence[int], order: Sequence[str] = (), name: str = "mode", bucket_ms: int | None = None
) -> DataFrame:
    """The rows of `df` at which its key's machine changes, with the number of the mode it enters.

    A key starts in mode 0, held by nothing. Rows go by (`ts`, `order`); a condition that is null does not hold.
    """
    keys, hold = list(keys), [int(h) for h in hold_ms]
    bucket = bucket_ms or max(60_000, 16 * max(hold))
    if bucket < max(hold):
        raise ValueError(f"a bucket of {bucket} ms is shorter than a hold of {max(hold)} ms")
    flags = [F.coalesce(c, F.lit(False)).alias(f"_leave{m}") for m, c in enumerate(leave)]
    rows = df.select("*", *flags, floor_div(ts, bucket).alias("_b"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = list(types)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        bounds, to_mode, to_wake = _links(group, ts, order, hold)[1].exits()
        return pd.DataFrame([[*group.iloc[0][[*keys, "_b"]], bounds, to_mode, to_wake]], columns=[*keys, "_b", "bounds", "to_mode", "to_wake"])

    narrow = rows.select(*dict.fromkeys([*keys, ts, *order, "_b", *[f"_leave{m}" for m in range(len(hold))]]))
    maps = narrow.groupBy(*keys, "_b").applyInPandas(reduce, f"{key_schema}, _b long, bounds array<array<long>>, to_mode array<array<int>>, to_wake array<array<long>>")

    def enter(part: pd.DataFrame, state: dict) -> pd.DataFrame:
        mode, wake = state.get("mode", 0), state.get("wake", FREE)
        modes, wakes = [], []
        for bounds, to_mode, to_wake in zip(part["bounds"], part["to_mode"], part["to_wake"], strict=True):
            modes.append(mode)
            wakes.append(wake)
            at = int(np.searchsorted(bounds[mode], wake))
            if at < len(bounds[mode]):
                mode, wake = int(to_mode[mode][at]), int(to_wake[mode][at])
        state["mode"], state["wake"] = mode, wake
        return part[[*keys, "_b"]].assign(_mode=modes, _wake=wakes)

    entries = ordered_fold(maps, keys, ["_b"], enter, f"{key_schema}, _b long, _mode int, _wake long")

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group, links = _links(group, ts, order, hold)
        mode, wake = int(group["_mode"].iloc[0]), int(group["_wake"].iloc[0])
        changes = [(links.rows[m][p], (m + 1) % links.modes) for m, p in links.chain(mode, links.first(mode, wake))]
        return group.iloc[[i for i, _ in changes]][columns].assign(**{name: [m for _, m in changes]})

    schema = ", ".join(f"`{n}` {t}" for n, t in types.items())
    return rows.join(entries, [*keys, "_b"]).groupBy(*keys, "_b").applyInPandas(replay, f"{schema}, `{name}` int")


def thin_by_interval(df: DataFrame, keys: Sequence[str], ts: str, interval_ms: int, order: Sequence[str] = ()) -> DataFrame:
    """Keep a row when at least `interval_ms` passed since the last kept row of its key; the first row is kept."""
    return transitions(df, keys, ts, [F.lit(True)], [interval_ms], order, "_mode").drop("_mode")
