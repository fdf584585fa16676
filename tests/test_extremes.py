"""Window extremes, counted ranges, labels and first passages against plain loops, with one ticker holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions.extremes import window_extremes
from tapewright.functions.rangecount import count_above
from tapewright.operators import exits as X, passage as P
from tapewright.operators.tick_factors import labeling_factors

SCHEMA = "ticker string, ts_ms long, seq long, price double, size long"


def make_trades(n=4_000, seed=4, gaps=(0, 0, 5, 40, 300, 2_000)):
    """Nine trades of ten are of one ticker, many of them within one millisecond."""
    rnd = random.Random(seed)
    now, px, out = {"HOT": 1_000_000, "b": 1_000_000}, {"HOT": 20.0, "b": 5.0}, []
    for i in range(n):
        k = "HOT" if i % 10 else "b"
        now[k] += rnd.choice(gaps) * (1 if k == "HOT" else 9)
        px[k] = max(0.5, round(px[k] * (1 + rnd.uniform(-0.02, 0.0202)), 2))
        out.append((k, now[k], i, px[k], rnd.choice([1, 2, 5, 100, 400])))
    return out


@pytest.mark.parametrize("length, most, include", [(1_000, 3_600_000, False), (60_000, 7_500, True), (60_000, 60_000, False), (12_000, 1_000, False), (7_919, 1_000, True)])
def test_window_extremes(spark, length, most, include):
    rows = make_trades()
    rnd = random.Random(length)
    points = [(f"p{i}", rnd.choice(["HOT", "HOT", "b", "none"]), rnd.choice(rows)[1] + rnd.choice([0, 0, -1, 13])) for i in range(500)]
    points += [("before", "HOT", 0), ("after", "HOT", 10**9)]
    got = window_extremes(spark.createDataFrame(points, "k string, ticker string, at long"), spark.createDataFrame(rows, SCHEMA), "k", "at", length, include_start=include, most_ms=most)
    want = {}
    for k, ticker, at in points:
        w = sorted(r[1:4] for r in rows if r[0] == ticker and (at <= r[1] if include else at < r[1]) and r[1] <= at + length)
        if w:
            hi, lo = max(p for *_, p in w), min(p for *_, p in w)
            want[k] = (hi, min(t for t, _, p in w if p == hi), lo, min(t for t, _, p in w if p == lo), w[-1][2], w[-1][0])
    assert {r.k: tuple(r)[1:] for r in got.collect()} == want and len(want) > 150


def test_count_above():
    rng = np.random.default_rng(0)
    for n, kinds in ((1, 1), (50, 3), (500, 400), (3_000, 7)):
        v = rng.integers(0, kinds, n) * 3
        ends = np.sort(rng.integers(0, n + 1, (200, 2)), axis=1)
        limit = np.concatenate([rng.uniform(-5, 3 * kinds + 5, 100), rng.choice(v, 100).astype(float)])
        assert count_above(v, ends[:, 0], ends[:, 1], limit).tolist() == [int((v[a:b] > x).sum()) for (a, b), x in zip(ends, limit, strict=True)]


@pytest.mark.parametrize("bucket", [None, 5_000])
def test_labels_equal_a_walk(spark, bucket):
    rows = sorted(make_trades(1_500), key=lambda r: (r[0], r[1], r[2]))
    got = {r.seq: tuple(r)[3:] for r in labeling_factors(spark.createDataFrame(rows, SCHEMA).repartition(4), 3_000, 5, bucket_ms=bucket).collect()}
    side, prev, w = {}, {}, {}
    for ticker, ts, seq, px, size in rows:
        if ticker in prev and px != prev[ticker]:
            side[ticker] = int(px > prev[ticker])
        prev[ticker] = px
        q = w.setdefault(ticker, [])
        q.append((ts, size, side.get(ticker, 1)))
        q[:] = [x for x in q if x[0] >= ts - 3_000]
        n, span, mean = len(q), ts - q[0][0], sum(x[1] for x in q) / len(q)
        want = (n / (span / 1000), sum(x[1] > 2 * mean for x in q) / n, sum(x[2] for x in q) / n) if n >= 5 and span > 0 else (0, 0, 0)
        assert got[seq] == pytest.approx(want, abs=6e-4)
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def session(spark):
    rows = make_trades(3_000, 9, (0, 0, 20, 400, 3_000, 20_000))
    rnd = random.Random(2)
    entries = [(f"e{i}", t, ts + rnd.choice([0, 7]), px, ts + rnd.choice([0, 500, 60_000, 2_000_000, 50_000_000])) for i, (t, ts, _, px, _) in enumerate(rnd.sample(rows, 80))]
    d = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    return rows, entries, d, spark.createDataFrame(entries, "entry_id string, ticker string, entry_ms long, entry_price double, session_end_ms long").cache()


def plain_exit(path, s, entry, t0):
    peak = trough = None
    for ts, px in path:
        peak, trough = max(px, peak or px), min(px, trough or px)
        if s.sl is not None and px <= entry * (1 - s.sl / 100):
            return "stop_loss", ts, px, peak, trough
        if s.tp is not None and px >= entry * (1 + s.tp / 100):
            return "take_profit", ts, px, peak, trough
        if s.trail is not None and px <= max(peak, entry) * (1 - s.trail / 100):
            return "trailing_stop", ts, px, peak, trough
        if s.time_min is not None and ts >= t0 + s.time_min * 60_000:
            return "time_stop", ts, px, peak, trough
    return "session_end", None, path[-1][1], peak, trough


@pytest.mark.parametrize("bucket", [10_000, 900_000])
def test_first_passages_equal_a_walk(session, bucket, monkeypatch):
    rows, entries, trades, d = session
    monkeypatch.setattr(P.first_hits, "__defaults__", (*P.first_hits.__defaults__[:-1], bucket))
    sweep = (*X.SWEEP, X.Strategy(trail=1.0), X.Strategy(sl=1.0, tp=1.0, trail=0.5, time_min=3.0))
    got = {(r.entry_id, r.strategy): r for r in X.simulate_entries(d, trades, sweep).collect()}
    n = 0
    for e, ticker, t0, price, end in entries:
        path = [(ts, px) for k, ts, _, px, _ in sorted(rows, key=lambda r: (r[1], r[2])) if k == ticker and t0 < ts <= end]
        for s in sweep if path else ():
            reason, ts, px, peak, trough = plain_exit(path, s, price, t0)
            r = got[e, s.name]
            n += 1
            assert (r.exit_reason, r.exit_ms, r.exit_price) == (reason, end if ts is None else ts, px), (e, s)
            assert (r.mfe_pct, r.mae_pct) == pytest.approx(((peak - price) / price * 100, (trough - price) / price * 100))
    assert n == len(got) > 1_000


def test_only_crossing_buckets_are_opened(session):
    """Entries that never cross a level read summaries, and the ticks of their first and last bucket, but open no bucket."""
    _, _, trades, d = session
    far = X.simulate_entries(d, trades, (X.Strategy(tp=10_000.0, sl=100.0),))
    assert {r.exit_reason for r in far.collect()} == {"session_end"}
    opened = P.first_hits(d, trades, ["entry_id", "entry_price"], [F.lit(False)], [F.lit("x")])
    assert opened.filter(F.col("_x0").isNotNull()).count() == 0 and opened.count() == far.count()


def test_labels_after_the_first_rise(session):
    rows, entries, trades, d = session
    got = {r.entry_id: (r.hit_ms, r.hit_price, r.label) for r in X.continuation_labels(d, trades, 2.0, 4.0).collect()}
    want = {}
    for e, ticker, t0, price, end in entries:
        path = [(ts, px) for k, ts, _, px, _ in sorted(rows, key=lambda r: (r[1], r[2])) if k == ticker and t0 < ts <= end]
        hit = next(((ts, px) for ts, px in path if px >= price * (1 + 2.0 / 100)), None)
        after = [px for ts, px in path if hit and ts > hit[0]]
        if after:
            want[e] = (*hit, "runner" if max(after) >= price * (1 + 4.0 / 100) else "fader" if min(after) <= price else "drift")
    assert got == want and len({x for *_, x in want.values()}) >= 2


def test_empty_inputs(session):
    _, _, trades, d = session
    assert X.simulate_entries(d.limit(0), trades, X.SWEEP).collect() == []
    assert X.simulate_entries(d, trades.limit(0), X.SWEEP).collect() == []
    assert window_extremes(d, trades.limit(0), "entry_id", "entry_ms", 1_000).collect() == []
