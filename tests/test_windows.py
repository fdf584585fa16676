"""Bucketed windows and as-of joins against brute force, on data with one hot key and ties across bucket borders."""

import random

import pytest
from pyspark.sql import functions as F

from tapewright.functions.timewin import asof_join, interval_join, latest_by, range_windows, sliding, window_sum_carry

HOUR = 3_600_000


def rows(n, seed, keys=("hot", "a", "b")):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = keys[0] if rnd.random() < 0.6 else rnd.choice(keys)
        ts = 1_700_000_000_000 + rnd.choice([rnd.randrange(0, 20 * HOUR), rnd.randrange(0, 20) * HOUR])
        out.append((k, ts, i, round(rnd.uniform(1, 50), 2)))
    return out


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
@pytest.mark.parametrize("tolerance", [None, 2 * HOUR])
def test_asof(spark, direction, strict, tolerance):
    left, right = rows(120, 1), rows(200, 2)
    l = spark.createDataFrame([(k, t, i) for k, t, i, _ in left], "ticker string, lt long, id long")
    r = spark.createDataFrame(right, "ticker string, ts long, seq long, px double")
    out = asof_join(l, r, ["ticker"], "lt", "ts", ["px"], "seq", direction, strict, tolerance, bucket_ms=HOUR)
    got = {x["id"]: x["px"] for x in out.collect()}
    for k, t, i, _ in left:
        if direction == "backward":
            c = [(ts, s, p) for kk, ts, s, p in right if kk == k and (ts < t if strict else ts <= t)]
            best = max(c) if c else None
        else:
            c = [(ts, s, p) for kk, ts, s, p in right if kk == k and (ts > t if strict else ts >= t)]
            best = min(c) if c else None
        if best and tolerance is not None and abs(best[0] - t) > tolerance:
            best = None
        assert got[i] == (best[2] if best else None), (k, t)


def test_range_windows(spark):
    data = rows(300, 3)
    d = spark.createDataFrame(data, "ticker string, ts long, id long, v double")
    out = range_windows(
        d, ["ticker"], "ts", {"n": lambda w: F.count("v").over(w.rangeBetween(-3 * HOUR, 0)), "m": lambda w: F.max("v").over(w.rangeBetween(1, 2 * HOUR))}, 3 * HOUR, 2 * HOUR, bucket_ms=HOUR
    )
    got = {x["id"]: (x["n"], x["m"]) for x in out.collect()}
    assert len(got) == len(data)
    for k, t, i, _ in data:
        n = sum(1 for kk, tt, _, _ in data if kk == k and t - 3 * HOUR <= tt <= t)
        m = [v for kk, tt, _, v in data if kk == k and t < tt <= t + 2 * HOUR]
        assert got[i] == (n, max(m) if m else None)


def test_interval_join(spark):
    left, right = rows(60, 4), rows(200, 5)
    l = spark.createDataFrame([(k, t, i) for k, t, i, _ in left], "ticker string, t0 long, id long")
    r = spark.createDataFrame(right, "ticker string, ts long, seq long, px double")
    j = interval_join(l, r, ["ticker"], "t0", F.col("t0") + 5 * HOUR, "ts", bucket_ms=HOUR).groupBy("id").agg(F.count("seq").alias("n"))
    got = {x["id"]: x["n"] for x in j.collect()}
    for k, t, i, _ in left:
        assert got[i] == sum(1 for kk, tt, _, _ in right if kk == k and t < tt <= t + 5 * HOUR)


def test_running_sums_and_latest(spark):
    data = rows(200, 6)
    d = spark.createDataFrame(data, "ticker string, ts long, seq long, v double")
    out = window_sum_carry(d, ["ticker"], ["ts", "seq"], {"total": "seq"}, F.expr(f"ts div {HOUR}"))
    got = {x["seq"]: x["total"] for x in out.collect()}
    for k, t, s, _ in data:
        assert got[s] == sum(ss for kk, tt, ss, _ in data if kk == k and (tt, ss) <= (t, s))
    last = {x["ticker"]: x["seq"] for x in latest_by(d, ["ticker"], ["ts", "seq"]).collect()}
    for k in {k for k, *_ in data}:
        assert last[k] == max((tt, ss) for kk, tt, ss, _ in data if kk == k)[1]


@pytest.mark.parametrize("start,end", [(-2 * HOUR, 0), (-3 * HOUR, -1), (1, 5 * HOUR), (-HOUR, HOUR), (0, 0)])
def test_sliding_frames(spark, start, end):
    data = [(k if i % 40 else None, t if i % 37 else None, i, None if i % 9 == 0 else float("nan") if i % 31 == 0 else p) for k, t, i, p in rows(300, 5)]
    d = spark.createDataFrame(data, "ticker string, ts long, id int, px double")
    frames = {"s": ("sum", F.col("id")), "m": ("max", F.col("px")), "l": ("min", F.col("px")), "n": ("count", F.col("px")), "a": ("avg", F.col("id") * 1.0)}
    kept = F.col("id") % 4 == 0 if end > 0 else None
    got = {r["id"]: r for r in sliding(d, ["ticker"], "ts", frames, start, end, kept).collect()}
    assert sorted(got) == [i for _, t, i, _ in data if t is not None and (kept is None or i % 4 == 0)]
    greatest = lambda v: (v != v, v)
    for i, r in got.items():
        key, at = data[i][0], data[i][1]
        near = [(j, p) for k, t, j, p in data if k == key and t is not None and at + start <= t <= at + end]
        ids, prices = [j for j, _ in near], [p for _, p in near if p is not None]
        assert r["s"] == (sum(ids) if ids else None) and r["n"] == len(prices)
        assert r["a"] == (pytest.approx(sum(ids) / len(ids)) if ids else None)
        for name, pick in (("m", max), ("l", min)):
            assert str(r[name]) == str(pick(prices, key=greatest) if prices else None)
        assert (r["ticker"], r["ts"]) == (key, at)


def test_frames_of_ticks_are_gone_through_once(spark):
    """No window over ticks has a frame that moves at both ends, whose rows would be summed anew for each row."""
    from tapewright.operators import events as E, ignition as I, joins as J, tick_factors as T

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    t = spark.createDataFrame(rows(20, 1), "ticker string, ts_ms long, seq long, bid double").selectExpr("*", "bid + 1 AS ask", "seq AS bid_size", "seq AS ask_size", "seq AS size", "bid AS trade_rate")
    p = t.selectExpr("ticker AS entry_id", "ts_ms", "ts_ms - 5 AS entry_ms", "bid AS px", "seq AS sz")
    points = t.selectExpr("ticker", "ts_ms AS entry_ms", "seq AS signal_id")
    for df in (T.arrival_quote_factors(t), I.volume_expansion(p), I.range_breakout(p), E.with_signal_density(t), J.interval_volume(points, t, "entry_ms", HOUR)):
        text = plan(df)
        assert "RangeFrame, unboundedpreceding" in text
        assert text.count("specifiedwindowframe(RangeFrame,") == text.count("specifiedwindowframe(RangeFrame, unboundedpreceding")


def test_interval_volume(spark):
    from tapewright.operators.joins import interval_volume

    trades = [(k, t, i, None if i % 7 == 0 else i) for k, t, i, _ in rows(200, 8)]
    points = [(k if i % 5 else None, t if i % 11 else None, i) for k, t, i, _ in rows(80, 9)] * 2
    got = interval_volume(spark.createDataFrame(points, "ticker string, entry_ms long, signal_id long"), spark.createDataFrame(trades, "ticker string, ts_ms long, seq long, size long"), "entry_ms", 2 * HOUR).collect()
    want = []
    for k, t, i in points:
        if t is not None:
            near = [z for kk, tt, _, z in trades if kk == k and t < tt <= t + 2 * HOUR]
            want.append((i, len(near), sum(z or 0 for z in near)))
    assert sorted((r["signal_id"], r["n"], r["volume"]) for r in got) == sorted(want)
