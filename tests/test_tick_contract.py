"""One definition of a tick factor gives the values of a plain walk in batch and live; the state of an idle ticker is emptied."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - the example factors are registered with the queries
from tapewright.operators import tick_contract as TC
from tapewright.plans import load_all
from tapewright.streaming.factors import live_tick_factors
from tapewright.streaming.run import append_files, stream_parquet
from tests.test_extremes import SCHEMA, make_trades

CONFIG = {
    "rate": {"factor": "trade_rate", "params": {"window_ms": 2_000, "min_trades": 3}},
    "large": {"factor": "large_trade_ratio", "params": {"window_ms": 5_000, "min_trades": 2, "multiplier": 1.5}},
    "buyers": {"factor": "aggressor_ratio", "params": {"window_ms": 1_000, "min_trades": 1}},
    "flow": {"factor": "signed_flow", "params": {"window_ms": 3_000}},
}


def walk(rows, every):
    """Values by (ticker, ts): trades of a millisecond come together."""
    out, last, prev, seen = {}, {}, {}, {}
    for ticker, ts, seq, px, size in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen.setdefault(ticker, []).append((ts, px, size, int(px >= prev.get(ticker, px))))
        prev[ticker] = px
    for ticker, ticks in seen.items():
        for ts in sorted({t[0] for t in ticks}):
            if ticker in last and ts - last[ticker] < every:
                continue
            last[ticker] = ts
            w = lambda ms: [t for t in ticks if ts - ms <= t[0] <= ts]  # noqa: B023, E731
            rate, big, buy, flow = w(2_000), w(5_000), w(1_000), w(3_000)
            mean = sum(t[2] for t in big) / len(big)
            dollars, bought = (sum(t[1] * t[2] for t in flow if t[3] >= k) for k in (0, 1))
            out[ticker, ts] = (
                len(rate) / 2 if len(rate) >= 3 else None, sum(t[2] > 1.5 * mean for t in big) / len(big) if len(big) >= 2 else None,
                sum(t[3] for t in buy) / len(buy), (2 * bought - dollars) / dollars,
            )
    return out


def check(got, want):
    got = {(r.ticker, r.ts_ms): (r.rate, r.large, r.buyers, r.flow) for r in got}
    assert set(got) == set(want)
    for k, values in want.items():
        assert [None if v is None else pytest.approx(v, abs=1e-9) for v in values] == list(got[k]), k


@pytest.mark.parametrize("bucket", [None, 6_000])
def test_batch(spark, bucket, monkeypatch):
    load_all()
    if bucket:
        monkeypatch.setattr(TC, "default_bucket", lambda span: bucket)
    rows = make_trades(3_000)
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(TC.on_arrival(d, TC.make(CONFIG), 700).collect(), walk(rows, 700))
    assert TC.on_arrival(d.limit(0), TC.make(CONFIG), 700).collect() == []


def test_live_across_restarts(spark, tmp_path):
    load_all()
    rows, path = sorted(make_trades(3_000), key=lambda r: r[1]), str(tmp_path)
    like = spark.createDataFrame([], SCHEMA)
    cuts = [0, 1_000, 1_010, 2_200, len(rows)]
    cuts = [next((i for i in range(c, len(rows)) if rows[i][1] != rows[i - 1][1]), len(rows)) if c else 0 for c in cuts]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(2).write.mode("append").parquet(f"{path}/in")
        append_files(live_tick_factors(stream_parquet(spark, f"{path}/in", like), TC.make(CONFIG), 700, lateness="2 hours"), path)
    check(spark.read.parquet(f"{path}/data").collect(), walk(rows, 700))


def test_an_idle_ticker_keeps_its_price_and_beat_only(spark, tmp_path):
    load_all()
    path, like = str(tmp_path), spark.createDataFrame([], SCHEMA)
    stages = [[("A", 1_000, 1, 10.0, 5), ("B", 1_000, 2, 5.0, 1)], [("B", 90_000, 3, 5.0, 1)], [("A", 95_000, 4, 9.0, 5), ("B", 95_000, 5, 5.0, 1)]]
    factors = TC.make({"buyers": {"factor": "aggressor_ratio", "params": {"window_ms": 5_000, "min_trades": 1}}})
    for rows in stages:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        append_files(live_tick_factors(stream_parquet(spark, f"{path}/in", like), factors, 700), path)
    got = {(r.ticker, r.ts_ms): r.buyers for r in spark.read.parquet(f"{path}/data").collect()}
    # A's second trade is below the price that outlived its window.
    assert got == {("A", 1_000): 1.0, ("B", 1_000): 1.0, ("B", 90_000): 1.0, ("A", 95_000): 0.0, ("B", 95_000): 1.0}


def test_configurations_are_checked():
    with pytest.raises(ValueError, match="unknown factor"):
        TC.make({"x": {"factor": "nothing"}})
    with pytest.raises(ValueError, match="unknown parameter"):
        TC.make({"trade_rate": {"params": {"windows": 3}}})
    with pytest.raises(ValueError, match="not a number"):
        TC.make({"trade_rate": {"params": {"window_ms": "3"}}})
    with pytest.raises(ValueError, match="exists"):
        TC.tick_factor("trade_rate")(lambda: None)


def test_a_factor_may_count_nulls_as_zero(spark):
    f = {"mean": TC.TickFactor(10, lambda w: F.when(w["n"] > 0, w["x"] / w["n"]), {"x": F.col("price"), "n": F.lit(1)})}
    d = spark.createDataFrame([("a", 5, 1, None, 1), ("a", 6, 2, 4.0, 1)], SCHEMA)
    points = spark.createDataFrame([("a", 4), ("a", 6), ("a", 16), ("a", 17), ("b", 1)], "ticker string, ts_ms long")
    assert sorted(tuple(r) for r in TC.evaluate(d, points, f).collect() if r.mean is not None) == [("a", 6, 2.0), ("a", 16, 4.0)]
