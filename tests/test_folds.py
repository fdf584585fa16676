"""Interval thinning and alternating machines, cut into buckets, equal a walk over a whole key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions.folds import Links, thin_by_interval, transitions


def test_thinning_matches_plain_loop(spark):
    random.seed(8)
    rows, t = [], 0
    for i in range(600):
        t += random.choice([0, 10, 700, 900, 1_000, 5_000, 4_000_000])
        rows.append(("A" if i % 10 else "B", t, i))
    got = thin_by_interval(spark.createDataFrame(rows, "k string, ts long, seq long"), ["k"], "ts", 1_000, ["seq"]).collect()
    want, last = [], {}
    for k, ts, seq in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or ts - last[k] >= 1_000:
            want.append((k, ts, seq))
            last[k] = ts
    assert sorted(map(tuple, got)) == sorted(want)


def walk(rows, hold):
    """(key, ts, seq, mode) of each change; rows are (key, ts, seq, flags)."""
    state, out = {}, []
    for k, ts, seq, flags in sorted(rows, key=lambda r: r[:3]):
        mode, wake = state.get(k, (0, None))
        if flags[mode] and (wake is None or ts >= wake):
            state[k] = ((mode + 1) % len(hold), ts + hold[mode])
            out.append((k, ts, seq, (mode + 1) % len(hold)))
    return sorted(out)


@pytest.mark.parametrize("hold, bucket", [([1_000], 1_000), ([1_000], None), ([7_000, 0], 7_000), ([7_000, 0], None), ([3_000, 500, 2_000], 4_000)])
def test_machines_equal_a_walk(spark, hold, bucket):
    """One key holds nine tenths of the rows, without a gap as long as a hold, so no pause ever resets it."""
    rnd = random.Random(len(hold) * 100 + hold[0])
    rows, now = [], {"hot": 0, "b": 0}
    for i in range(9_000):
        k = "hot" if i % 10 else "b"
        now[k] += rnd.choice([0, 0, 1, 30, 90, 400]) if k == "hot" else rnd.choice([0, 500, 20_000, 300_000])
        rows.append((k, now[k], i, tuple(rnd.random() < p for p in (0.3, 0.6, 0.2)[: len(hold)])))
    d = spark.createDataFrame([(k, ts, seq, list(f)) for k, ts, seq, f in rows], "k string, ts long, seq long, f array<boolean>")
    flags = [F.get("f", F.lit(m)) for m in range(len(hold))]
    got = transitions(d, ["k"], "ts", flags, hold, ["seq"], bucket_ms=bucket).collect()
    assert sorted((r.k, r.ts, r.seq, r.mode) for r in got) == walk(rows, hold)


def test_a_hot_key_is_cut_into_buckets_and_its_maps_are_small():
    rnd = random.Random(3)
    ts = np.sort(np.array([rnd.randrange(0, 60_000) for _ in range(20_000)]))
    bounds, _, wakes = Links(ts, [np.ones(len(ts), bool)], [1_000]).exits()
    assert len(bounds[0]) <= 1_002 and len(set(wakes[0])) < 60


def test_bucket_shorter_than_a_hold_is_refused(spark):
    d = spark.createDataFrame([("a", 1)], "k string, ts long")
    with pytest.raises(ValueError):
        transitions(d, ["k"], "ts", [F.lit(True)], [5_000], bucket_ms=1_000)
    assert transitions(d.limit(0), ["k"], "ts", [F.lit(True)], [5_000]).collect() == []
    assert transitions(d, ["k"], "ts", [F.lit(None).cast("boolean")], [5_000]).collect() == []
