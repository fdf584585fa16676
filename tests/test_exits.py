"""Scaled exits with trailing stops, first-hit exits and folds against plain walks over random price paths."""

import random

import pytest

from tapewright.functions.folds import thin_by_interval
from tapewright.operators import exits as X
from tapewright.operators.events import activity_states


def make_paths(n=60, seed=11):
    rnd = random.Random(seed)
    out = {}
    for e in range(n):
        px, path = 20.0, []
        for i in range(rnd.randrange(1, 60)):
            px = max(1.0, px * (1 + rnd.uniform(-0.06, 0.065)))
            path.append((1_000_000 + 60_000 * (i + 1), round(px, 3)))
        out[f"e{e}"] = path
    return out


@pytest.fixture(scope="module")
def paths(spark):
    p = make_paths()
    rows = [(e, "T" + e, ts, i, px, 1) for e, path in p.items() for i, (ts, px) in enumerate(path)]
    trades = spark.createDataFrame([(t, ts, s, px, z) for _, t, ts, s, px, z in rows], "ticker string, ts_ms long, seq long, price double, size long")
    entries = spark.createDataFrame([(e, "T" + e, 1_000_000, 20.0, 99_000_000) for e in p], "entry_id string, ticker string, entry_ms long, entry_price double, session_end_ms long")
    return p, X.price_path(entries, trades).cache()


def walk(path, c, entry=20.0, t0=1_000_000):
    """Weights per reason, total return and extremes of one path."""
    left, total, w = 1.0, 0.0, dict(tp=0.0, sl=0.0, tr=0.0, tm=0.0, cl=0.0)
    hi = lo = entry
    done, peak = set(), None
    for ts, px in path:
        g = (px - entry) / entry * 100
        hi, lo = max(hi, px), min(lo, px)
        reason = None
        if g <= -c.stop_loss:
            reason = "sl"
        elif peak is not None and c.trail > 0:
            peak = max(peak, px)
            if g <= (peak - entry) / entry * 100 - c.trail:
                reason = "tr"
        if reason is None:
            for at, share in c.steps:
                if at not in done and g >= at and left > 0:
                    s = min(share, left)
                    total, left = total + g * s, left - s
                    w["tp"] += s
                    done.add(at)
                    if c.trail_trigger > 0 and g >= c.trail_trigger and peak is None:
                        peak = px
            if c.max_hold_min and (ts - t0) / 60_000 >= c.max_hold_min and left > 1e-12:
                reason = "tm"
        if reason:
            total, w[reason], left = total + g * left, left, 0.0
            return total, w, hi, lo
    g = (path[-1][1] - entry) / entry * 100
    w["cl"] = left
    return total + g * left, w, hi, lo


CONFIGS = [
    X.SCALE_FAST, X.TP10_SL15, X.simple_hold(20), X.PartialExits("trail", ((5.0, 0.5), (10.0, 0.3)), 8.0, 5.0, 3.0),
    X.PartialExits("all", ((4.0, 0.4), (8.0, 0.2)), 6.0, 8.0, 2.5, 30), X.PartialExits("hold_only", ((50.0, 0.5),), 90.0, max_hold_min=5),
]


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: c.name)
def test_partial_exits(paths, config):
    plain, path = paths
    got = {r["entry_id"]: r for r in X.partial_exits(path, config).collect()}
    assert set(got) == set(plain)
    for e, p in plain.items():
        total, w, hi, lo = walk(p, config)
        r = got[e]
        assert r["return_pct"] == pytest.approx(total, abs=1e-9), e
        assert (r["take_profit_share"], r["stop_loss_share"], r["trailing_share"], r["time_share"], r["close_share"]) == pytest.approx((w["tp"], w["sl"], w["tr"], w["tm"], w["cl"]), abs=1e-9), e
        assert (r["max_price"], r["min_price"]) == pytest.approx((hi, lo)), e


def first_hit(path, s, entry=20.0, t0=1_000_000):
    peak = entry
    for ts, px in path:
        peak = max(peak, px)
        if s.sl is not None and px <= entry * (1 - s.sl / 100):
            return "stop_loss", px
        if s.tp is not None and px >= entry * (1 + s.tp / 100):
            return "take_profit", px
        if s.trail is not None and px <= peak * (1 - s.trail / 100):
            return "trailing_stop", px
        if s.time_min is not None and ts >= t0 + s.time_min * 60_000:
            return "time_stop", px
    return "session_end", path[-1][1]


def test_first_hit_sweep(paths):
    plain, path = paths
    rows = X.simulate(path, X.SWEEP).collect()
    assert len(rows) == len(plain) * len(X.SWEEP) == len(plain) * 18
    named = {s.name: s for s in X.SWEEP}
    for r in rows:
        reason, px = first_hit(plain[r["entry_id"]], named[r["strategy"]])
        assert (r["exit_reason"], r["exit_price"]) == (reason, px)


def test_thinning_and_states(spark):
    rnd = random.Random(5)
    rows = sorted((k, rnd.randrange(0, 500_000), rnd.uniform(0, 10), rnd.uniform(-1, 1)) for k in ("hot",) * 400 + ("b",) * 50)
    d = spark.createDataFrame(rows, "ticker string, ts_ms long, z double, accel double")
    want, last = [], {}
    for k, ts, *_ in rows:
        if k not in last or ts - last[k] >= 7_000:
            want.append((k, ts))
            last[k] = ts
    got = thin_by_interval(d.select("ticker", "ts_ms"), ["ticker"], "ts_ms", 7_000).collect()
    assert sorted((r["ticker"], r["ts_ms"]) for r in got) == sorted(want)
    state, since, moves = {}, {}, []
    for k, ts, z, a in rows:
        on = z > 5 and a > 0
        if state.get(k, "QUIET") == "QUIET" and on:
            state[k], since[k] = "ACTIVE", ts
            moves.append((k, ts, "ACTIVE"))
        elif state.get(k) == "ACTIVE" and not on and ts - since[k] >= 10_000:
            state[k], since[k] = "QUIET", ts
            moves.append((k, ts, "QUIET"))
    assert sorted((r["ticker"], r["ts_ms"], r["state"]) for r in activity_states(d).collect()) == sorted(moves)
