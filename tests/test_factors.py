"""Factors at their default windows on the synthetic bars, trades and quotes, against direct computations."""

import pytest
from pyspark.sql import functions as F

from tapewright.functions.factor_registry import parse_specs
from tapewright.operators import bar_factors as B, tick_factors as T


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for i in range(50):
        base = 100 + 0.3 * i
        o, c = round(base + 0.02 * (i % 7), 4), round(base + 0.15 + 0.04 * ((i + 3) % 5), 4)
        rows.append(("X", 1_000_000 + 60_000 * i, o, round(max(o, c) + 0.05 + 0.03 * (i % 3), 4), round(min(o, c) - 0.05 - 0.03 * ((i + 1) % 3), 4), c, 1000 + 200 * (i % 10) + 150 * ((i + 5) % 8)))
    return rows


@pytest.fixture(scope="module")
def bar_df(spark, bars):
    return spark.createDataFrame(bars, "ticker string, bar_start long, open double, high double, low double, close double, volume long")


def trades_rows():
    out, ts = [], 1_000_000
    for i in range(200):
        out.append(("X", ts, i, round(100 + 0.01 * i + 0.005 * (i % 20), 4), 100 + 50 * (i % 5)))
        ts += 200 if i % 10 < 3 else 500
    return out


def quote_rows():
    out = []
    for i in range(200):
        mid, h = 100 + 0.005 * i, 0.025 if i % 20 == 0 else 0.005
        big, small = 800 + 100 * (i % 10), 300 + 50 * (i % 7)
        b, a = (big, small) if i % 30 < 15 else (small, big)
        out.append(("X", 1_000_000 + 500 * i, i, mid - h, mid + h, b, a))
    return out


def test_bar_factors(bar_df, bars):
    got = {r["bar_start"]: r for r in B.add_bar_factors(bar_df).collect()}
    ema, a = None, 2 / 21
    for i, (_, t, o, h, l, c, v) in enumerate(bars):
        ema = c if ema is None else a * c + (1 - a) * ema
        r = got[t]
        assert r["price_direction"] == pytest.approx((c - l) / (h - l))
        assert r["ema"] == (pytest.approx(ema) if i >= 19 else None)
        vols = [b[6] for b in bars[max(0, i - 19) : i + 1]]
        assert r["relative_volume"] == (pytest.approx(v / (sum(vols) / 20)) if i >= 19 else None)
        assert r["gap_percent"] == (pytest.approx((o - bars[i - 1][5]) / bars[i - 1][5] * 100) if i else None)
        if i >= 25:
            m = lambda lo, hi: sum(b[6] for b in bars[lo:hi]) / (hi - lo)
            assert r["volume_acceleration"] == pytest.approx((m(i - 5, i) / m(i - 10, i - 5)) / (m(i - 10, i - 5) / m(i - 25, i - 10)))
        else:
            assert r["volume_acceleration"] is None


def test_ema_over_many_blocks(spark):
    rows = [("X", i, float(50 + (i * 7919) % 101)) for i in range(6000)]
    d = spark.createDataFrame(rows, "ticker string, bar_start long, close double")
    got = {r["bar_start"]: r["ema"] for r in B.add_ema(d, 5).collect()}
    ema = None
    for _, i, c in rows:
        ema = c if ema is None else c / 3 + ema * 2 / 3
        if i >= 4:
            assert got[i] == pytest.approx(ema, rel=1e-9)


def test_trade_factors(spark):
    rows = trades_rows()
    t = spark.createDataFrame(rows, "ticker string, ts_ms long, seq long, price double, size long")
    grid = spark.createDataFrame([("X", 1_000_000 + 1000 * i) for i in range(100)], "ticker string, ts_ms long")
    got = {r["ts_ms"]: r for r in T.trade_factors(t, grid).collect()}
    assert len(got) == 100
    buys = {i: 1 if i == 0 or rows[i][3] >= rows[i - 1][3] else 0 for i in range(200)}
    for ts, r in got.items():
        win = [x for x in rows if ts - 20_000 <= x[1] <= ts]
        if len(win) < 5:
            assert r["trade_rate"] is None and r["aggressor_ratio"] is None
            continue
        mean = sum(x[4] for x in win) / len(win)
        assert r["trade_rate"] == pytest.approx(len(win) / 20)
        assert r["large_trade_ratio"] == pytest.approx(sum(x[4] > 2 * mean for x in win) / len(win))
        assert r["aggressor_ratio"] == pytest.approx(sum(buys[x[2]] for x in win) / len(win))


def test_quote_factors(spark):
    rows = quote_rows()
    q = spark.createDataFrame(rows, "ticker string, ts_ms long, seq long, bid double, ask double, bid_size long, ask_size long")
    got = {r["ts_ms"]: r for r in T.quote_factors(q, T.compute_grid(q)).collect()}
    for ts, r in got.items():
        w5 = [x for x in rows if ts - 5_000 <= x[1] <= ts]
        w10 = [x for x in rows if ts - 10_000 <= x[1] <= ts]
        assert r["bid_ask_spread"] == pytest.approx(sum((x[4] - x[3]) / ((x[3] + x[4]) / 2) * 1e4 for x in w5) / len(w5))
        b, a = sum(x[5] for x in w5), sum(x[6] for x in w5)
        assert r["order_imbalance"] == pytest.approx((b - a) / (b + a))
        assert r["quote_rate"] == (pytest.approx(len(w10) / 10) if len(w10) >= 10 else None)


def test_bad_configuration_is_refused():
    for bad in ({"x": {"factor": "nope"}}, {"relative_volume": {"params": {"look": 3}}}, {"relative_volume": {"params": {"lookback": "20"}}}):
        with pytest.raises(ValueError):
            parse_specs(bad)
