"""Ignition detectors, gates and scores over the day candidates; the detectors' minute is half an hour here."""

from pyspark.sql import functions as F

from tapewright.functions.durable import checkpoint
from tapewright.operators import exits as X, gates as G, ignition as I
from tapewright.operators.passage import span_stats
from tapewright.plans.ctes import fragment
from tapewright.plans.q_exits import REPORT_F, entries, path, report_sql, strategy_rows
from tapewright.plans.q_events import event_table
from tapewright.plans.q_ticks import clean
from tapewright.plans.registry import query

M = 1_800_000
HOUR = 3_600_000
DET_F = "price"


def _first_sql(method, rows, ms="ts_ms", px="px"):
    return f"SELECT entry_id, '{method}' AS method, min({ms}) AS ms, arg_min({px}, {ms}) AS price FROM ({rows}) GROUP BY 1"


fragment(
    "ig_vol",
    _first_sql("vol_exp", f"""SELECT * FROM (SELECT *, sum(sz) OVER (PARTITION BY entry_id ORDER BY ts_ms RANGE BETWEEN {M} PRECEDING AND CURRENT ROW) AS v1,
      sum(sz) OVER (PARTITION BY entry_id ORDER BY ts_ms RANGE BETWEEN {6 * M} PRECEDING AND {M + 1} PRECEDING) AS v5 FROM path)
      WHERE ts_ms >= entry_ms + {6 * M} AND v5 >= 100 AND v1 / (v5 / 5.0) > 3"""),
)
fragment(
    "ig_range",
    _first_sql("range_breakout", f"""SELECT * FROM (SELECT *, max(px) OVER (PARTITION BY entry_id ORDER BY ts_ms RANGE BETWEEN {10 * M} PRECEDING AND 1 PRECEDING) AS m FROM path)
      WHERE ts_ms >= entry_ms + {10 * M} AND px > m"""),
)
fragment(
    "minute_grid",
    f"""SELECT entry_id, entry_ms, i AS minute, n_min AS minutes, count(p_ts) AS n, arg_min(px, p_ts) AS first_px FROM (
      SELECT e.entry_id, e.entry_ms, i, n_min, p.ts_ms AS p_ts, p.px FROM (SELECT *, unnest(range(n_min)) AS i FROM (
        SELECT *, CAST(ceil((session_end_ms - entry_ms) / {M}) AS BIGINT) AS n_min FROM entries WHERE session_end_ms > entry_ms)) e
      LEFT JOIN path p ON p.entry_id = e.entry_id AND p.ts_ms >= e.entry_ms + i * {M} AND p.ts_ms < e.entry_ms + (i + 1) * {M}) GROUP BY 1, 2, 3, 4""",
)
fragment(
    "ig_surge",
    _first_sql("trade_rate_surge", """SELECT * FROM (SELECT *, avg(n) OVER w AS mean, stddev_pop(n) OVER w AS sd FROM minute_grid
      WINDOW w AS (PARTITION BY entry_id ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE minute >= 20 AND sd > 0 AND n > mean + 3 * sd""", f"entry_ms + minute * {M}", "first_px"),
)
fragment(
    "ig_sustained",
    _first_sql("sustained_activity", """SELECT * FROM (SELECT *, lead(n) OVER (PARTITION BY entry_id ORDER BY minute) AS n1, lead(n, 2) OVER (PARTITION BY entry_id ORDER BY minute) AS n2 FROM minute_grid)
      WHERE n >= 3 AND n1 >= 3 AND n2 >= 3""", f"entry_ms + minute * {M}", "first_px"),
)
fragment(
    "ig_spread",
    _first_sql("spread_collapse", """SELECT e.entry_id, q.ts_ms, (bid + ask) / 2 AS px FROM entries e JOIN quotes q ON q.ticker = e.ticker AND q.ts_ms > entry_ms AND q.ts_ms <= session_end_ms
      WHERE bid > 0 AND ask > bid AND (ask - bid) / ((bid + ask) / 2) * 10000 < 40"""),
)
fragment("ig_all", " UNION ALL ".join(f"SELECT * FROM {n}" for n in ("ig_vol", "ig_range", "ig_surge", "ig_sustained", "ig_spread")))

for _id, _frag, _fn in (
    ("G1_volume_expansion", "ig_vol", lambda t: I.volume_expansion(path(t), minute_ms=M)),
    ("G2_range_breakout", "ig_range", lambda t: I.range_breakout(path(t), M)),
    ("G3_trade_rate_surge", "ig_surge", lambda t: I.trade_rate_surge(path(t), minute_ms=M)),
    ("G4_sustained_activity", "ig_sustained", lambda t: I.sustained_activity(path(t), minute_ms=M)),
    ("G5_spread_collapse", "ig_spread", lambda t: I.spread_collapse(entries(t), t.quotes(), 40.0)),
    ("G6_all_detectors", "ig_all", lambda t: I.detect_all(path(t), entries(t), t.quotes(), M, 40.0)),
):
    query(_id, f"SELECT * FROM {_frag}", DET_F)(_fn)


fragment(
    "intensity",
    f"""SELECT entry_id, ticker, entry_ms, entry_price, count(*) FILTER (early) AS n_trades_first_5min, count(*) AS n_fwd_trades,
      coalesce(max(gap), (any_value(session_end_ms) - entry_ms) / 1000) AS max_gap_sec, coalesce(median(gap), (any_value(session_end_ms) - entry_ms) / 1000) AS median_gap_sec,
      coalesce(stddev_pop(gap) / greatest(avg(gap), 0.001), 0) AS gap_cv, coalesce(sum(px * sz) FILTER (early), 0) AS dollar_vol_5min,
      count(*) FILTER (b = 0) >= 3 AND count(*) FILTER (b = 1) >= 3 AND count(*) FILTER (b = 2) >= 3 AS sustained_activity,
      CASE WHEN count(*) >= 5 THEN avg(px) FILTER (sz >= q75) - entry_price ELSE 0 END AS big_trade_delta,
      CASE WHEN count(*) FILTER (early) >= 2 THEN (max(px) FILTER (early) - min(px) FILTER (early)) / entry_price * 100 ELSE 0 END AS price_range_5min_pct,
      coalesce(avg(CASE WHEN prev IS NOT NULL THEN CASE WHEN px >= prev THEN 1.0 ELSE 0 END END), 0) AS uptick_frac,
      CASE WHEN count(*) FILTER (b < 5) > 0 THEN (2 * count(*) FILTER (b = 4) + count(*) FILTER (b = 3) - count(*) FILTER (b = 1) - 2 * count(*) FILTER (b = 0)) / 10.0 ELSE 0 END AS accel_slope,
      CASE WHEN count(*) FILTER (b < 5) > 0 THEN count(*) FILTER (b IN (3, 4)) / greatest(count(*) FILTER (b IN (0, 1)), 1) ELSE 0 END AS last2_first2_ratio,
      (max(px) - entry_price) / entry_price * 100 AS entry_to_peak_pct
    FROM (SELECT *, (ts_ms - lag(ts_ms) OVER w) / 1000 AS gap, lag(px) OVER w AS prev, quantile_cont(sz, 0.75) OVER (PARTITION BY entry_id) AS q75,
      ts_ms <= entry_ms + {5 * M} AS early, (ts_ms - entry_ms) // {M} AS b FROM path WINDOW w AS (PARTITION BY entry_id ORDER BY step)) GROUP BY 1, 2, 3, 4""",
)
INT_F = "entry_price max_gap_sec median_gap_sec gap_cv dollar_vol_5min big_trade_delta price_range_5min_pct uptick_frac accel_slope last2_first2_ratio entry_to_peak_pct"


@query("G7_trade_intensity", "SELECT * FROM intensity", INT_F)
def _(t):
    return I.trade_intensity(path(t), M)


SNAP_NAMES = ["trade_rate", "aggressor_ratio", "bid_ask_spread", "price_direction", "gap_percent"]


def _snap_sql(points, ts, key="entry_id"):
    """Last non-null value within 12 hourly steps of the factor row at or before the point."""
    cols = ", ".join(f"arg_max(f.{n}, f.ts_ms) FILTER (f.{n} IS NOT NULL AND f.ts_ms >= g.at - {12 * HOUR}) AS {n}" for n in SNAP_NAMES)
    return f"""SELECT g.{key}, {cols} FROM (SELECT p.{key}, p.ticker, max(e.ts_ms) AS at FROM {points} p LEFT JOIN event_table e ON e.ticker = p.ticker AND e.ts_ms <= p.{ts} GROUP BY 1, 2) g
      LEFT JOIN event_table f ON f.ticker = g.ticker AND f.ts_ms <= g.at GROUP BY 1"""


fragment("entry_snap", _snap_sql("entries", "entry_ms"))


def entry_snapshot(t, names=SNAP_NAMES):
    return I.factor_snapshot(event_table(t), entries(t), list(names), "entry_ms", HOUR, 12)


@query("G11_entry_factor_snapshot", "SELECT * FROM entry_snap", " ".join(SNAP_NAMES))
def _(t):
    return entry_snapshot(t).select("entry_id", *SNAP_NAMES)


fragment("hit_snap", _snap_sql("labels5", "hit_ms"))


@query("G12_snapshot_at_five_percent", "SELECT entry_id, label, " + ", ".join(SNAP_NAMES) + " FROM hit_snap JOIN labels5 USING (entry_id)", " ".join(SNAP_NAMES))
def _(t):
    pts = X.continuation_labels(entries(t), clean(t))
    return I.factor_snapshot(event_table(t), pts, SNAP_NAMES, "hit_ms", HOUR, 12).select("entry_id", "label", *SNAP_NAMES)


GATES = (
    lambda: (
        G.data_quality_gate(1.0, 60.0, 3),
        G.static_gate(blocked_countries=("CHINA", "INDIA"), min_price=30.2, max_price=50.0),
        G.event_pattern_gate((0.0, 0.9), (-30.0, 60.0)),
        G.liquidity_gate(2, 1000.0, 20_000.0),
        G.momentum_gate(-8.0, 5.0, 0.3, -1.0),
    )
)
GATE_SQL = {
    "data_quality": [("trade_rate IS NULL", "trade_rate not computable"), ("trade_rate < 1.0", "trade_rate < 1.0"), ("bid_ask_spread > 60.0", "spread > 60.0bps"), ("n_fwd_trades < 3", "fwd_trades < 3")],
    "static": [("country IN ('CHINA', 'INDIA')", "country is blocked"), ("entry_price < 30.2", "price < 30.2"), ("entry_price > 50.0", "price > 50.0")],
    "event_pattern": [("price_direction IS NULL", "price_direction not available"), ("NOT price_direction BETWEEN 0.0 AND 0.9", "price_direction not in [0.0, 0.9]"),
                      ("gap_percent IS NULL", "gap_percent not available"), ("NOT gap_percent BETWEEN -30.0 AND 60.0", "gap_percent not in [-30.0, 60.0]")],
    "liquidity": [("n_trades_first_5min < 2", "trades_5min < 2"), ("dollar_vol_5min < 1000.0", "dollar_vol < 1000.0"), ("max_gap_sec > 20000.0", "max_gap > 20000.0")],
    "momentum": [("big_trade_delta < -8.0", "big_trade_delta < -8.0"), ("price_range_5min_pct < 5.0", "price_range < 5.0"), ("uptick_frac < 0.3", "uptick_frac < 0.3"), ("accel_slope < -1.0", "accel < -1.0")],
}
_REASON = {g: "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in checks) + " END" for g, checks in GATE_SQL.items()}
# Candidates carry a profile by the user who made the entry trade.
fragment(
    "contexts",
    """SELECT i.*, e.date, e.gain_at_entry, s.* EXCLUDE (entry_id), p.country, p.sector, p.float_shares, p.market_cap FROM intensity i JOIN entries e ON e.entry_id = i.entry_id
    JOIN entry_snap s ON s.entry_id = i.entry_id LEFT JOIN (SELECT c.ticker, c.ts_ms, min(w.ticker) AS wide FROM clean c JOIN wide_clean w ON w.seq = c.seq GROUP BY 1, 2) u ON u.ticker = i.ticker AND u.ts_ms = i.entry_ms
    LEFT JOIN profiles p ON p.ticker = u.wide""",
)


def contexts(t):
    """Candidate table: path features, factor snapshot at entry, profile."""
    snap = entry_snapshot(t).select("entry_id", "date", "gain_at_entry", *SNAP_NAMES)
    users = t.read("events").select(F.col("event_type").alias("ticker"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("entry_ms"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("_wide"))
    feats = checkpoint(I.trade_intensity(path(t), M))  # one row a candidate, used twice
    users = users.join(feats.select("ticker", "entry_ms"), ["ticker", "entry_ms"], "left_semi").groupBy("ticker", "entry_ms").agg(F.min("_wide").alias("_wide"))
    prof = t.profiles().select(F.col("ticker").alias("_wide"), "country", "sector", "float_shares", "market_cap")
    return feats.join(snap, "entry_id").join(users, ["ticker", "entry_ms"], "left").join(prof, "_wide", "left").drop("_wide")


fragment(
    "gated",
    "SELECT *, CASE " + " ".join(f"WHEN {r} IS NOT NULL THEN '{g}'" for g, r in _REASON.items()) + " END AS reject_layer, coalesce("
    + ", ".join(_REASON.values()) + ") AS reject_reason, CAST(" + " + ".join(f"CASE WHEN {r} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, r in enumerate(_REASON.values())) + " AS INTEGER) AS fail_mask FROM contexts",
)
fragment("tp5", strategy_rows((X.Strategy(tp=5.0),)))


def gated(t):
    # One row a candidate, written once: gates, funnel and reports all start from it.
    return G.apply_gates(checkpoint(contexts(t)), GATES())


def tp5(t, strategies=(X.Strategy(tp=5.0),)):
    return X.simulate_entries(entries(t), clean(t), strategies)


@query("G8_gates", "SELECT entry_id, reject_layer, reject_reason, fail_mask FROM gated")
def _(t):
    return gated(t).select("entry_id", "reject_layer", "reject_reason", "fail_mask")


@query(
    "G8_trade_intensity_gate",
    """SELECT entry_id, CASE WHEN r IS NOT NULL THEN 'trade_intensity' END AS reject_layer, r AS reject_reason FROM (
      SELECT entry_id, CASE WHEN n_trades_first_5min < 2 THEN 'trades_5min < 2' WHEN max_gap_sec > 20000.0 THEN 'max_gap > 20000.0' END AS r FROM intensity)""",
)
def _(t):
    g = G.apply_gates(I.trade_intensity(path(t), M), (G.trade_intensity_gate(2, 20_000.0),))
    return g.select("entry_id", "reject_layer", "reject_reason")


fragment("gate_index", "SELECT CASE reject_layer " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GATE_SQL)) + f" ELSE {len(GATE_SQL)} END AS f FROM gated")


@query(
    "G9_gate_funnel",
    " UNION ALL ".join(
        f"SELECT '{g}' AS gate, {i} AS gate_order, count(*) FILTER (f >= {i}) AS n_input, count(*) FILTER (f > {i}) AS n_passed, count(*) FILTER (f = {i}) AS n_rejected FROM gate_index"
        for i, g in enumerate(GATE_SQL)
    ),
)
def _(t):
    return G.gate_funnel(gated(t), GATES())


@query("G9_reject_reasons", "SELECT reject_layer, reject_reason, count(*) AS n FROM gated WHERE reject_layer IS NOT NULL GROUP BY 1, 2")
def _(t):
    return G.reject_reasons(gated(t))


@query(
    "G9_gate_report",
    """SELECT *, survivor_expectancy - baseline_expectancy AS expectancy_delta, survivor_momo / greatest(baseline_momo, 1) AS momo_retention FROM (
    SELECT count(*) AS n_input, count(*) FILTER (live) AS n_survivors, count(pnl_pct) AS n_traded_baseline, count(pnl_pct) FILTER (live) AS n_traded_survivor,
      avg(pnl_pct) AS baseline_expectancy, avg(pnl_pct) FILTER (live) AS survivor_expectancy, avg(CASE WHEN pnl_pct > 0 THEN 1.0 WHEN pnl_pct IS NOT NULL THEN 0 END) AS baseline_win_rate,
      avg(CASE WHEN pnl_pct > 0 THEN 1.0 WHEN pnl_pct IS NOT NULL THEN 0 END) FILTER (live) AS survivor_win_rate, median(entry_to_peak_pct) AS baseline_median_peak,
      median(entry_to_peak_pct) FILTER (live) AS survivor_median_peak, count(*) FILTER (entry_to_peak_pct >= 20) AS baseline_momo, count(*) FILTER (live AND entry_to_peak_pct >= 20) AS survivor_momo
    FROM (SELECT g.*, reject_layer IS NULL AS live, pnl_pct FROM gated g LEFT JOIN tp5 USING (entry_id)))""",
    "baseline_expectancy survivor_expectancy baseline_win_rate survivor_win_rate baseline_median_peak survivor_median_peak expectancy_delta momo_retention",
)
def _(t):
    return G.gate_report(gated(t), tp5(t), 20.0)


@query(
    "G10_gate_subsets",
    f"""SELECT CAST(s AS INTEGER) AS subset, count(*) AS n_survivors, count(pnl_pct) AS n_traded, count(*) FILTER (entry_to_peak_pct >= 20) AS survivor_momo, avg(pnl_pct) AS expectancy_pct,
      avg(CASE WHEN pnl_pct > 0 THEN 1.0 WHEN pnl_pct IS NOT NULL THEN 0 END) AS win_rate,
      concat_ws('+', {', '.join(f"CASE WHEN s & {1 << i} <> 0 THEN '{g}' END" for i, g in enumerate(GATE_SQL))}) AS gates
    FROM gated LEFT JOIN tp5 USING (entry_id), (SELECT unnest(range({2 ** len(GATE_SQL)})) AS s) WHERE fail_mask & s = 0 GROUP BY s""",
    "expectancy_pct win_rate",
)
def _(t):
    return G.gate_subsets(gated(t), tp5(t), GATES(), 20.0)


_CT = "CASE WHEN country IS NULL OR country IN ('CHINA', 'INDIA') THEN 0 ELSE 1 END"
_PR = "exp(-0.5 * ((entry_price - 8.0) / 7.0) * ((entry_price - 8.0) / 7.0))"
_FL = "1 / (1 + exp((float_shares / 1000000 - 20.0) / 8.0))"
fragment(
    "scored",
    f"""SELECT *, (score_trade_rate + score_spread + score_price + score_float + score_country) / 5 AS score_composite, (score_price_v2 + score_float_v2 + score_country) / 3 AS score_composite_v2 FROM (
      SELECT *, coalesce(least(trade_rate / 15, 1), 0) AS score_trade_rate, coalesce(greatest(0, 1 - bid_ask_spread / 200), 0) AS score_spread, {_PR} AS score_price,
        coalesce({_FL}, 0) AS score_float, {_CT} AS score_country, 1 - {_PR} AS score_price_v2, coalesce(1 - {_FL}, 0) AS score_float_v2 FROM contexts)""",
)
S1 = ["score_trade_rate", "score_spread", "score_price", "score_float", "score_country", "score_composite"]
BLOCKED = ("CHINA", "INDIA")


def scored(t):
    return G.tradability_score(contexts(t), blocked=BLOCKED)


@query("G13_tradability_score", f"SELECT entry_id, {', '.join(S1)} FROM scored", " ".join(S1))
def _(t):
    return scored(t).select("entry_id", *S1)


@query("G14_tradability_score_v2", "SELECT entry_id, score_price_v2, score_float_v2, score_composite_v2 FROM scored", "score_price_v2 score_float_v2 score_composite_v2")
def _(t):
    return G.tradability_score_v2(contexts(t), BLOCKED).select("entry_id", "score_price_v2", "score_float_v2", "score_composite_v2")


BASE2 = (X.Strategy(), X.Strategy(tp=5.0))
fragment("sim_base2", strategy_rows(BASE2))
fragment(
    "tercile_rows",
    "SELECT entry_id, dim, CASE WHEN r <= k THEN 'Low' WHEN r <= 2 * k THEN 'Med' ELSE 'High' END AS tercile FROM (SELECT *, row_number() OVER (PARTITION BY date, dim ORDER BY round(score, 9), entry_id) AS r, count(*) OVER (PARTITION BY date, dim) // 3 AS k FROM ("
    + " UNION ALL ".join(f"SELECT entry_id, date, '{d}' AS dim, {d} AS score FROM scored" for d in S1[:5]) + ")) WHERE k >= 1",
)


@query("G15_terciles", report_sql("SELECT t.dim, t.tercile, b.* FROM tercile_rows t JOIN sim_base2 b USING (entry_id)", "dim, tercile, strategy"), REPORT_F)
def _(t):
    s = scored(t)
    s = s.select("entry_id", "date", *[F.round(c, 9).alias(c) for c in S1[:5]])
    return G.tercile_report(G.terciles(s, S1[:5]), tp5(t, BASE2))


TH = (0.0, 0.10, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)


@query(
    "G15_threshold_sweep",
    f"""SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (on_) AS n, avg(pnl_pct) FILTER (on_) AS expectancy_pct, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END) FILTER (on_) AS win_rate, avg(mfe_pct) FILTER (on_) AS mean_mfe
    FROM (SELECT th, round(score_composite, 9) >= th AS on_, pnl_pct, mfe_pct FROM scored JOIN tp5 USING (entry_id), (VALUES {', '.join(f'({x}::DOUBLE)' for x in TH)}) v(th)) GROUP BY 1""",
    "threshold expectancy_pct win_rate mean_mfe",
)
def _(t):
    s = scored(t).withColumn("score_composite", F.round("score_composite", 9))
    return G.threshold_sweep(s, tp5(t), "score_composite", TH)


@query(
    "G16_tradable_split",
    report_sql("SELECT CASE WHEN trade_rate IS NOT NULL THEN 'TRADABLE' ELSE 'ZOMBIE' END AS split, b.* FROM entry_snap JOIN sim_base2 b USING (entry_id) UNION ALL SELECT 'ALL', b.* FROM sim_base2 b", "split, strategy"),
    REPORT_F,
)
def _(t):
    return G.tradable_split(entry_snapshot(t, ["trade_rate"]), tp5(t, BASE2))


@query(
    "G18_false_negative_audit",
    """SELECT *, rejection_reasons <> '' AS would_reject, is_momo AND rejection_reasons <> '' AS is_false_negative FROM (SELECT entry_id, entry_to_peak_pct, entry_to_peak_pct >= 20 AS is_momo,
      concat_ws(',', CASE WHEN score_trade_rate < 0.05 THEN 'trade_rate' END, CASE WHEN score_spread < 0.05 THEN 'spread' END, CASE WHEN score_country < 0.5 THEN 'country' END) AS rejection_reasons FROM scored)""",
    "entry_to_peak_pct",
)
def _(t):
    a = G.false_negative_audit(scored(t), 20.0)
    return a.select("entry_id", "entry_to_peak_pct", "is_momo", "rejection_reasons", "would_reject", "is_false_negative")


fragment(
    "window_stats_sql",
    f"""SELECT e.entry_id, coalesce(trade_count, 0) AS trade_count, coalesce(dollar_vol, 0) AS dollar_vol, coalesce(max_gap_sec, 0) AS max_gap_sec, coalesce(price_range_pct, 0) AS price_range_pct, coalesce(big_trade_delta, 0) AS big_trade_delta
    FROM entries e LEFT JOIN (
      SELECT entry_id, count(*) AS trade_count, sum(px * sz) AS dollar_vol, max(gap) AS max_gap_sec, (max(px) / min(px) - 1) * 100 AS price_range_pct,
        coalesce(median((px / p0 - 1) * 100) FILTER (sz > avg_sz), median((px / p0 - 1) * 100)) AS big_trade_delta FROM (
        SELECT *, (ts_ms - lag(ts_ms) OVER w) / 1000 AS gap, first_value(px) OVER w AS p0, avg(sz) OVER (PARTITION BY entry_id) AS avg_sz FROM (
          SELECT e.entry_id, c.ts_ms, c.seq, c.price AS px, c.size AS sz FROM entries e JOIN clean c ON c.ticker = e.ticker AND c.ts_ms > entry_ms - {5 * M} AND c.ts_ms <= entry_ms + {10 * M})
        WINDOW w AS (PARTITION BY entry_id ORDER BY ts_ms, seq)) GROUP BY 1) s USING (entry_id)""",
)


@query("G19_window_stats", "SELECT * FROM window_stats_sql", "dollar_vol max_gap_sec price_range_pct big_trade_delta")
def _(t):
    e = entries(t).withColumn("anchor_ms", F.col("entry_ms"))
    return I.window_stats(e, clean(t), before_ms=5 * M, after_ms=10 * M)


fragment(
    "ignited",
    f"""SELECT i.entry_id, arg_min(method, CASE method WHEN 'spread_collapse' THEN 0 ELSE 1 END) AS ignition_method, arg_min(ms, CASE method WHEN 'spread_collapse' THEN 0 ELSE 1 END) AS ignition_ms,
      arg_min(price, CASE method WHEN 'spread_collapse' THEN 0 ELSE 1 END) AS ignition_price FROM ig_all i JOIN entries e USING (entry_id)
    WHERE method IN ('spread_collapse', 'vol_exp') AND ms <= entry_ms + {8 * M} GROUP BY 1""",
)


@query(
    "X12_two_anchor",
    f"""SELECT e.entry_id, e.ticker, e.entry_ms, ignition_ms IS NOT NULL AS ignited, ignition_method, ignition_ms, coalesce((peak / entry_price - 1) * 100, 0) AS entry_to_peak_pct,
      coalesce((peak / entry_price - 1) * 100, 0) >= 50 AS is_momo,
      CASE WHEN ignition_ms IS NOT NULL THEN coalesce((ig_last / ignition_price - 1) * 100, 0) ELSE (coalesce(z, entry_price) / entry_price - 1) * 100 END AS final_pnl_pct,
      CASE WHEN ignition_ms IS NOT NULL THEN 'ignited_' || ignition_method ELSE 'zombie_timeout' END AS exit_reason,
      CASE WHEN ignition_ms IS NOT NULL THEN coalesce((ig_peak / ignition_price - 1) * 100, 0) ELSE 0 END AS ignition_to_peak_pct, coalesce(n5, 0) AS ig_trades_5min, coalesce(d5, 0) AS ig_dollar_vol_5min
    FROM entries e LEFT JOIN ignited USING (entry_id) LEFT JOIN (
      SELECT p.entry_id, max(px) AS peak, arg_max(px, step) FILTER (ts_ms > ignition_ms) AS ig_last, max(px) FILTER (ts_ms > ignition_ms) AS ig_peak, arg_max(px, step) FILTER (ts_ms <= entry_ms + {8 * M}) AS z
      FROM path p LEFT JOIN ignited i ON i.entry_id = p.entry_id GROUP BY 1) g USING (entry_id) LEFT JOIN (
      SELECT i.entry_id, count(*) AS n5, sum(c.price * c.size) AS d5 FROM ignited i JOIN entries x ON x.entry_id = i.entry_id JOIN clean c ON c.ticker = x.ticker AND c.ts_ms > ignition_ms AND c.ts_ms <= ignition_ms + {5 * M} GROUP BY 1) f USING (entry_id)""",
    "entry_to_peak_pct final_pnl_pct ignition_to_peak_pct ig_dollar_vol_5min",
)
def _(t):
    e = entries(t)
    hits = I.volume_expansion(path(t), minute_ms=M).unionByName(I.spread_collapse(e, t.quotes(), 40.0))
    return I.two_anchor(e, hits, clean(t), 8 * M, M)


@query(
    "G17_ticker_profiles",
    f"""SELECT c.entry_id, c.date, c.country, c.sector, c.float_shares, c.n_fwd_trades, c.max_gap_sec, c.entry_to_peak_pct, x.mae_pct, x.close_pct, p1, p4,
      {', '.join(f"max(i.ms) FILTER (i.method = '{m}') - c.entry_ms AS {m}_delay_ms" for m in I.METHODS)}
    FROM contexts c JOIN excursions x ON x.entry_id = c.entry_id LEFT JOIN ig_all i ON i.entry_id = c.entry_id
    JOIN (SELECT entry_id, max((px / entry_price - 1) * 100) FILTER (ts_ms <= entry_ms + {2 * M}) AS p1, max((px / entry_price - 1) * 100) FILTER (ts_ms <= entry_ms + {8 * M}) AS p4 FROM path GROUP BY 1) w ON w.entry_id = c.entry_id
    GROUP BY c.entry_id, c.date, c.country, c.sector, c.float_shares, c.n_fwd_trades, c.max_gap_sec, c.entry_to_peak_pct, x.mae_pct, x.close_pct, p1, p4, c.entry_ms""",
    "float_shares max_gap_sec entry_to_peak_pct mae_pct close_pct p1 p4",
)
def _(t):
    e, tr = entries(t), clean(t)
    hits = I.ignition_table(I.detect_all(path(t), e, t.quotes(), M, 40.0))
    c = contexts(t).join(X.excursions(e, tr).select("entry_id", "mae_pct", "close_pct"), "entry_id").join(hits, "entry_id", "left")
    for k in (1, 4):
        early = span_stats(e.withColumn("session_end_ms", F.least("session_end_ms", F.col("entry_ms") + k * 2 * M)), tr)
        c = c.join(early.select("entry_id", F.col("hi").alias(f"_hi{k}")), "entry_id", "left").withColumn(f"p{k}", (F.col(f"_hi{k}") - F.col("entry_price")) / F.col("entry_price") * 100)
    return c.select(
        "entry_id", "date", "country", "sector", "float_shares", "n_fwd_trades", "max_gap_sec", "entry_to_peak_pct", "mae_pct", "close_pct", "p1", "p4",
        *[(F.col(f"{m}_ms") - F.col("entry_ms")).alias(f"{m}_delay_ms") for m in I.METHODS],
    )
