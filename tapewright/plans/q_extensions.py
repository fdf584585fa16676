"""The extension surfaces: registered factors, factor configurations, custom gates."""

from pyspark.sql import Window, functions as F

from tapewright.functions.factor_registry import add_factors, bar_factor, parse_specs
from tapewright.functions.numeric import ratio
from tapewright.operators import gates as G, tick_contract as TC
from tapewright.operators.tick_factors import compute_grid
from tapewright.operators.ticks import valid_quote
from tapewright.plans.ctes import fragment
from tapewright.plans.q_bars import hour_bars
from tapewright.plans.q_gates import contexts
from tapewright.plans.q_streaming import CUT
from tapewright.plans.q_ticks import GRID, RATE_WIN, SPREAD_WIN, WIN, clean
from tapewright.plans.registry import query
from tapewright.sources.lake import work_dir
from tapewright.streaming.factors import live_tick_factors
from tapewright.streaming.run import append_files, in_stages

_W = "OVER (PARTITION BY ticker ORDER BY bar_start"


@bar_factor("range_position")
def range_position(w: Window, lookback: int = 10):
    """Close within the high-low range of the last bars, as an example of a user's own factor."""
    f = w.rowsBetween(-(lookback - 1), 0)
    hi, lo = F.max("high").over(f), F.min("low").over(f)
    return F.when(hi > lo, (F.col("close") - lo) / (hi - lo))


@query(
    "U1_custom_bar_factor",
    f"""SELECT ticker, bar_start, CASE WHEN max(high) {_W} ROWS 7 PRECEDING) > min(low) {_W} ROWS 7 PRECEDING) THEN (close - min(low) {_W} ROWS 7 PRECEDING)) / (max(high) {_W} ROWS 7 PRECEDING) - min(low) {_W} ROWS 7 PRECEDING)) END AS position FROM bars""",
    "position",
)
def _(t):
    specs = parse_specs({"position": {"factor": "range_position", "params": {"lookback": 8}}})
    return add_factors(hour_bars(t), specs, "1h").select("ticker", "bar_start", "position")


@TC.tick_factor("signed_flow")
def signed_flow(window_ms: int = 20_000, min_dollars: float = 0.0):
    """Dollars bought less dollars sold as a share of all, as an example of a user's own trade factor."""
    dollars = F.col("price") * F.col("size")
    share = lambda w: F.when(w["all"] > min_dollars, (2 * w["bought"] - w["all"]) / w["all"])
    return TC.TickFactor(window_ms, share, {"all": dollars}, {"bought": dollars})


@TC.tick_factor("size_skew")
def size_skew(window_ms: int = 5_000):
    """Mean bid size over mean ask size of valid quotes, as an example of a user's own quote factor."""
    ok = valid_quote()
    return TC.TickFactor(window_ms, lambda w: ratio(w["bid"], w["ask"]), {"bid": F.when(ok, F.col("bid_size")), "ask": F.when(ok, F.col("ask_size"))}, source="quote")


TRADE_CONFIG = {
    "flow_6h": {"factor": "signed_flow", "params": {"window_ms": WIN}},
    "rate_2h": {"factor": "trade_rate", "params": {"window_ms": SPREAD_WIN, "min_trades": 3}},
    "large_6h": {"factor": "large_trade_ratio", "params": {"window_ms": WIN}},
    "buyers_6h": {"factor": "aggressor_ratio", "params": {"window_ms": WIN}},
}
_R = "(PARTITION BY ticker ORDER BY ts_ms RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
fragment(
    "arrival_trades",
    f"""SELECT * FROM (
      WITH RECURSIVE f AS (SELECT ticker, ts_ms, sum(price * size) OVER w AS dollars, sum(price * size * is_buy) OVER w AS bought, count(*) OVER w AS n, sum(is_buy) OVER w AS buys,
          count(*) OVER {_R.format(SPREAD_WIN)} AS n2, list(size) OVER w AS sizes, avg(size) OVER w AS mean_size FROM sided WINDOW w AS {_R.format(WIN)}),
        chain AS (SELECT ticker, min(ts_ms) AS ts_ms FROM f GROUP BY 1
          UNION ALL SELECT c.ticker, min(f.ts_ms) FROM chain c JOIN f ON f.ticker = c.ticker AND f.ts_ms >= c.ts_ms + {GRID} GROUP BY c.ticker, c.ts_ms)
      SELECT ticker, ts_ms, (2 * any_value(bought) - any_value(dollars)) / any_value(dollars) AS flow_6h, CASE WHEN any_value(n2) >= 3 THEN any_value(n2) / {SPREAD_WIN / 1000} END AS rate_2h,
        CASE WHEN any_value(n) >= 5 THEN len(list_filter(any_value(sizes), lambda x: x > 2 * any_value(mean_size))) / any_value(n) END AS large_6h,
        CASE WHEN any_value(n) >= 5 THEN any_value(buys) / any_value(n) END AS buyers_6h
      FROM chain JOIN f USING (ticker, ts_ms) GROUP BY 1, 2)""",
)


@query("U1_custom_trade_factor", "SELECT * FROM arrival_trades", " ".join(TRADE_CONFIG))
def _(t):
    return TC.on_arrival(clean(t), TC.make(TRADE_CONFIG), GRID)


@query("W6_live_trade_factors", "SELECT * FROM arrival_trades", " ".join(TRADE_CONFIG))
def _(t):
    # Two stages of trades; each ticker's window, last price and beat last from one to the next.
    tr = clean(t)
    path = work_dir(t.spark)
    parts = [tr.filter(F.col("ts_ms") <= CUT), tr.filter(F.col("ts_ms") > CUT)]
    in_stages(t.spark, parts, path, lambda live: append_files(live_tick_factors(live, TC.make(TRADE_CONFIG), GRID), path))
    return t.spark.read.parquet(f"{path}/data")


QUOTE_CONFIG = {
    "skew_2h": {"factor": "size_skew", "params": {"window_ms": SPREAD_WIN}},
    "spread_2h": {"factor": "bid_ask_spread", "params": {"window_ms": SPREAD_WIN}},
    "imbalance_2h": {"factor": "order_imbalance", "params": {"window_ms": SPREAD_WIN}},
    "rate_4h": {"factor": "quote_rate", "params": {"window_ms": RATE_WIN, "min_quotes": 3}},
}
_V = "FILTER (bid > 0 AND ask > 0)"
fragment(
    "grid_quotes",
    f"""SELECT g.ticker, g.ts_ms, (sum(bid_size) {_V[:-1]} AND q.ts_ms >= g.ts_ms - {SPREAD_WIN})) / nullif(sum(ask_size) {_V[:-1]} AND q.ts_ms >= g.ts_ms - {SPREAD_WIN}), 0) AS skew_2h
    FROM qgrid g LEFT JOIN quotes q ON q.ticker = g.ticker AND q.ts_ms BETWEEN g.ts_ms - {SPREAD_WIN} AND g.ts_ms GROUP BY ALL""",
)


@query(
    "U1_custom_quote_factor",
    """SELECT s.ticker, s.ts_ms, skew_2h, bid_ask_spread AS spread_2h, order_imbalance AS imbalance_2h, quote_rate AS rate_4h FROM grid_quotes s JOIN quote_factor_table USING (ticker, ts_ms)""",
    " ".join(QUOTE_CONFIG),
)
def _(t):
    q = t.quotes()
    return TC.evaluate(q, compute_grid(q, GRID), TC.make(QUOTE_CONFIG))


CONFIG = {
    "rel_vol_10": {"factor": "relative_volume", "params": {"lookback": 10}, "timeframes": ["1h", "4h"]},
    "vwap_dev_5": {"factor": "vwap_deviation", "params": {"period": 5}},
    "minute_only": {"factor": "momentum", "params": {"window": 3}, "timeframes": ["1m"]},
}


@query(
    "U2_factor_configuration",
    f"""SELECT ticker, bar_start, CASE WHEN row_number() {_W}) >= 10 THEN volume / avg(volume) {_W} ROWS 9 PRECEDING) END AS rel_vol_10,
      CASE WHEN row_number() {_W}) >= 5 THEN (close / (sum(close * volume) {_W} ROWS 4 PRECEDING) / sum(volume) {_W} ROWS 4 PRECEDING)) - 1) * 100 END AS vwap_dev_5 FROM bars""",
    "rel_vol_10 vwap_dev_5",
)
def _(t):
    return add_factors(hour_bars(t).select("ticker", "bar_start", "open", "high", "low", "close", "volume"), parse_specs(CONFIG), "1h").select("ticker", "bar_start", "rel_vol_10", "vwap_dev_5")


@query(
    "U4_custom_gate",
    """SELECT entry_id, CASE WHEN gain_at_entry > 20 OR n_fwd_trades < 5 THEN 'chase' END AS reject_layer,
      CASE WHEN gain_at_entry > 20 THEN 'already up' WHEN n_fwd_trades < 5 THEN 'no exit' END AS reject_reason FROM contexts""",
)
def _(t):
    gate = G.Gate("chase", ((F.col("gain_at_entry") > 20, "already up"), (F.col("n_fwd_trades") < 5, "no exit")))
    return G.apply_gates(contexts(t), [gate]).select("entry_id", "reject_layer", "reject_reason")
