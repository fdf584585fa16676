"""Trade, quote and tick factors. The events are sparser than real ticks, so windows are hours here."""

from pyspark.sql import functions as F

from tapewright.operators import bar_factors as B, tick_factors as T, ticks as K
from tapewright.operators.joins import factor_timeseries
from tapewright.plans.ctes import fragment
from tapewright.plans.q_bars import FACTOR_SQL, hour_bars
from tapewright.plans.registry import query

GRID = 3_600_000
WIN = 6 * GRID
SPREAD_WIN = 2 * GRID
RATE_WIN = 4 * GRID

fragment(
    "hgrid",
    f"""SELECT ticker, unnest(range(a - a % {GRID} + {GRID}, b + 1, {GRID})) AS ts_ms
    FROM (SELECT ticker, min(ts_ms) AS a, max(ts_ms) AS b FROM clean GROUP BY 1)""",
)
fragment(
    "sided",
    """SELECT *, CASE WHEN price < lag(price) OVER (PARTITION BY ticker ORDER BY ts_ms, seq) THEN 0 ELSE 1 END AS is_buy FROM clean""",
)
fragment(
    "trade_win",
    f"""SELECT g.ticker, g.ts_ms, count(s.seq) AS n, sum(is_buy) AS buys, avg(size) AS mean_size, list(size) AS sizes
    FROM hgrid g LEFT JOIN sided s ON s.ticker = g.ticker AND s.ts_ms BETWEEN g.ts_ms - {WIN} AND g.ts_ms GROUP BY ALL""",
)
fragment(
    "trade_factor_table",
    f"""SELECT ticker, ts_ms, CASE WHEN n >= 5 THEN n / {WIN / 1000} END AS trade_rate,
      CASE WHEN n >= 5 THEN len(list_filter(sizes, lambda x: x > 2 * mean_size)) / n END AS large_trade_ratio,
      CASE WHEN n >= 5 THEN buys / n END AS aggressor_ratio FROM trade_win""",
)
fragment(
    "qgrid",
    f"""SELECT ticker, unnest(range(a - a % {GRID} + {GRID}, b + 1, {GRID})) AS ts_ms
    FROM (SELECT ticker, min(ts_ms) AS a, max(ts_ms) AS b FROM quotes GROUP BY 1)""",
)
fragment(
    "quote_factor_table",
    f"""SELECT g.ticker, g.ts_ms, avg((ask - bid) / ((ask + bid) / 2) * 10000) FILTER (q.ts_ms >= g.ts_ms - {SPREAD_WIN} AND bid > 0 AND ask > 0) AS bid_ask_spread,
      (sum(bid_size) FILTER (q.ts_ms >= g.ts_ms - {SPREAD_WIN}) - sum(ask_size) FILTER (q.ts_ms >= g.ts_ms - {SPREAD_WIN}))
       / (sum(bid_size) FILTER (q.ts_ms >= g.ts_ms - {SPREAD_WIN}) + sum(ask_size) FILTER (q.ts_ms >= g.ts_ms - {SPREAD_WIN})) AS order_imbalance,
      CASE WHEN count(q.seq) >= 3 THEN count(q.seq) / {RATE_WIN / 1000} END AS quote_rate
    FROM qgrid g LEFT JOIN quotes q ON q.ticker = g.ticker AND q.ts_ms BETWEEN g.ts_ms - {RATE_WIN} AND g.ts_ms GROUP BY ALL""",
)


def clean(t):
    return K.drop_delayed(t.trades())


def trade_table(t, names=("trade_rate", "large_trade_ratio", "aggressor_ratio")):
    tr = clean(t)
    return T.trade_factors(tr, T.compute_grid(tr, GRID), WIN, 5, names=names, step_ms=GRID)


def quote_table(t, names=("bid_ask_spread", "order_imbalance", "quote_rate")):
    q = t.quotes()
    return T.quote_factors(q, T.compute_grid(q, GRID), SPREAD_WIN, SPREAD_WIN, RATE_WIN, 3, names, GRID)


for _id, _f in (("T1", "trade_rate"), ("T2", "large_trade_ratio"), ("T3", "aggressor_ratio")):

    @query(f"{_id}_{_f}", f"SELECT ticker, ts_ms, {_f} FROM trade_factor_table", _f)
    def _(t, f=_f):
        return trade_table(t, (f,))


for _id, _f in (("T4", "bid_ask_spread"), ("T5", "order_imbalance"), ("T6", "quote_rate")):

    @query(f"{_id}_{_f}", f"SELECT ticker, ts_ms, {_f} FROM quote_factor_table", _f)
    def _(t, f=_f):
        return quote_table(t, (f,))


@query(
    "T7_event_driven_spread",
    f"""SELECT ticker, seq, ts_ms, bid_ask_spread FROM (
      WITH RECURSIVE q AS (SELECT ticker, seq, ts_ms, avg((ask - bid) / ((ask + bid) / 2) * 10000) OVER (
          PARTITION BY ticker ORDER BY ts_ms RANGE BETWEEN {SPREAD_WIN} PRECEDING AND CURRENT ROW) AS bid_ask_spread FROM quotes WHERE bid > 0 AND ask > 0),
        chain AS (SELECT ticker, min(ts_ms) AS ts_ms FROM q GROUP BY 1
          UNION ALL
          SELECT c.ticker, min(q.ts_ms) FROM chain c JOIN q ON q.ticker = c.ticker AND q.ts_ms >= c.ts_ms + {GRID} GROUP BY c.ticker, c.ts_ms)
      SELECT q.* FROM chain JOIN q USING (ticker, ts_ms))""",
    "bid_ask_spread",
)
def _(t):
    f = T.arrival_quote_factors(t.quotes(), GRID, SPREAD_WIN, names=("bid_ask_spread",))
    return f.select("ticker", "seq", "ts_ms", F.col("value").alias("bid_ask_spread"))


def _arrivals_sql(factor: str, value: str, window: int) -> str:
    """SQL of a factor thrown by any quote at least GRID after the last one."""
    return f"""SELECT ticker, seq, ts_ms, {factor} FROM (
      WITH RECURSIVE q AS (SELECT ticker, seq, ts_ms, {value} AS {factor} FROM quotes WINDOW w AS (PARTITION BY ticker ORDER BY ts_ms RANGE BETWEEN {window} PRECEDING AND CURRENT ROW)),
        chain AS (SELECT ticker, min(ts_ms) AS ts_ms FROM q GROUP BY 1
          UNION ALL
          SELECT c.ticker, min(q.ts_ms) FROM chain c JOIN q ON q.ticker = c.ticker AND q.ts_ms >= c.ts_ms + {GRID} GROUP BY c.ticker, c.ts_ms)
      SELECT q.* FROM chain JOIN q USING (ticker, ts_ms) QUALIFY row_number() OVER (PARTITION BY ticker, ts_ms ORDER BY seq) = 1)"""


fragment("arrival_imbalance", _arrivals_sql("order_imbalance", f"coalesce((sum(bid_size) OVER w - sum(ask_size) OVER w) / nullif(sum(bid_size) OVER w + sum(ask_size) OVER w, 0), 0)", SPREAD_WIN))
fragment("arrival_rate", _arrivals_sql("quote_rate", f"CASE WHEN count(*) OVER w >= 3 THEN count(*) OVER w / {RATE_WIN / 1000} END", RATE_WIN))


@query("T7_event_driven_imbalance", "SELECT * FROM arrival_imbalance", "order_imbalance")
def _(t):
    f = T.arrival_quote_factors(t.quotes(), GRID, imbalance_ms=SPREAD_WIN, names=("order_imbalance",))
    return f.select("ticker", "seq", "ts_ms", F.col("value").alias("order_imbalance"))


@query("T7_event_driven_quote_rate", "SELECT * FROM arrival_rate", "quote_rate")
def _(t):
    f = T.arrival_quote_factors(t.quotes(), GRID, rate_ms=RATE_WIN, min_quotes=3, names=("quote_rate",))
    return f.select("ticker", "seq", "ts_ms", F.col("value").alias("quote_rate"))


@query(
    "T7_event_driven_factors",
    """SELECT ticker, seq, ts_ms, 'order_imbalance' AS factor, order_imbalance AS value FROM arrival_imbalance
    UNION ALL SELECT ticker, seq, ts_ms, 'quote_rate', quote_rate FROM arrival_rate""",
    "value",
)
def _(t):
    return T.arrival_quote_factors(t.quotes(), GRID, SPREAD_WIN, SPREAD_WIN, RATE_WIN, 3, ("order_imbalance", "quote_rate"))


@query(
    "T8_z_score",
    """SELECT ticker, bar_start, CASE WHEN n < 2 THEN NULL WHEN sd < 1e-9 THEN 0 ELSE (volume - mean) / sd END AS z FROM (
      SELECT *, count(volume) OVER w AS n, avg(volume) OVER w AS mean, stddev_pop(volume) OVER w AS sd FROM bars
      WINDOW w AS (PARTITION BY ticker ORDER BY bar_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
    "z",
)
def _(t):
    return T.z_score(hour_bars(t), "volume", 20).select("ticker", "bar_start", "z")


@query(
    "T9_price_acceleration",
    f"""SELECT ticker, seq, ts_ms, coalesce((p1 / p0 - 1) / nullif((t1 - t0) / 1000.0, 0), 0) - coalesce((q1 / q0 - 1) / nullif((u1 - u0) / 1000.0, 0), 0) AS price_accel
    FROM (SELECT a.ticker, a.seq, a.ts_ms,
      arg_min(b.price, (b.ts_ms, b.seq)) FILTER (b.ts_ms > a.ts_ms - {WIN}) AS p0, arg_max(b.price, (b.ts_ms, b.seq)) FILTER (b.ts_ms > a.ts_ms - {WIN}) AS p1,
      min(b.ts_ms) FILTER (b.ts_ms > a.ts_ms - {WIN}) AS t0, max(b.ts_ms) FILTER (b.ts_ms > a.ts_ms - {WIN}) AS t1,
      arg_min(b.price, (b.ts_ms, b.seq)) FILTER (b.ts_ms <= a.ts_ms - {WIN}) AS q0, arg_max(b.price, (b.ts_ms, b.seq)) FILTER (b.ts_ms <= a.ts_ms - {WIN}) AS q1,
      min(b.ts_ms) FILTER (b.ts_ms <= a.ts_ms - {WIN}) AS u0, max(b.ts_ms) FILTER (b.ts_ms <= a.ts_ms - {WIN}) AS u1
      FROM clean a JOIN clean b ON a.ticker = b.ticker AND b.ts_ms > a.ts_ms - 2 * {WIN} AND b.ts_ms <= a.ts_ms GROUP BY ALL)""",
    "price_accel",
)
def _(t):
    return T.price_acceleration(clean(t), WIN)


@query("T10_compute_grid", "SELECT ticker, ts_ms FROM hgrid")
def _(t):
    return T.compute_grid(clean(t), GRID)


fragment(
    "sticky",
    """SELECT *, coalesce(last_value(chg IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts_ms, seq), 1) AS side FROM (
      SELECT *, CASE WHEN price > lag(price) OVER o THEN 1 WHEN price < lag(price) OVER o THEN 0 END AS chg FROM clean
      WINDOW o AS (PARTITION BY ticker ORDER BY ts_ms, seq))""",
)


_LABELS = f"""SELECT ticker, seq, ts_ms, CASE WHEN ok THEN round(n / (span / 1000.0), 3) ELSE 0 END AS trade_rate,
      CASE WHEN ok THEN round(len(list_filter(sizes, lambda x: x > 2 * mean_size)) / n, 3) ELSE 0 END AS large_trade_ratio,
      CASE WHEN ok THEN round(buys / n, 3) ELSE 0 END AS aggressor_ratio
    FROM (SELECT *, n >= 5 AND span > 0 AS ok, row_number() OVER (PARTITION BY ticker ORDER BY ts_ms, seq) - 1 AS rn, count(*) OVER (PARTITION BY ticker) AS c FROM (
      SELECT a.ticker, a.seq, a.ts_ms, count(*) AS n, any_value(a.ts_ms) - min(b.ts_ms) AS span, list(b.size) AS sizes, avg(b.size) AS mean_size, sum(b.side) AS buys
      FROM sticky a JOIN sticky b ON a.ticker = b.ticker AND b.ts_ms BETWEEN a.ts_ms - {WIN} AND a.ts_ms AND (b.ts_ms, b.seq) <= (a.ts_ms, a.seq) GROUP BY 1, 2, 3))
    """


@query("T11_labeling_factors", _LABELS + " WHERE rn % greatest(1, c // 500) = 0", "trade_rate large_trade_ratio aggressor_ratio")
def _(t):
    trades = clean(t)
    return T.labeling_factors(trades, WIN, points=T.decimate(trades.select("ticker", "ts_ms", "seq"), 500))


@query("T11_every_point", _LABELS, "trade_rate large_trade_ratio aggressor_ratio")
def _(t):
    return T.labeling_factors(clean(t), WIN)


@query(
    "T12_points_onto_bar_grid",
    """SELECT b.ticker, b.bar_start, coalesce(arg_max(p.trade_rate, p.ts_ms), any_value(f.first_rate), 0) AS trade_rate
    FROM bars b LEFT JOIN (SELECT * FROM trade_factor_table WHERE trade_rate IS NOT NULL) p ON p.ticker = b.ticker AND p.ts_ms <= b.bar_start
    LEFT JOIN (SELECT ticker, arg_min(trade_rate, ts_ms) AS first_rate FROM trade_factor_table WHERE trade_rate IS NOT NULL GROUP BY 1) f ON f.ticker = b.ticker
    GROUP BY ALL""",
    "trade_rate",
)
def _(t):
    points = trade_table(t, ("trade_rate",)).filter(F.col("trade_rate").isNotNull())
    grid = hour_bars(t).select("ticker", F.col("bar_start").alias("ts_ms"))
    return T.onto_bar_grid(points, grid, "trade_rate").withColumnRenamed("ts_ms", "bar_start")


_BARF = ["relative_volume", "price_direction", "gap_percent"]
_ALL = [*_BARF, "trade_rate", "aggressor_ratio", "bid_ask_spread", "order_imbalance"]
fragment(
    "merged_factors",
    "SELECT ticker, ts_ms, "
    + ", ".join(f"last_value({n} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts_ms) AS {n}" for n in _ALL)
    + f""" FROM (SELECT ticker, ts_ms, {', '.join(f'max({n}) AS {n}' for n in _ALL)} FROM (
      SELECT ticker, bar_end AS ts_ms, {', '.join(_BARF)}, NULL::DOUBLE AS trade_rate, NULL::DOUBLE AS aggressor_ratio, NULL::DOUBLE AS bid_ask_spread, NULL::DOUBLE AS order_imbalance FROM bar_factor_table
      UNION ALL SELECT ticker, ts_ms, NULL, NULL, NULL, trade_rate, aggressor_ratio, NULL, NULL FROM trade_factor_table
      UNION ALL SELECT ticker, ts_ms, NULL, NULL, NULL, NULL, NULL, bid_ask_spread, order_imbalance FROM quote_factor_table) GROUP BY 1, 2)""",
)


def merged_table(t):
    bars = B.add_bar_factors(hour_bars(t)).withColumn("ts_ms", F.col("bar_end"))
    return T.merge_factor_sets(
        [
            (bars, _BARF),
            (trade_table(t, ("trade_rate", "aggressor_ratio")), ["trade_rate", "aggressor_ratio"]),
            (quote_table(t, ("bid_ask_spread", "order_imbalance")), ["bid_ask_spread", "order_imbalance"]),
        ]
    )


@query("T13_merged_factors", "SELECT * FROM merged_factors", " ".join(_ALL))
def _(t):
    return merged_table(t)


@query(
    "T14_factor_timeseries",
    f"""SELECT m.ticker, m.ts_ms, {', '.join('m.' + n for n in _ALL)}, gain AS entry_gap_pct,
      CASE WHEN et % 86400000 < 25200000 THEN 'early' WHEN et % 86400000 < 32400000 THEN 'mid' ELSE 'late' END AS session_phase
    FROM (SELECT *, epoch_us(timezone('America/New_York', timezone('UTC', make_timestamp(ts_ms * 1000)))) // 1000 AS et FROM merged_factors) m
    JOIN (SELECT ticker, min(ts_ms) AS first_entry_ms, arg_min(price, (ts_ms, seq)) - 20 AS gain FROM clean WHERE price >= 35 GROUP BY 1) c
      ON c.ticker = m.ticker AND m.ts_ms >= c.first_entry_ms""",
    " ".join(_ALL) + " entry_gap_pct",
)
def _(t):
    entries = clean(t).filter("price >= 35").groupBy("ticker").agg(
        F.min("ts_ms").alias("first_entry_ms"), (F.min_by("price", K.order_key()) - 20).alias("gain_at_entry")
    )
    return factor_timeseries(merged_table(t), entries).select("ticker", "ts_ms", *_ALL, "entry_gap_pct", "session_phase")


@query(
    "T15_timeline_sample",
    f"""SELECT ticker, ts_ms // 21600000 * 21600000 AS slot_ms, {', '.join(f'arg_max({n}, ts_ms) FILTER ({n} IS NOT NULL) AS {n}' for n in _ALL)}
    FROM merged_factors GROUP BY 1, 2""",
    " ".join(_ALL),
)
def _(t):
    return T.sample_timeline(merged_table(t), _ALL, 21_600_000)


@query(
    "T16_signal_density",
    f"""SELECT ticker, ts_ms, CAST(sum(CASE WHEN trade_rate > 0.0007 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts_ms
      RANGE BETWEEN {4 * WIN - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS signal_density FROM trade_factor_table""",
)
def _(t):
    return T.signal_density(trade_table(t, ("trade_rate",)), "trade_rate", 0.0007, 4 * WIN).select("ticker", "ts_ms", "signal_density")


@query(
    "T17_factors_long",
    " UNION ALL ".join(f"SELECT ticker, ts_ms, '{n}' AS factor, {n} AS value FROM trade_factor_table WHERE {n} IS NOT NULL" for n in ("trade_rate", "large_trade_ratio", "aggressor_ratio")),
    "value",
)
def _(t):
    return T.to_long(trade_table(t), ["trade_rate", "large_trade_ratio", "aggressor_ratio"])


@query("T17_factors_wide", "SELECT ticker, ts_ms, trade_rate, aggressor_ratio FROM trade_factor_table WHERE trade_rate IS NOT NULL", "trade_rate aggressor_ratio")
def _(t):
    long = T.to_long(trade_table(t, ("trade_rate", "aggressor_ratio")), ["trade_rate", "aggressor_ratio"])
    return T.to_wide(long, ["trade_rate", "aggressor_ratio"])
