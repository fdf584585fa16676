"""Lookups, interval joins and reference-data joins."""

from pyspark.sql import functions as F

from tapewright.functions import session as S
from tapewright.functions.numeric import floor_div
from tapewright.functions.timewin import asof_join
from tapewright.operators.snapshots import common_stocks
from tapewright.operators import joins as J, tick_factors as T, ticks as K
from tapewright.plans.ctes import fragment
from tapewright.plans.q_bars import daily_bars, hour_bars
from tapewright.plans.q_snapshots import candidates, daily, splits, subs_of, windows
from tapewright.plans.q_ticks import clean, trade_table
from tapewright.plans.registry import query

HOUR = 3_600_000
HOLD = 12 * HOUR

fragment("signals", "SELECT seq AS signal_id, ticker, ts_ms AS entry_ms, size, exchange FROM clean WHERE size >= 90")


def signals(t):
    """Large trades as entry signals."""
    return clean(t).filter("size >= 90").select(F.col("seq").alias("signal_id"), "ticker", F.col("ts_ms").alias("entry_ms"), "size", "exchange")


@query("J1_left_dimension_join", "SELECT w.date, w.ticker, w.window_ms, w.price, p.country, p.sector FROM tw w LEFT JOIN profiles p USING (ticker)", "price")
def _(t):
    return J.dimension_join(windows(t).select("date", "ticker", "window_ms", "price"), t.profiles().select("ticker", "country", "sector"), ["ticker"])


@query("J2_universe_join", "SELECT d.date, d.ticker, d.close, u.type FROM daily d JOIN universe u USING (ticker)", "close")
def _(t):
    u = common_stocks(t.profiles(), "2024-01-10").select("ticker", "type")
    return J.dimension_join(daily(t).select("date", "ticker", "close"), u, ["ticker"], "inner")


@query("J3_anti_join", "SELECT date, ticker, volume FROM daily ANTI JOIN universe USING (ticker)")
def _(t):
    return daily(t).select("date", "ticker", "volume").join(common_stocks(t.profiles(), "2024-01-10"), "ticker", "left_anti")


@query(
    "J4_next_split",
    """SELECT d.date, d.ticker, min(s.execution_date) AS split_date FROM daily d
    LEFT JOIN splits s ON s.ticker = d.ticker AND s.execution_date >= d.date GROUP BY 1, 2""",
)
def _(t):
    epoch = F.lit("1970-01-01").cast("date")
    d = daily(t).select("date", "ticker", F.datediff("date", epoch).cast("long").alias("day"))
    s = splits(t).select("ticker", F.col("execution_date").alias("split_date"), F.datediff("execution_date", epoch).cast("long").alias("sday"))
    return asof_join(d, s, ["ticker"], "day", "sday", ["split_date"], direction="forward", bucket_ms=365).select("date", "ticker", "split_date")


@query(
    "J5_price_at_or_before",
    f"""SELECT signal_id, coalesce(arg_max(c.price, (c.ts_ms, c.seq)) FILTER (c.ts_ms <= t0),
        arg_min(c.price, (c.ts_ms, c.seq)) FILTER (c.ts_ms > t0 AND c.ts_ms <= t0 + {2 * HOUR})) AS entry_price
    FROM (SELECT *, entry_ms - {HOUR} AS t0 FROM signals) s LEFT JOIN clean c ON c.ticker = s.ticker AND c.ts_ms <= t0 + {2 * HOUR} GROUP BY 1""",
    "entry_price",
)
def _(t):
    p = signals(t).withColumn("entry_ms", F.col("entry_ms") - HOUR)
    return J.entry_prices(p, clean(t), fallback_ms=2 * HOUR).select("signal_id", "entry_price")


@query(
    "J6_first_at_or_after",
    f"""SELECT signal_id, coalesce(min(b.bar_start) FILTER (b.bar_start >= et), max(b.bar_start)) AS r_bar_start,
      coalesce(arg_min(close, b.bar_start) FILTER (b.bar_start >= et), arg_max(close, b.bar_start)) AS r_close
    FROM (SELECT signal_id, s.ticker, et_ms + {24 * HOUR} AS et FROM signals s JOIN clean c ON c.seq = s.signal_id) s JOIN bars b ON b.ticker = s.ticker GROUP BY 1""",
    "r_close",
)
def _(t):
    p = signals(t).withColumn("et", S.to_et_ms("entry_ms") + 24 * HOUR)
    return J.first_at_or_after(p, hour_bars(t), "et", "bar_start", ["close"]).select("signal_id", "r_bar_start", "r_close")


@query(
    "J7_nearest_price",
    f"""SELECT signal_id, arg_min(c.price, (abs(c.ts_ms - t0), c.ts_ms, CASE WHEN c.ts_ms <= t0 THEN -c.seq ELSE c.seq END)) AS near_price
    FROM (SELECT *, entry_ms + {5 * HOUR} AS t0 FROM signals) s LEFT JOIN clean c ON c.ticker = s.ticker AND abs(c.ts_ms - t0) <= {HOUR // 4} GROUP BY 1""",
    "near_price",
)
def _(t):
    p = signals(t).withColumn("t0", F.col("entry_ms") + 5 * HOUR)
    return J.nearest(p, clean(t), "t0", "ts_ms", "price", "seq", HOUR // 4, "near_price").select("signal_id", "near_price")


fragment("et_signals", "SELECT signal_id, s.ticker, entry_ms, et_ms FROM signals s JOIN clean c ON c.seq = s.signal_id")

def close_at_sql(offset: int) -> str:
    return f"""SELECT signal_id, CASE WHEN et - p < {HOUR} THEN pc WHEN n - et <= {2 * HOUR} THEN nc END AS close_at FROM (
      SELECT signal_id, et_ms + {offset} AS et, max(b.bar_start) FILTER (b.bar_start <= et_ms + {offset}) AS p, arg_max(close, b.bar_start) FILTER (b.bar_start <= et_ms + {offset}) AS pc,
        min(b.bar_start) FILTER (b.bar_start > et_ms + {offset}) AS n, arg_min(close, b.bar_start) FILTER (b.bar_start > et_ms + {offset}) AS nc
      FROM et_signals s JOIN bars b ON b.ticker = s.ticker GROUP BY 1, 2)"""


@query("J8_containing_bar_close", close_at_sql(3 * HOUR), "close_at")
def _(t):
    p = signals(t).withColumn("et", S.to_et_ms("entry_ms") + 3 * HOUR)
    return J.close_at(hour_bars(t), p, "et", HOUR, 2 * HOUR).select("signal_id", "close_at")


@query(
    "J9_signal_trade_interval",
    f"""SELECT signal_id, count(c.seq) AS n, CAST(coalesce(sum(c.size), 0) AS BIGINT) AS volume FROM signals s
    LEFT JOIN clean c ON c.ticker = s.ticker AND c.ts_ms > entry_ms AND c.ts_ms <= entry_ms + {HOLD} GROUP BY 1""",
)
def _(t):
    v = J.interval_volume(signals(t).select("signal_id", "ticker", "entry_ms"), clean(t), "entry_ms", HOLD)
    return v.groupBy("signal_id").agg(F.sum("n").alias("n"), F.sum("volume").alias("volume"))


@query(
    "J10_max_in_window",
    f"""SELECT signal_id, max(c.price) AS max_price FROM signals s
    LEFT JOIN clean c ON c.ticker = s.ticker AND c.ts_ms BETWEEN entry_ms AND entry_ms + {HOLD} GROUP BY 1""",
    "max_price",
)
def _(t):
    return J.max_in_window(signals(t), clean(t), "entry_ms", HOLD, "signal_id", "max_price")


fragment(
    "split_table",
    """SELECT ticker, split_date, product(r) OVER (PARTITION BY ticker ORDER BY split_date DESC) AS factor FROM (
      SELECT s.ticker, execution_date - 1 AS split_date, product(split_from / split_to) AS r FROM splits s JOIN (
        SELECT ticker, min(date) AS a, max(date) AS b FROM daily GROUP BY 1) x ON x.ticker = s.ticker AND execution_date BETWEEN a - 1 AND b + 1
      GROUP BY 1, 2)""",
)


@query(
    "J11_split_adjusted_bars",
    """SELECT b.ticker, b.bar_start, round(open * f, 4) AS open, round(high * f, 4) AS high, round(low * f, 4) AS low, round(close * f, 4) AS close,
      CAST(round(volume / f) AS BIGINT) AS volume, trade_count FROM (
      SELECT b.*, coalesce((SELECT arg_min(factor, split_date) FROM split_table s WHERE s.ticker = b.ticker
        AND s.split_date >= DATE '1970-01-01' + CAST(bar_start // 86400000 AS INTEGER)), 1) AS f FROM daily_bars b) b""",
    "open high low close",
)
def _(t):
    b = daily_bars(t).select("ticker", "bar_start", "open", "high", "low", "close", "volume", "trade_count")
    return J.adjust_for_splits(b, splits(t))


def identities(t):
    """Two identifiers per ticker; shared ones chain renamed tickers together."""
    p, c = t.profiles(), t.read("customer")
    base = c.select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"), "c_custkey",
        F.date_add(F.lit("2024-01-02").cast("date"), (F.col("c_custkey") * 7 % 30).cast("int")).alias("last_updated"),
    ).join(p.select("ticker", "delisted"), "ticker")
    a = base.withColumn("figi", F.concat(F.lit("A"), floor_div("c_custkey", 2).cast("string")))
    b = base.withColumn("figi", F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("B"), floor_div(F.col("c_custkey") + 1, 2).cast("string"))))
    return a.unionByName(b).drop("c_custkey")


fragment(
    "identities",
    """SELECT b.ticker, figi, last_updated, delisted FROM (
      SELECT 'T' || CAST(c_custkey AS VARCHAR) AS ticker, DATE '2024-01-02' + CAST(c_custkey * 7 % 30 AS INTEGER) AS last_updated,
        unnest(['A' || CAST(c_custkey // 2 AS VARCHAR), CASE WHEN c_custkey % 5 <> 0 THEN 'B' || CAST((c_custkey + 1) // 2 AS VARCHAR) END]) AS figi FROM customer) b
    JOIN profiles p ON p.ticker = b.ticker""",
)
fragment(
    "reach",
    """WITH RECURSIVE e AS (SELECT DISTINCT a.ticker AS x, b.ticker AS y FROM identities a JOIN identities b USING (figi)),
      r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS ticker, min(y) AS group_id FROM r GROUP BY 1""",
)
fragment(
    "ticker_groups",
    """SELECT group_id, i.ticker, last_updated, delisted, row_number() OVER (PARTITION BY group_id ORDER BY last_updated, i.ticker) - 1 AS ordinal,
      arg_max(i.ticker, (last_updated, i.ticker)) OVER (PARTITION BY group_id) AS latest_ticker,
      list(i.ticker) OVER (PARTITION BY group_id ORDER BY last_updated, i.ticker ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tickers
    FROM (SELECT ticker, max(last_updated) AS last_updated, max(delisted) AS delisted FROM identities GROUP BY 1) i JOIN reach ON reach.ticker = i.ticker""",
)


@query(
    "J12_identity_groups",
    "SELECT group_id, ticker, CAST(ordinal AS INTEGER) AS ordinal, latest_ticker, array_to_string(tickers, ',') AS tickers, last_updated, delisted FROM ticker_groups",
)
def _(t):
    return J.ticker_groups(identities(t)).withColumn("tickers", F.concat_ws(",", "tickers"))


@query(
    "J13_rename_alignment",
    """SELECT latest_ticker AS ticker, source_ticker, date, close FROM (
      WITH RECURSIVE m AS (SELECT *, CASE WHEN delisted IS NULL THEN last_updated ELSE least(last_updated, delisted) END AS cut, count(*) OVER (PARTITION BY group_id) AS n FROM ticker_groups),
        ends AS (SELECT group_id, -1 AS ordinal, DATE '1900-01-01' AS last_end FROM m GROUP BY 1
          UNION ALL
          SELECT e.group_id, e.ordinal + 1, greatest(e.last_end, max(d.date))
          FROM ends e JOIN m ON m.group_id = e.group_id AND m.ordinal = e.ordinal + 1
          LEFT JOIN daily d ON d.ticker = m.ticker AND d.date > e.last_end AND d.date <= m.cut GROUP BY e.group_id, e.ordinal, e.last_end)
      SELECT m.latest_ticker, d.ticker AS source_ticker, d.date, d.close FROM daily d JOIN m ON m.ticker = d.ticker
        JOIN ends e ON e.group_id = m.group_id AND e.ordinal = m.ordinal - 1 WHERE n = 1 OR (d.date > e.last_end AND d.date <= m.cut))""",
    "close",
)
def _(t):
    bars = daily(t).select("date", "ticker", "close")
    return J.align_renames(bars, J.ticker_groups(identities(t)))


@query(
    "J14_profile_resolution",
    """SELECT g.ticker, g.latest_ticker, country, sector, type FROM ticker_groups g JOIN profiles p ON p.ticker = g.latest_ticker
    WHERE g.delisted IS NULL OR g.delisted > DATE '2024-01-15'""",
)
def _(t):
    return J.resolve_profiles(J.ticker_groups(identities(t)), t.profiles().select("ticker", "country", "sector", "type"), "2024-01-15")


@query(
    "J15_latest_factor",
    " UNION ALL ".join(
        f"SELECT ticker, '{n}' AS factor, arg_max({n}, ts_ms) AS value, max(ts_ms) AS ts_ms FROM trade_factor_table WHERE {n} IS NOT NULL GROUP BY 1"
        for n in ("trade_rate", "aggressor_ratio")
    ),
    "value",
)
def _(t):
    long = T.to_long(trade_table(t, ("trade_rate", "aggressor_ratio")), ["trade_rate", "aggressor_ratio"])
    return J.latest_factor(long)


@query(
    "J16_candidate_coverage",
    """SELECT coalesce(s.ticker, c.ticker) AS ticker, CASE WHEN c.ticker IS NULL THEN 'missing' WHEN s.ticker IS NULL THEN 'extra' ELSE 'both' END AS coverage
    FROM (SELECT DISTINCT ticker FROM subs) s FULL JOIN (SELECT DISTINCT ticker FROM candidates) c ON s.ticker = c.ticker""",
)
def _(t):
    return J.coverage_flags(subs_of(t), candidates(t), "ticker")
