"""Market snapshots over one-hour windows of the per-user trades."""

from pyspark.sql import functions as F

from tapewright.functions import session as S
from tapewright.operators import bars as A, snapshots as N, ticks as K
from tapewright.plans.ctes import fragment
from tapewright.plans.q_bars import daily_bars
from tapewright.plans.registry import query

WIN = 3_600_000
QCOLS = "bid ask bid_size ask_size"
SNAP = ["date", "ticker", "window_ms", "price", "volume", "prev_close", "prev_volume", "vwap", "bid", "ask", "bid_size", "ask_size", "change_pct"]
SNAP_F = "price prev_close prev_volume vwap bid ask bid_size ask_size change_pct"

fragment("daily", "SELECT DATE '1970-01-01' + CAST(bar_start // 86400000 AS INTEGER) AS date, ticker, close, volume, close * volume AS turnover FROM daily_bars")
fragment("prev_days", "SELECT date, lag(date) OVER (ORDER BY date) AS prev_date FROM (SELECT DISTINCT date FROM daily)")
fragment(
    "prev",
    """SELECT p.date, d.ticker, d.close AS prev_close, d.volume AS prev_volume FROM prev_days p
    JOIN daily d ON d.date = p.prev_date WHERE p.date - p.prev_date <= 7""",
)
fragment(
    "tw",
    f"""SELECT a.*, prev_close, prev_volume, (price - prev_close) / prev_close * 100 AS change_pct FROM (
      SELECT DATE '1970-01-01' + CAST(et_ms // 86400000 AS INTEGER) AS date, ticker, ts_ms // {WIN} * {WIN} AS window_ms,
        arg_max(price, (ts_ms, seq)) AS price, CAST(sum(size) AS BIGINT) AS volume, sum(price * size) AS turnover
      FROM wide_clean GROUP BY 1, 2, 3) a LEFT JOIN prev USING (date, ticker)""",
)
fragment(
    "qw",
    f"""SELECT ticker, ts_ms // {WIN} * {WIN} AS window_ms, arg_max(bid, (ts_ms, seq)) AS bid, arg_max(ask, (ts_ms, seq)) AS ask,
      arg_max(bid_size, (ts_ms, seq)) AS bid_size, arg_max(ask_size, (ts_ms, seq)) AS ask_size FROM wide_quotes GROUP BY 1, 2""",
)
fragment(
    "snap",
    """SELECT date, ticker, window_ms, price, CAST(sum(volume) OVER w AS BIGINT) AS volume, prev_close,
      coalesce(CAST(prev_volume AS DOUBLE), 0) AS prev_volume, sum(turnover) OVER w / sum(volume) OVER w AS vwap,
      coalesce(bid, 0) AS bid, coalesce(ask, 0) AS ask, coalesce(CAST(bid_size AS DOUBLE), 0) AS bid_size,
      coalesce(CAST(ask_size AS DOUBLE), 0) AS ask_size, change_pct
    FROM tw LEFT JOIN qw USING (ticker, window_ms) WINDOW w AS (PARTITION BY date, ticker ORDER BY window_ms)""",
)
_RANK = "CAST(row_number() OVER (PARTITION BY date, window_ms ORDER BY change_pct DESC NULLS LAST, ticker) AS INTEGER)"
# Windows are numbered per date and each row is repeated up to its ticker's next one, so only equal values are joined.
_NUMBERED = "SELECT date, window_ms, row_number() OVER (PARTITION BY date ORDER BY window_ms) AS i, count(*) OVER (PARTITION BY date) AS n FROM (SELECT DISTINCT date, window_ms FROM {snap})"
_FILL = f"""SELECT s.* EXCLUDE (window_ms, j), w.window_ms, w.window_ms <> s.window_ms AS carried, s.window_ms AS seen_ms FROM (
      SELECT * EXCLUDE (i, until), unnest(range(i, until + 1)) AS j FROM (
        SELECT s.*, w.i, coalesce(lead(w.i) OVER (PARTITION BY s.date, s.ticker ORDER BY w.i) - 1, w.n) AS until FROM {{snap}} s JOIN ({_NUMBERED}) w ON w.date = s.date AND w.window_ms = s.window_ms)) s
    JOIN ({_NUMBERED}) w ON w.date = s.date AND w.i = s.j"""
fragment("filled", _FILL.format(snap="snap"))
fragment("ranked_filled", f"SELECT *, {_RANK} AS rank FROM filled")
fragment("top_rows", "SELECT * FROM (SELECT *, max(change_pct) OVER (PARTITION BY date, window_ms) AS best FROM ranked_filled) WHERE rank <= 20 AND best > 0")
fragment(
    "subs",
    """SELECT date, ticker, min(window_ms) AS first_entry_ms, arg_min(change_pct, window_ms) AS gain_at_entry,
      arg_min(price, window_ms) AS price_at_entry, arg_min(volume, window_ms) AS volume_at_entry,
      CASE WHEN arg_min(prev_volume, window_ms) > 0 THEN arg_min(volume, window_ms) / arg_min(prev_volume, window_ms) ELSE 1 END AS relative_volume
    FROM top_rows GROUP BY 1, 2""",
)
fragment(
    "peaks",
    """SELECT date, ticker, max(change_pct) AS max_gain, max(volume) AS peak_volume, arg_min(prev_close, window_ms) AS prev_close
    FROM snap SEMI JOIN subs USING (date, ticker) WHERE change_pct > 0 GROUP BY 1, 2""",
)
fragment(
    "initial_top",
    f"""SELECT date, ticker FROM (SELECT *, {_RANK} AS rank FROM snap
      WHERE (date, window_ms) IN (SELECT (date, min(window_ms)) FROM snap GROUP BY date)) WHERE rank <= 20""",
)
SUB_F = "gain_at_entry price_at_entry relative_volume"


def daily(t):
    return daily_bars(t).select(S.et_date("bar_start").alias("date"), "ticker", "close", "volume", (F.col("close") * F.col("volume")).alias("turnover"))


def windows(t, days=None):
    """`days` are the rows of `daily`, where they are written already."""
    return N.trade_windows(K.drop_delayed(t.wide_trades()), N.previous_close(daily(t) if days is None else days), WIN)


def snap(t, days=None):
    return N.collector(windows(t, days), N.quote_windows(t.quotes("user"), WIN), unique_quotes=True)


def splits(t):
    p = t.read("part")
    return p.select(
        F.concat(F.lit("T"), F.expr("p_partkey div 2").cast("string")).alias("ticker"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") % 35).cast("int")).alias("execution_date"),
        (1 + F.col("p_partkey") % 3).cast("double").alias("split_from"),
        (1 + F.col("p_size") % 2).cast("double").alias("split_to"),
    )


fragment(
    "splits",
    """SELECT 'T' || CAST(p_partkey // 2 AS VARCHAR) AS ticker, DATE '2024-01-01' + CAST(p_size % 35 AS INTEGER) AS execution_date,
    CAST(1 + p_partkey % 3 AS DOUBLE) AS split_from, CAST(1 + p_size % 2 AS DOUBLE) AS split_to FROM part""",
)


@query("K1_trade_windows", "SELECT * FROM tw", "price turnover prev_close change_pct")
def _(t):
    return windows(t)


@query("K2_quote_windows", "SELECT * FROM qw", "bid ask")
def _(t):
    return N.quote_windows(t.quotes("user"), WIN)


@query("K3_collector_snapshot", "SELECT * FROM snap", SNAP_F)
def _(t):
    return snap(t)


@query("K4_rank_cross_section", f"SELECT date, ticker, window_ms, {_RANK} AS rank FROM snap")
def _(t):
    return N.rank_cross_section(snap(t)).select("date", "ticker", "window_ms", "rank")


@query("K5_previous_close", "SELECT * FROM prev", "prev_close")
def _(t):
    return N.previous_close(daily(t))


@query(
    "K6_split_adjusted_close",
    """SELECT date, ticker, prev_close * coalesce(f, 1) AS prev_close, prev_volume FROM prev LEFT JOIN (
      SELECT execution_date AS date, ticker, product(split_from / split_to) AS f FROM splits GROUP BY 1, 2) USING (date, ticker)""",
    "prev_close",
)
def _(t):
    return N.split_adjusted_close(N.previous_close(daily(t)), splits(t))


@query("K7_carry_forward", "SELECT * FROM filled", SNAP_F)
def _(t):
    return N.carry_forward(snap(t))


@query("K8_subscription_set", "SELECT * FROM subs", SUB_F)
def _(t):
    return N.subscriptions(N.carry_forward(snap(t)))


@query("K9_new_entries_only", "SELECT date, ticker, first_entry_ms FROM subs ANTI JOIN initial_top USING (date, ticker)")
def _(t):
    s = snap(t)
    return N.subscriptions(N.carry_forward(s)).join(N.initial_top(s), ["date", "ticker"], "left_anti").select("date", "ticker", "first_entry_ms")


@query("K10_candidate_peaks", "SELECT * FROM peaks", "max_gain prev_close")
def _(t):
    s = snap(t)
    return N.candidate_peaks(s, N.subscriptions(N.carry_forward(s)))


fragment("universe", "SELECT * FROM profiles WHERE type IN ('CS', 'ADRC') AND (delisted IS NULL OR delisted > DATE '2024-01-10')")
fragment("usnap", "SELECT snap.* FROM snap SEMI JOIN universe USING (ticker)")
fragment("ufilled", _FILL.format(snap="usnap"))
fragment("uranked", f"SELECT *, {_RANK} AS rank, max(change_pct) OVER (PARTITION BY date, window_ms) AS best FROM ufilled")


@query(
    "K11_processed_snapshot",
    """SELECT * EXCLUDE (best), CASE WHEN prev_volume > 0 THEN volume / prev_volume ELSE 1 END AS relative_volume_daily FROM uranked
    SEMI JOIN (SELECT date, ticker FROM uranked WHERE rank <= 20 AND best > 0) USING (date, ticker)""",
    SNAP_F + " relative_volume_daily",
)
def _(t):
    return N.process_collector(snap(t), N.common_stocks(t.profiles(), "2024-01-10"))


fragment(
    "recent_volume",
    f"""SELECT *, CASE WHEN n >= 2 AND avg5 > 0 THEN greatest(volume - v1, 0) / avg5 ELSE 1 END AS relative_volume_5min FROM (
      SELECT *, greatest(volume - coalesce(v5, v0), 0) / CASE WHEN v5 IS NOT NULL THEN 5.0 ELSE greatest((window_ms - t0) / CAST({WIN} AS DOUBLE), 1) END AS avg5 FROM (
        SELECT a.date, a.ticker, a.window_ms, a.volume, count(*) AS n, arg_min(b.volume, b.window_ms) AS v0, min(b.window_ms) AS t0,
          coalesce(arg_max(b.volume, b.window_ms) FILTER (b.window_ms <= a.window_ms - {WIN}), arg_min(b.volume, b.window_ms)) AS v1,
          arg_max(b.volume, b.window_ms) FILTER (b.window_ms <= a.window_ms - 5 * {WIN}) AS v5
        FROM snap a JOIN snap b ON a.date = b.date AND a.ticker = b.ticker AND b.window_ms BETWEEN a.window_ms - 6 * {WIN} AND a.window_ms
        GROUP BY 1, 2, 3, 4))""",
)


@query("K12_relative_volume_5min", "SELECT date, ticker, window_ms, relative_volume_5min FROM recent_volume", "relative_volume_5min")
def _(t):
    return N.relative_volume_recent(snap(t), WIN).select("date", "ticker", "window_ms", "relative_volume_5min")


@query(
    "K13_relative_volume_daily",
    "SELECT date, ticker, window_ms, CASE WHEN prev_volume > 0 THEN volume / prev_volume ELSE 1 END AS relative_volume_daily FROM snap",
    "relative_volume_daily",
)
def _(t):
    return snap(t).select("date", "ticker", "window_ms", N.relative_volume_daily().alias("relative_volume_daily"))


@query("K14_weighted_mid", "SELECT ticker, seq, (bid * ask_size + ask * bid_size) / (bid_size + ask_size) AS weighted_mid FROM wide_quotes", "weighted_mid")
def _(t):
    return t.quotes("user").select("ticker", "seq", K.weighted_mid().alias("weighted_mid"))


_LATEST = """SELECT date, ticker, window_ms, change_pct, price, rank FROM ranked_filled
    WHERE (date, window_ms) IN (SELECT (date, max(window_ms)) FROM snap GROUP BY date) AND rank <= 20"""


@query("K15_overview_series", f"SELECT date, ticker, window_ms, change_pct FROM ranked_filled SEMI JOIN ({_LATEST}) USING (date, ticker)", "change_pct")
def _(t):
    ranked = N.rank_cross_section(N.carry_forward(snap(t)))
    return N.overview_series(ranked).select("date", "ticker", "window_ms", "change_pct")


@query("K16_latest_top", _LATEST, "change_pct price")
def _(t):
    ranked = N.rank_cross_section(N.carry_forward(snap(t)))
    return N.latest_top(ranked).select("date", "ticker", "window_ms", "change_pct", "price", "rank")


@query(
    "K17_bulk_enrichment",
    f"""SELECT s.date, s.ticker, s.window_ms, {_RANK.replace('date,', 's.date,').replace('window_ms ORDER', 's.window_ms ORDER').replace(', ticker)', ', s.ticker)')} AS rank, relative_volume_5min,
      CASE WHEN prev_volume > 0 THEN s.volume / prev_volume ELSE 1 END AS relative_volume_daily,
      (bid * ask_size + ask * bid_size) / nullif(bid_size + ask_size, 0) AS weighted_mid
    FROM snap s JOIN recent_volume r ON s.date = r.date AND s.ticker = r.ticker AND s.window_ms = r.window_ms""",
    "relative_volume_5min relative_volume_daily weighted_mid",
)
def _(t):
    return N.enrich_bulk(snap(t), WIN).select("date", "ticker", "window_ms", "rank", "relative_volume_5min", "relative_volume_daily", "weighted_mid")


@query("F5_common_stock_universe", "SELECT ticker, type, sector FROM universe")
def _(t):
    return N.common_stocks(t.profiles(), "2024-01-10").select("ticker", "type", "sector")


_FILTERED = """SELECT date, ticker, first_entry_ms, gain_at_entry, price_at_entry, volume_at_entry, relative_volume,
  coalesce(max_gain, 0) AS max_gain, coalesce(CAST(peak_volume AS DOUBLE), 0) AS peak_volume, coalesce(prev_close, 0) AS prev_close
  FROM subs LEFT JOIN peaks USING (date, ticker) ANTI JOIN initial_top USING (date, ticker)
  WHERE gain_at_entry >= 2 AND price_at_entry >= 21 AND price_at_entry <= 60 AND volume_at_entry >= 10 AND relative_volume >= 0.2"""
fragment("candidates", _FILTERED)


def candidates(t):
    return N.find_candidates(snap(t), N.CandidateFilter(2.0, 21.0, 60.0, 10.0, 0.2))


@query("F8_candidate_filters", "SELECT * FROM candidates", SUB_F + " max_gain peak_volume prev_close")
def _(t):
    return candidates(t)


@query(
    "F12_snapshot_schema_report",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', FALSE, {'TRUE' if c == 'volume' else 'FALSE'}, (SELECT count(*) FROM snap WHERE {c} IS NULL))" for c in N.SNAPSHOT_SCHEMA)
    + ') v("column", missing, wrong_type, nulls)',
)
def _(t):
    return N.schema_report(snap(t))


@query("F12_snapshot_schema_enforced", "SELECT date, ticker, window_ms, CAST(volume AS DOUBLE) AS volume FROM snap", "volume")
def _(t):
    return N.enforce_schema(snap(t)).select("date", "ticker", "window_ms", "volume")


def subs_of(t):
    return N.subscriptions(N.carry_forward(snap(t)))
