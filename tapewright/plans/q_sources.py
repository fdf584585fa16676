"""Scans, loads, latest-version reads, incremental writes and log parsing over the given tables."""

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tapewright.functions import session as S
from tapewright.operators import tick_factors as T, ticks as K
from tapewright.operators.snapshots import drop_low_volume
from tapewright.plans.ctes import fragment
from tapewright.plans.q_bars import hour_bars
from tapewright.plans.q_snapshots import candidates as snap_candidates, daily, subs_of
from tapewright.plans.q_ticks import trade_table
from tapewright.plans.registry import query
from tapewright.sources import lake as L, observations as O

_DATE = "DATE '1970-01-01' + CAST(et_ms // 86400000 AS INTEGER)"


def _day(ticks):
    return ticks.withColumn("date", S.et_date(S.to_et_ms("ts_ms")))


def dated(t, ticker="user", start_ms=None, end_ms=None):
    return _day(t.trades(ticker, start_ms, end_ms))


def et_midnight(day: str) -> int:
    """UTC milliseconds at which a day begins in the market's zone."""
    return int(datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(S.MARKET_ZONE)).timestamp() * 1000)


@query(
    "S1_csv_to_parquet",
    """SELECT ticker, CAST(volume AS BIGINT) AS volume, CAST(open AS FLOAT) AS open, CAST(close AS FLOAT) AS close, CAST(high AS FLOAT) AS high, CAST(low AS FLOAT) AS low,
    bar_start * 1000000 AS window_start, CAST(trade_count AS BIGINT) AS transactions, 'x' AS venue FROM bars""",
)
def _(t):
    # Minute aggregates as gzipped CSV with decimal volumes, converted to the typed layout and read back.
    base = L.work_dir(t.spark)
    cols = ["ticker", "volume", "open", "close", "high", "low", "window_start", "transactions", "venue"]
    agg = hour_bars(t).select("ticker", (F.col("volume") + 0.4).alias("volume"), "open", "close", "high", "low", (F.col("bar_start") * 1_000_000).alias("window_start"), F.col("trade_count").alias("transactions"), F.lit("x").alias("venue"))
    agg.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{base}/csv")
    L.convert_csv(t.spark, f"{base}/csv", f"{base}/parquet", "minute_aggs_v1", cols)
    return t.spark.read.parquet(f"{base}/parquet")


@query("S3_date_range_scan", f"SELECT seq, ticker, price, size FROM wide_trades WHERE {_DATE} BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'", "price")
def _(t):
    d = dated(t, "user", et_midnight("2024-01-08"), et_midnight("2024-01-13") - 1)
    return d.filter(F.col("date").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-12").cast("date"))).select("seq", "ticker", "price", "size")


A, B = 1_704_700_000_000, 1_705_900_000_000


@query("S4_symbol_scan", f"SELECT seq, ts_ms, price, size FROM clean WHERE ticker = 'click' AND ts_ms BETWEEN {A} AND {B}", "price")
def _(t):
    return L.load_trades(t.trades("event_type", A, B), ["click"], A, B).select("seq", "ts_ms", "price", "size")


@query("S5_multi_symbol_scan", f"SELECT ticker, seq, ts_ms, price FROM clean WHERE ticker IN ('click', 'view', 'error') AND ts_ms BETWEEN {A} AND {B}", "price")
def _(t):
    return L.load_trades(t.trades("event_type", A, B), ["click", "view", "error"], A, B).select("ticker", "seq", "ts_ms", "price")


@query("S5_multi_symbol_quotes", f"SELECT ticker, seq, ts_ms, bid, ask, bid_size, ask_size FROM quotes WHERE ticker IN ('click', 'view', 'error') AND ts_ms BETWEEN {A} AND {B}", "bid ask")
def _(t):
    return L.load_trades(t.quotes("event_type", A, B), ["click", "view", "error"], A, B, clean=False).select("ticker", "seq", "ts_ms", "bid", "ask", "bid_size", "ask_size")


@query("S6_candidate_load", f"SELECT w.seq, w.ticker, w.ts_ms, w.price FROM wide_clean w SEMI JOIN candidates c ON c.ticker = w.ticker AND c.date = {_DATE.replace('et_ms', 'w.et_ms')}", "price")
def _(t):
    return L.load_for_candidates(K.drop_delayed(dated(t)), snap_candidates(t)).select("seq", "ticker", "ts_ms", "price")


@query("S6_candidate_quotes", f"SELECT q.seq, q.ticker, q.ts_ms, q.bid, q.ask FROM wide_quotes q SEMI JOIN candidates c ON c.ticker = q.ticker AND c.date = {_DATE.replace('et_ms', 'q.et_ms')}", "bid ask")
def _(t):
    return L.load_for_candidates(_day(t.quotes("user")), snap_candidates(t)).select("seq", "ticker", "ts_ms", "bid", "ask")


@query(
    "S6_candidate_bars",
    f"SELECT b.ticker, b.bar_start, b.open, b.close, b.volume FROM wide_bars b SEMI JOIN candidates c ON c.ticker = b.ticker AND c.date = {_DATE.replace('et_ms', 'b.bar_start')}",
    "open close",
)
def _(t):
    b = hour_bars(t, "user").withColumn("date", S.et_date("bar_start"))
    return L.load_for_candidates(b, snap_candidates(t)).select("ticker", "bar_start", "open", "close", "volume")


@query("S8_subscribed_quote_import", f"SELECT q.seq, q.ticker, q.ts_ms, q.bid, q.ask FROM wide_quotes q SEMI JOIN subs s ON s.ticker = q.ticker AND s.date = {_DATE.replace('et_ms', 'q.et_ms')}", "bid ask")
def _(t):
    return L.load_for_candidates(_day(t.quotes("user")), subs_of(t)).select("seq", "ticker", "ts_ms", "bid", "ask")


@query("S7_per_ticker_files", f"SELECT ticker, count(*) AS n, min({_DATE}) AS first_date, max({_DATE}) AS last_date FROM trades GROUP BY 1")
def _(t):
    base = L.work_dir(t.spark)
    L.write_by_ticker(dated(t, "event_type"), base)
    return t.spark.read.parquet(base).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("S8_subscribed_tick_import", f"SELECT w.seq, w.ticker, w.ts_ms, coalesce(w.size, 0) AS size FROM wide_trades w SEMI JOIN subs s ON s.ticker = w.ticker AND s.date = {_DATE.replace('et_ms', 'w.et_ms')}")
def _(t):
    return L.fill_nulls(L.load_for_candidates(dated(t), subs_of(t)), ["size"]).select("seq", "ticker", "ts_ms", "size")


@query("S9_day_rebuild", f"SELECT {_DATE} AS date, count(*) AS n FROM wide_trades GROUP BY 1")
def _(t):
    # Writing a day twice leaves it once: only the partitions present in the second write are replaced.
    base = L.work_dir(t.spark)
    d = dated(t)
    L.write_by_date(d, base)
    L.write_by_date(d.filter(F.col("date") == F.lit("2024-01-10").cast("date")), base)
    return t.spark.read.parquet(base).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S10_factor_writer",
    f"""SELECT ticker, ts_ms, factor, value FROM (SELECT *, epoch_us(timezone('America/New_York', timezone('UTC', make_timestamp(ts_ms * 1000)))) // 1000 AS et_ms FROM (
      UNPIVOT (SELECT ticker, ts_ms, trade_rate, large_trade_ratio, aggressor_ratio FROM trade_factor_table) ON trade_rate, large_trade_ratio, aggressor_ratio INTO NAME factor VALUE value))
    WHERE {_DATE} BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    "value",
)
def _(t):
    base = L.work_dir(t.spark)
    long = T.to_long(trade_table(t), ["trade_rate", "large_trade_ratio", "aggressor_ratio"])
    L.write_by_date(long.withColumn("date", S.et_date(S.to_et_ms("ts_ms"))), base, order=("ticker", "factor", "ts_ms"))
    return L.scan(t.spark, base, "2024-01-05", "2024-01-20", ["ticker", "ts_ms", "factor", "value"])


@query(
    "S11_latest_version",
    """SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "value",
)
def _(t):
    e = t.read("events").select("user_id", "event_type", "value", "event_id", "ts")
    return L.latest_version(e, ["user_id", "event_type"], "ts", ["event_id"]).drop("ts")


BA, BB = 1_704_700_800_000, 1_705_300_000_000


@query("S12_bar_range", f"SELECT bar_start, open, close, volume FROM bars WHERE ticker = 'view' AND bar_start BETWEEN {BA} AND {BB} ORDER BY bar_start LIMIT 50", "open close")
def _(t):
    return L.query_bars(hour_bars(t), "view", BA, BB, 50).select("bar_start", "open", "close", "volume")


@query("S12_last_bars", "SELECT ticker, max(bar_start) AS last_bar_start FROM wide_bars GROUP BY 1")
def _(t):
    return L.last_bars(hour_bars(t, "user"))


@query("S12_tickers_with_bars", f"SELECT DISTINCT ticker FROM wide_bars WHERE bar_start >= {BA} AND bar_start < {BA + 86_400_000}")
def _(t):
    return L.tickers_with_bars(hour_bars(t, "user"), BA, BA + 86_400_000)


@query("S13_factor_history", f"SELECT ticker, ts_ms, 'trade_rate' AS factor, trade_rate AS value FROM trade_factor_table WHERE ticker = 'error' AND trade_rate IS NOT NULL AND ts_ms BETWEEN {A} AND {B}", "value")
def _(t):
    return L.query_factors(T.to_long(trade_table(t, ("trade_rate",)), ["trade_rate"]), "error", "trade_rate", A, B)


@query("S14_log_records", "SELECT symbol, trigger_ms, verdict = 'YES' AS is_catalyst, CAST(score AS INTEGER) AS score_num, CASE WHEN obs_id % 7 = 0 THEN 'unknown' ELSE source END AS source_from, 'u/' || CAST(obs_id AS VARCHAR) AS url FROM observations")
def _(t):
    # The observations written as multi-line log records, then parsed back.
    base = L.work_dir(t.spark)
    iso = F.date_format(F.timestamp_millis("trigger_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mark = F.when(F.col("verdict") == "YES", "✅").otherwise("❌")
    lines = F.concat(
        F.lit("model: m1\n"), F.lower("symbol"), F.lit(" "), mark, F.lit(" "), F.col("score").cast("string"), F.lit("/10\nTitle: about "), F.col("lang"),
        F.lit("\nCurrent Time: "), iso, F.lit("\nUrl: u/"), F.col("obs_id").cast("string"), F.when(F.col("obs_id") % 7 == 0, "").otherwise(F.concat(F.lit("\nSource From: "), "source")), F.lit("\nContent: text"),
    )
    t.observations().select(lines.alias("value")).write.mode("overwrite").text(base)
    return O.parse_log(t.spark, base).select("symbol", F.unix_millis("trigger_time").alias("trigger_ms"), "is_catalyst", "score_num", "source_from", "url")


_OD = "CAST(make_timestamp(trigger_ms * 1000) AS DATE)"


def classified(t):
    return t.observations().withColumn("date", F.to_date(F.timestamp_millis("trigger_ms")))


@query("S15_classifier_observations", f"SELECT obs_id, symbol, trigger_ms, CAST(score AS VARCHAR) AS score_num, CASE WHEN verdict = 'YES' THEN 'true' ELSE 'false' END AS is_catalyst, source AS source_from FROM observations WHERE {_OD} BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(t):
    o = O.classifier_table(classified(t), "2024-01-05", "2024-01-20")
    return o.select("obs_id", "symbol", "trigger_ms", *[F.col("metadata")[k].alias(k) for k in ("score_num", "is_catalyst", "source_from")])


@query("F10_metadata_filter", f"SELECT obs_id, symbol FROM observations WHERE {_OD} BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND verdict = 'YES' AND score = 7")
def _(t):
    return O.where_metadata(O.classifier_table(classified(t), "2024-01-01", "2024-01-31"), is_catalyst="true", score_num=7).select("obs_id", "symbol")


@query("S16_sample_export", "SELECT f AS format, count(*) AS n, sum(quantity) AS quantity FROM samples, (VALUES ('parquet'), ('csv'), ('json')) AS v(f) GROUP BY 1", "quantity")
def _(t):
    base = L.work_dir(t.spark)
    s = t.samples().select("sample_id", "symbol", "quantity", "ret")
    out = None
    for fmt in ("parquet", "csv", "json"):
        L.export(s, f"{base}/{fmt}", fmt)
        r = t.spark.read.format(fmt).schema(s.schema).option("header", True).load(f"{base}/{fmt}")
        part = r.agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")).select(F.lit(fmt).alias("format"), "n", "quantity")
        out = part if out is None else out.unionByName(part)
    return out


@query("S17_incremental_dates", "SELECT date, count(*) AS n FROM samples WHERE date NOT IN (SELECT date FROM samples WHERE linenumber = 1 AND quantity > 45) GROUP BY 1")
def _(t):
    s = t.samples()
    return L.absent_dates(s, s.filter("linenumber = 1 AND quantity > 45")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


fragment("trade_days", "SELECT ticker, date, turnover, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS gap FROM daily")


@query(
    "F6_low_volume_exclusion",
    "SELECT d.ticker, d.date, d.volume FROM daily d ANTI JOIN (SELECT ticker FROM trade_days GROUP BY 1 HAVING max(gap) > 4 OR avg(turnover) < 1900) x USING (ticker)",
)
def _(t):
    return drop_low_volume(daily(t), 4, 1900.0).select("ticker", "date", "volume")


@query("U3_observation_source", f"SELECT {_OD} AS date, count(*) AS n FROM observations WHERE {_OD} BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1")
def _(t):
    o = O.classifier_table(classified(t), "2024-01-01", "2024-01-31")
    return o.groupBy(F.to_date(F.timestamp_millis("trigger_ms")).alias("date")).agg(F.count(F.lit(1)).alias("n"))
