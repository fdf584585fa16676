"""Streaming jobs run to the end of the available input; what they append is returned as a table."""

from pyspark.sql import functions as F

from tapewright.functions import session as S
from tapewright.operators import bars as A, ticks as K
from tapewright.plans.ctes import bars_sql, fragment
from tapewright.plans.q_bars import FACTOR_SQL, hour_bars
from tapewright.plans.q_events import ENTRY, STATES_SQL, activity_points, event_table, news as catalyst_news
from tapewright.plans.q_news import DEDUP_SQL, news
from tapewright.plans.q_snapshots import daily, snap, windows
from tapewright.plans.registry import query
from tapewright.sources.canonical import Tables
from tapewright.sources.lake import work_dir
from tapewright.streaming import bars as B, factors as FX, news as NX, signals as GX, snapshots as SX
from tapewright.streaming.run import append_files, drain_files, in_stages, read_upserts, stream_parquet, upsert_files

H = 3_600_000
CUT = 1_705_300_123_456
BAR = ["ticker", "bar_start", "open", "high", "low", "close", "volume", "trade_count", "vwap"]
BAR_F = "open high low close vwap"
BAR_SQL = ", ".join(BAR)
fragment("half_hour_bars", bars_sql("clean", 1_800_000))


class StreamTables(Tables):
    """The same views over a stream of the event files."""

    def read(self, name):
        return stream_parquet(self.spark, self.dir, self.spark.read.parquet(f"{self.dir}/{name}.parquet"), f"{name}.parquet")


class WrittenTrades(Tables):
    """The same views over the per-user trades written once; each of them would parse all events anew."""

    def __init__(self, t, path):
        super().__init__(t.spark, t.dir)
        self.path = f"{path}/trades"
        t.wide_trades().write.parquet(self.path)

    def trades(self, ticker="event_type", start_ms=None, end_ms=None):
        if ticker == "user" and start_ms is None and end_ms is None:
            return self.spark.read.parquet(self.path)
        return super().trades(ticker, start_ms, end_ms)


def live_trades(t):
    return K.drop_delayed(StreamTables(t.spark, t.dir).trades())


# A bar is emitted when its end (UTC) is at most the newest event minus 200 ms; bar times are Eastern, so compare in Eastern.
_CLOSED = "bar_end < (SELECT max(et_ms) FROM clean WHERE et_ms % 86400000 >= 14400000 AND et_ms % 86400000 < 72000000) - 200 + 1"


@query("W1_watermarked_bars", f"SELECT {BAR_SQL} FROM half_hour_bars WHERE {_CLOSED}", BAR_F)
def _(t):
    path = work_dir(t.spark)
    append_files(B.window_bars(live_trades(t), "30m"), path)
    return t.spark.read.parquet(f"{path}/data").select(*BAR)


@query("W2_idle_close", f"SELECT {BAR_SQL} FROM bars", BAR_F)
def _(t):
    path = work_dir(t.spark)
    # All input is drained; the bars still open then, which a running stream closes by the clock, are flushed.
    drain_files(B.keyed_bars(live_trades(t), "1h"), path)
    return t.spark.read.parquet(f"{path}/data").select(*BAR).unionByName(B.open_bars(t.spark, path).select(*BAR))


fragment(
    "on_time_feed",
    f"""SELECT * FROM clean c WHERE exchange <> 3 OR ts_ms // 1800000 * 1800000 + 1800000 > (
      SELECT max(ts_ms) FROM clean WHERE exchange <> 3 AND ts_ms <= {CUT} AND et_ms % 86400000 >= 14400000 AND et_ms % 86400000 < 72000000) - 200""",
)
fragment("on_time_bars", bars_sql("on_time_feed", 1_800_000))


@query("W3_late_trades_dropped", f"SELECT {BAR_SQL} FROM on_time_bars WHERE {_CLOSED}", BAR_F)
def _(t):
    # One exchange delivers everything after the first stage. Late rows are judged by the watermark that the
    # stage before left, which stands at its newest trade.
    tr = K.drop_delayed(t.trades())
    early = (F.col("exchange") != 3) & (F.col("ts_ms") <= CUT)
    path = work_dir(t.spark)
    in_stages(t.spark, [tr.filter(early), tr.filter(~early)], path, lambda live: append_files(B.window_bars(live, "30m"), path))
    return t.spark.read.parquet(f"{path}/data").select(*BAR)


@query("W4_session_flush", f"SELECT {BAR_SQL} FROM half_hour_bars", BAR_F)
def _(t):
    # Update mode keeps the open bars' current values as well, which is what a flush returns.
    path = work_dir(t.spark)
    upsert_files(B.window_bars(live_trades(t), "30m"), path)
    return read_upserts(t.spark, path, ["ticker", "bar_start"]).select(*BAR)


@query("W5_history_live_seam", f"SELECT {BAR_SQL} FROM half_hour_bars", BAR_F)
def _(t):
    path = work_dir(t.spark)
    history = A.trade_partials(K.drop_delayed(t.trades()).filter(F.col("ts_ms") <= CUT), "30m")
    upsert_files(B.window_partials(live_trades(t).filter(F.col("ts_ms") > CUT), "30m"), path)
    live = read_upserts(t.spark, path, ["ticker", "bar_start"])
    return B.seam_merge(history, live, "30m").select(*BAR)


@query(
    "W6_live_trade_rate",
    f"""SELECT ticker, ts_ms, count(*) AS n, CASE WHEN count(*) >= 5 THEN count(*) / {6 * H / 1000} END AS trade_rate FROM (
      SELECT ticker, unnest(range(ts_ms // {H} * {H} + {H}, ts_ms // {H} * {H} + {7 * H}, {H})) AS ts_ms FROM clean) WHERE ts_ms <= (SELECT max(ts_ms) FROM clean) - 200 GROUP BY 1, 2""",
    "trade_rate",
)
def _(t):
    path = work_dir(t.spark)
    append_files(FX.sliding_trade_rate(live_trades(t), 6 * H, H), path)
    return t.spark.read.parquet(f"{path}/data")


_EMA = "list_reduce(c, lambda a, x: CAST(2 AS DOUBLE) / 21 * x + (1 - CAST(2 AS DOUBLE) / 21) * a)"
_CLOSE_SQL = f"""SELECT ticker, bar_start, {', '.join(f'{FACTOR_SQL[n]} AS {n}' for n in FACTOR_SQL)}, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY bar_start) >= 20 THEN {_EMA} END AS ema
  FROM (SELECT *, list(close) OVER (PARTITION BY ticker ORDER BY bar_start) AS c FROM bars)"""


@query("W7_bar_close_factors", _CLOSE_SQL, "relative_volume price_direction gap_percent volume_acceleration vwap_deviation ema")
def _(t):
    path = work_dir(t.spark)
    in_stages(t.spark, [hour_bars(t)], path, lambda live: append_files(FX.bar_close_factors(live), path))
    return t.spark.read.parquet(f"{path}/data")


@query("W8_warmup_then_live", _CLOSE_SQL, "relative_volume price_direction gap_percent volume_acceleration vwap_deviation ema")
def _(t):
    # History first, then live bars that overlap it by a day: the overlap is ignored.
    b = hour_bars(t)
    cut = S.to_et_ms(F.lit(CUT))
    path = work_dir(t.spark)
    parts = [b.filter(F.col("bar_start") <= cut), b.filter(F.col("bar_start") > cut - S.DAY_MS)]
    in_stages(t.spark, parts, path, lambda live: append_files(FX.bar_close_factors(live), path))
    return t.spark.read.parquet(f"{path}/data")


def live_snapshots(t):
    path, w = work_dir(t.spark), F.col("window_ms")
    # The daily rows give both the calendar and the previous closes, so they are written too.
    tw = WrittenTrades(t, path)
    daily(tw).write.parquet(f"{path}/daily")
    # The stages are cut from one written snapshot; each would compute it anew.
    snap(tw, t.spark.read.parquet(f"{path}/daily")).write.parquet(f"{path}/snapshots")
    s = t.spark.read.parquet(f"{path}/snapshots")
    parts = [s.filter(w <= CUT - 10 * S.DAY_MS), s.filter((w > CUT - 10 * S.DAY_MS) & (w <= CUT)), s.filter(w > CUT)]
    in_stages(t.spark, parts, path, lambda live: SX.process_stream(t.spark, live, path))
    return path


@query("W9_live_snapshot_ranks", "SELECT date, ticker, window_ms, rank, change_pct FROM ranked_filled", "change_pct")
def _(t):
    return t.spark.read.parquet(f"{live_snapshots(t)}/ranked").select("date", "ticker", "window_ms", "rank", "change_pct")


@query("W9_live_subscriptions", "SELECT date, ticker, first_entry_ms FROM subs")
def _(t):
    return t.spark.read.parquet(f"{live_snapshots(t)}/entries").select("date", "ticker", "first_entry_ms")


@query(
    "W10_live_signals",
    f"""SELECT rule, ticker, ts_ms FROM (
      WITH RECURSIVE chain AS (SELECT rule, ticker, min(ts_ms) AS ts_ms FROM rule_matches GROUP BY 1, 2
        UNION ALL SELECT c.rule, c.ticker, min(m.ts_ms) FROM chain c JOIN rule_matches m ON m.rule = c.rule AND m.ticker = c.ticker AND m.ts_ms >= c.ts_ms + {5 * H} GROUP BY c.rule, c.ticker, c.ts_ms)
      SELECT * FROM chain)""",
)
def _(t):
    e = event_table(t)
    path = work_dir(t.spark)
    in_stages(t.spark, [e.filter(F.col("ts_ms") <= CUT), e.filter(F.col("ts_ms") > CUT)], path, lambda live: append_files(GX.signals_with_cooldown(live, ENTRY, 5 * H), path))
    return t.spark.read.parquet(f"{path}/data")


@query("W10_live_activity_states", STATES_SQL)
def _(t):
    # The factors arrive in two stages; the state of each ticker lasts from one to the next.
    z = activity_points(t).select("ticker", "ts_ms", "z", "accel")
    path = work_dir(t.spark)
    in_stages(t.spark, [z.filter(F.col("ts_ms") <= CUT), z.filter(F.col("ts_ms") > CUT)], path, lambda live: append_files(GX.activity_stream(live, 1.0, 2 * H), path))
    return t.spark.read.parquet(f"{path}/data")


@query("W11_news_dedup_stream", DEDUP_SQL)
def _(t):
    # Three stages in the order of arrival; together they keep what one pass over all articles keeps.
    n = news(t).select("doc_id", "symbol", "published_ms", "title", "url").withColumn("order", F.col("doc_id"))
    path, third = work_dir(t.spark), F.floor(F.col("order") / 400)
    in_stages(t.spark, [n.filter(third == 0), n.filter(third == 1), n.filter(third > 1)], path, lambda live: NX.dedup_stream(t.spark, live, path))
    return t.spark.read.parquet(f"{path}/kept").select("doc_id", "url_id", "title_fp")


@query(
    "W12_catalyst_stream",
    """SELECT obs_id, c.ticker, c.ts_ms, m.price, m.window_ms, p.float_shares, p.sector FROM catalysts c
    LEFT JOIN (SELECT ticker, max(window_ms) AS window_ms, arg_max(price, window_ms) AS price FROM tw GROUP BY 1) m USING (ticker) LEFT JOIN profiles p USING (ticker)""",
    "price float_shares",
)
def _(t):
    latest = windows(t).groupBy("ticker").agg(F.max("window_ms").alias("window_ms"), F.max_by("price", "window_ms").alias("price"))
    path = work_dir(t.spark)
    in_stages(t.spark, [catalyst_news(t)], path, lambda live: append_files(GX.catalyst_stream(live, latest, t.profiles()), path))
    return t.spark.read.parquet(f"{path}/data").select("obs_id", "ticker", "ts_ms", "price", "window_ms", "float_shares", "sector")
