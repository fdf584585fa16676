"""Bars, bar predicates and bar factors over trades derived from the events table."""

from pyspark.sql import Window, functions as F

from tapewright.functions import session as S
from tapewright.functions.calendar import with_calendar
from tapewright.operators import bar_factors as B, bars as A, ticks as K
from tapewright.plans.ctes import bar_start_sql, bars_sql, fragment, next_boundary_sql, session_sql
from tapewright.plans.registry import query

HOUR = 3_600_000
OHLC = "open high low close"


def hour_bars(t, ticker="event_type"):
    return A.trades_to_bars(K.drop_delayed(t.trades(ticker)), "1h")


def minute_bars(t):
    return A.trades_to_bars(K.drop_delayed(t.trades()), "1m")


def daily_bars(t):
    return A.trades_to_bars(K.drop_delayed(t.wide_trades()), "1d")


@query("F1_delayed_report_filter", "SELECT ticker, seq, ts_ms, price, size, exchange FROM clean", "price")
def _(t):
    return K.drop_delayed(t.trades()).select("ticker", "seq", "ts_ms", "price", "size", "exchange")


@query("F2_session", f"SELECT ticker, {session_sql('et_ms')} AS session, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM trades GROUP BY ALL")
def _(t):
    return (
        t.trades().withColumn("session", S.classify_session(S.to_et_ms("ts_ms")))
        .groupBy("ticker", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
    )


@query(
    "F3_session_phase",
    """SELECT seq, CASE WHEN et_ms % 86400000 < 25200000 THEN 'early' WHEN et_ms % 86400000 < 32400000 THEN 'mid'
    ELSE 'late' END AS phase FROM trades""",
)
def _(t):
    return t.trades().select("seq", S.session_phase(S.to_et_ms("ts_ms")).alias("phase"))


@query("F4_closed_hours", "SELECT seq, et_ms FROM trades WHERE et_ms % 86400000 < 14400000 OR et_ms % 86400000 >= 72000000")
def _(t):
    return t.trades().select("seq", S.to_et_ms("ts_ms").alias("et_ms")).filter(S.is_closed("et_ms"))


@query("F11_valid_quotes", "SELECT ticker, seq, bid, ask FROM quotes WHERE bid > 0 AND ask > 0 AND ask > bid", "bid ask")
def _(t):
    return t.quotes().filter(K.valid_quote(strict=True)).select("ticker", "seq", "bid", "ask")


@query("F13_bar_invariants", """SELECT ticker, bar_start, high >= greatest(open, close, low) AS high_ok,
  low <= least(open, close, high) AS low_ok, volume >= 0 AND trade_count >= 0 AS volume_ok FROM bars""")
def _(t):
    return A.bar_invariants(hour_bars(t)).select("ticker", "bar_start", "high_ok", "low_ok", "volume_ok")


@query(
    "F14_bar_shape",
    """SELECT ticker, bar_start, high - low AS range, abs(close - open) AS body, close > open AS bullish,
    close < open AS bearish, high = low OR abs(close - open) < (high - low) * CAST(0.1 AS DOUBLE) AS doji FROM bars""",
    "range body",
)
def _(t):
    return A.bar_shape(hour_bars(t)).select("ticker", "bar_start", "range", "body", "bullish", "bearish", "doji")


@query("F15_quote_derived", "SELECT ticker, seq, ask - bid AS spread, (bid + ask) / 2 AS mid FROM quotes", "spread mid")
def _(t):
    return K.quote_derived(t.quotes()).select("ticker", "seq", "spread", "mid")


_TFS = {"10s": 10_000, "1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000}


def _slot_sql():
    parts = []
    for tf, ms in _TFS.items():
        s = bar_start_sql("et_ms", ms)
        parts.append(f"{s} AS start_{tf}, least({s} + {ms}, {next_boundary_sql(s)}) AS end_{tf}")
    day, week = "et_ms - et_ms % 86400000", "et_ms - (et_ms - 345600000) % 604800000"
    parts += [f"{day} AS start_1d, {day} + 86400000 AS end_1d", f"{week} AS start_1w, {week} + 604800000 AS end_1w"]
    return f"SELECT seq, {', '.join(parts)} FROM trades"


@query("A1_bar_slots", _slot_sql())
def _(t):
    d = t.trades().select("seq", S.to_et_ms("ts_ms").alias("et"))
    cols = []
    for tf in S.TIMEFRAME_MS:
        start = S.bar_start("et", tf)
        cols += [start.alias(f"start_{tf}")]
    d = d.select("seq", *cols)
    return d.select("*", *[S.bar_end(f"start_{tf}", tf).alias(f"end_{tf}") for tf in S.TIMEFRAME_MS])


BAR_COLS = ["ticker", "bar_start", "bar_end", "session", "open", "high", "low", "close", "volume", "trade_count", "vwap"]


@query("A2_trades_to_bars", f"SELECT {', '.join(BAR_COLS)} FROM bars", OHLC + " vwap")
def _(t):
    return hour_bars(t).select(*BAR_COLS)


@query("A2_trades_to_minute_bars", f"SELECT {', '.join(BAR_COLS)} FROM minute_bars", OHLC + " vwap")
def _(t):
    return minute_bars(t).select(*BAR_COLS)


fragment(
    "session_slots",
    """SELECT s AS off FROM (SELECT unnest(range(14400000, 34200000, 3600000)) AS s
    UNION ALL SELECT unnest(range(34200000, 57600000, 3600000)) UNION ALL SELECT unnest(range(57600000, 72000000, 3600000)))""",
)
fragment("bar_days", "SELECT unnest(range((SELECT min(bar_start) // 86400000 FROM bars), (SELECT max(bar_start) // 86400000 + 1 FROM bars))) * 86400000 AS day_ms")


@query(
    "A3_session_gap_fill",
    f"""SELECT ticker, bar_start, open, high, low, close, volume, trade_count, bar_end, session, vwap, FALSE AS filled FROM bars
    UNION ALL
    SELECT b.ticker, day_ms + off, b.close, b.close, b.close, b.close, 0, 0,
      least(day_ms + off + 3600000, {next_boundary_sql('day_ms + off')}), {session_sql('day_ms + off')}, b.close, TRUE
    FROM (SELECT *, lead(bar_start) OVER (PARTITION BY ticker ORDER BY bar_start) AS nxt FROM bars) b
    JOIN bar_days ON day_ms BETWEEN b.bar_end - b.bar_end % 86400000 AND b.nxt
    JOIN session_slots ON day_ms + off >= b.bar_end AND day_ms + off < b.nxt""",
    OHLC + " vwap",
)
def _(t):
    return A.fill_session_gaps(hour_bars(t), "1h")


@query("A4_partial_bar_merge", f"SELECT {', '.join(BAR_COLS)} FROM bars", OHLC + " vwap")
def _(t):
    # Two feeds each deliver their own part of a bar; merging the parts must give the whole bar.
    trades = K.drop_delayed(t.trades())
    late = S.to_et_ms("ts_ms") - S.bar_start(S.to_et_ms("ts_ms"), "1h") >= HOUR // 2
    first, second = (A.trade_partials(trades.filter(c), "1h") for c in (~late, late))
    return A.finish_bars(A.merge_partials(first.unionByName(second)), "1h").select(*BAR_COLS)


@query(
    "A5_fixed_interval_bars",
    """SELECT ticker, slot AS time_ms, open, high, low, close, CASE WHEN slot = time_ms THEN volume ELSE 0 END AS volume FROM (
      SELECT *, unnest(range(time_ms, coalesce(nxt, time_ms + 1800000), 1800000)) AS slot FROM (
        SELECT *, lead(time_ms) OVER (PARTITION BY ticker ORDER BY time_ms) AS nxt FROM (
          SELECT ticker, ts_ms // 1800000 * 1800000 AS time_ms, arg_min(price, (ts_ms, seq)) AS open, max(price) AS high,
            min(price) AS low, arg_max(price, (ts_ms, seq)) AS close, CAST(sum(size) AS BIGINT) AS volume
          FROM clean GROUP BY 1, 2)))""",
    OHLC,
)
def _(t):
    return A.fixed_bars(K.drop_delayed(t.trades()), 1_800_000)


fragment(
    "resampled",
    f"""SELECT ticker, {bar_start_sql('bar_start', 14400000)} AS slot, arg_min(open, bar_start) AS open, max(high) AS high,
    min(low) AS low, arg_max(close, bar_start) AS close, CAST(sum(volume) AS BIGINT) AS volume,
    CAST(sum(trade_count) AS BIGINT) AS trade_count FROM minute_bars GROUP BY 1, 2""",
)


@query("A6_session_resample", "SELECT ticker, slot AS bar_start, open, high, low, close, volume, trade_count FROM resampled", OHLC)
def _(t):
    return A.resample_bars(minute_bars(t), "4h").select("ticker", "bar_start", "open", "high", "low", "close", "volume", "trade_count")


for _unit in ("week", "month"):

    @query(
        f"A7_calendar_resample_{_unit}",
        f"""SELECT ticker, CAST(date_trunc('{_unit}', make_timestamp(bar_start * 1000)) AS DATE) AS period,
        arg_min(open, bar_start) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_start) AS close,
        CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM daily_bars GROUP BY 1, 2""",
        OHLC,
    )
    def _(t, unit=_unit):
        return A.resample_calendar(daily_bars(t), unit)


def market_days(t):
    """The market calendar of every day from the first to the last event."""
    e = t.read("events").select(F.to_date("ts").alias("d"))
    days = e.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    return with_calendar(days, "date")


fragment(
    "market_days",
    """SELECT d AS date, isodow(d) < 6 AND d NOT IN (DATE '2024-01-01', DATE '2024-01-15') AS trading_day,
    datediff('day', DATE '1970-01-01', d) * 86400000 AS day_ms, 57600000 AS close_ms FROM (
    SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS d FROM events)""",
)
fragment(
    "grid",
    """SELECT ticker, day_ms + m * 60000 AS bar_start FROM (
      SELECT ticker, min(bar_start) // 86400000 * 86400000 AS a, max(bar_start) // 86400000 * 86400000 AS b FROM minute_bars GROUP BY 1)
    JOIN market_days ON day_ms BETWEEN a AND b AND trading_day, (SELECT unnest(range(570, 960)) AS m)""",
)


@query("A9_timestamp_grid", "SELECT ticker, bar_start FROM grid")
def _(t):
    return A.minute_grid(minute_bars(t), market_days(t).filter("trading_day"))


@query(
    "A10_grid_forward_fill",
    """SELECT ticker, bar_start, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close,
      coalesce(volume, 0) AS volume, coalesce(trade_count, 0) AS trade_count FROM (
      SELECT g.ticker, g.bar_start, open, high, low, volume, trade_count,
        last_value(close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.bar_start) AS c
      FROM grid g LEFT JOIN minute_bars m ON m.ticker = g.ticker AND m.bar_start = g.bar_start)""",
    OHLC,
)
def _(t):
    m = minute_bars(t)
    return A.fill_onto_grid(A.minute_grid(m, market_days(t).filter("trading_day")), m)


@query(
    "A11_chart_gap_fill",
    """SELECT ticker, bar_start, open, high, low, close, volume FROM minute_bars UNION ALL
    SELECT ticker, bar_start + j * 60000, close, close, close, close, 0 FROM (
      SELECT *, unnest(range(1, least((nxt - bar_start) // 60000 - 1, 60) + 1)) AS j FROM (
        SELECT *, lead(bar_start) OVER (PARTITION BY ticker ORDER BY bar_start) AS nxt FROM minute_bars) WHERE nxt IS NOT NULL)""",
    OHLC,
)
def _(t):
    return A.fill_chart_gaps(minute_bars(t), 60_000, 60)


@query(
    "A11_chart_gap_fill_all",
    """SELECT ticker, bar_start, open, high, low, close, volume FROM bars UNION ALL
    SELECT ticker, bar_start + j * 3600000, close, close, close, close, 0 FROM (
      SELECT *, unnest(range(1, (nxt - bar_start) // 3600000)) AS j FROM (
        SELECT *, lead(bar_start) OVER (PARTITION BY ticker ORDER BY bar_start) AS nxt FROM bars) WHERE nxt IS NOT NULL)""",
    OHLC,
)
def _(t):
    return A.fill_chart_gaps(hour_bars(t), 3_600_000)


@query(
    "A12_bars_date_range",
    """SELECT CAST(make_timestamp(bar_start * 1000) AS DATE) AS date, ticker, bar_start, open, high, low, close, volume
    FROM bars WHERE bar_start >= epoch_ms(DATE '2024-01-08') AND bar_start < epoch_ms(DATE '2024-01-20')""",
    OHLC,
)
def _(t):
    b = hour_bars(t).withColumn("date", S.et_date("bar_start"))
    return b.filter(F.col("date").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-19").cast("date"))).select(
        "date", "ticker", "bar_start", "open", "high", "low", "close", "volume"
    )


@query(
    "A13_append_partial_bar",
    """SELECT ticker, bar_start, open, high, low, close, volume FROM bars b
    WHERE bar_start < (SELECT max(bar_start) FROM bars x WHERE x.ticker = b.ticker) OR trade_count >= 2 OR high <> low""",
    OHLC,
)
def _(t):
    # Stored bars lack the newest two; the second newest arrives as pending, the newest as partial.
    b = hour_bars(t)
    r = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("bar_start")))
    b = b.withColumn("_r", r)
    return A.append_pending(b.filter("_r > 2"), b.filter("_r = 2"), b.filter("_r = 1"))


# --- bar factors -------------------------------------------------------------------------------

_W = "OVER (PARTITION BY ticker ORDER BY bar_start"


@query(
    "B1_ema",
    f"""SELECT ticker, bar_start, CASE WHEN n >= 20 THEN list_reduce(c, lambda a, x: CAST(2 AS DOUBLE) / 21 * x + (1 - CAST(2 AS DOUBLE) / 21) * a) END AS ema
    FROM (SELECT ticker, bar_start, list(close) {_W}) AS c, row_number() {_W}) AS n FROM bars)""",
    "ema",
)
def _(t):
    return B.add_ema(hour_bars(t)).select("ticker", "bar_start", "ema")


FACTOR_SQL = {
    "relative_volume": f"CASE WHEN row_number() {_W}) >= 20 THEN volume / avg(volume) {_W} ROWS 19 PRECEDING) END",
    "price_direction": "CASE WHEN high > low THEN (close - low) / (high - low) END",
    "gap_percent": f"(open - lag(close) {_W})) / lag(close) {_W}) * 100",
    "volume_acceleration": f"""CASE WHEN row_number() {_W}) > 25 THEN
        (avg(volume) {_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / avg(volume) {_W} ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING))
        / (avg(volume) {_W} ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING) / avg(volume) {_W} ROWS BETWEEN 25 PRECEDING AND 11 PRECEDING)) END""",
    "vwap_deviation": f"""CASE WHEN row_number() {_W}) >= 20 THEN (close / (sum(close * volume) {_W} ROWS 19 PRECEDING)
        / sum(volume) {_W} ROWS 19 PRECEDING)) - 1) * 100 END""",
}
_KEYS = {"B2_relative_volume": "relative_volume", "B3_price_direction": "price_direction", "B4_gap_percent": "gap_percent",
         "B5_volume_acceleration": "volume_acceleration", "B6_vwap_deviation": "vwap_deviation"}
for _name, _f in _KEYS.items():

    @query(_name, f"SELECT ticker, bar_start, {FACTOR_SQL[_f]} AS {_f} FROM bars", _f)
    def _(t, f=_f):
        return hour_bars(t).select("ticker", "bar_start", B.BAR_FACTORS[f](B.bar_window()).alias(f))


@query(
    "B7_momentum",
    f"""SELECT ticker, bar_start, coalesce((close - lag(close, 5) {_W})) / lag(close, 5) {_W}), 0) AS momentum FROM bars""",
    "momentum",
)
def _(t):
    return hour_bars(t).select("ticker", "bar_start", B.momentum(B.bar_window(), 5).alias("momentum"))


@query(
    "B8_volatility",
    f"""SELECT ticker, bar_start, CASE WHEN row_number() {_W}) > 20 THEN stddev_pop(ret) {_W} ROWS 19 PRECEDING) ELSE 0 END AS volatility
    FROM (SELECT *, close / lag(close) {_W}) - 1 AS ret FROM bars)""",
    "volatility",
)
def _(t):
    return B.add_volatility(hour_bars(t), B.bar_window()).select("ticker", "bar_start", "volatility")


@query(
    "B9_rsi",
    f"""SELECT ticker, bar_start, CASE WHEN n <= 14 THEN 50 WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100 ELSE 50 END
      ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM (
      SELECT ticker, bar_start, row_number() {_W}) AS n, sum(greatest(chg, 0)) {_W} ROWS 13 PRECEDING) AS gain,
        sum(greatest(-chg, 0)) {_W} ROWS 13 PRECEDING) AS loss
      FROM (SELECT *, close - lag(close) {_W}) AS chg FROM bars))""",
    "rsi",
)
def _(t):
    return B.add_rsi(hour_bars(t), B.bar_window()).select("ticker", "bar_start", "rsi")


@query(
    "B10_vwap_deviation_ratio",
    f"""SELECT ticker, bar_start, CASE WHEN row_number() {_W}) >= 10 THEN close / (sum(close * volume) {_W} ROWS 9 PRECEDING)
        / sum(volume) {_W} ROWS 9 PRECEDING)) - 1 ELSE 0 END AS dev FROM bars""",
    "dev",
)
def _(t):
    return hour_bars(t).select("ticker", "bar_start", B.vwap_deviation(B.bar_window(), 10, percent=False).alias("dev"))


@query(
    "B11_volume_ratio",
    f"""SELECT ticker, bar_start, coalesce(volume / nullif(coalesce(sum(volume) {_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) / 20.0, 0), 1)
    AS volume_ratio FROM bars""",
    "volume_ratio",
)
def _(t):
    return hour_bars(t).select("ticker", "bar_start", B.volume_ratio(B.bar_window()).alias("volume_ratio"))


_WS = "OVER (PARTITION BY ticker, day ORDER BY bar_start"


@query(
    "B12_session_vwap_factors",
    f"""SELECT ticker, bar_start, vwap, (close - vwap) / vwap * 100 AS vwap_deviation, relative_volume,
      list_reduce(c, lambda a, x: CAST(2 AS DOUBLE) / 21 * x + (1 - CAST(2 AS DOUBLE) / 21) * a) AS ema_20 FROM (
      SELECT ticker, bar_start, close, sum((high + low + close) / 3 * volume) {_WS}) / sum(volume) {_WS}) AS vwap,
        volume / avg(volume) {_WS} ROWS 19 PRECEDING) AS relative_volume, list(close) {_WS}) AS c
      FROM (SELECT *, bar_start // 86400000 AS day FROM minute_bars))""",
    "vwap vwap_deviation relative_volume ema_20",
)
def _(t):
    m = minute_bars(t).withColumn("day", S.et_date("bar_start"))
    return B.session_vwap(m, ("ticker", "day")).select("ticker", "bar_start", "vwap", "vwap_deviation", "relative_volume", "ema_20")


fragment(
    "bar_factor_table",
    "SELECT ticker, bar_start, bar_end, close, volume, " + ", ".join(f"{s} AS {n}" for n, s in FACTOR_SQL.items()) + " FROM bars",
)


@query(
    "B13_all_bar_factors",
    f"""SELECT f.ticker, f.bar_start, {', '.join('f.' + n for n in FACTOR_SQL)}, CASE WHEN n >= 20 THEN
      list_reduce(c, lambda a, x: CAST(2 AS DOUBLE) / 21 * x + (1 - CAST(2 AS DOUBLE) / 21) * a) END AS ema
    FROM bar_factor_table f JOIN (SELECT ticker, bar_start, list(close) {_W}) AS c, row_number() {_W}) AS n FROM bars) e
      ON e.ticker = f.ticker AND e.bar_start = f.bar_start""",
    " ".join(FACTOR_SQL) + " ema",
)
def _(t):
    return B.add_bar_factors(hour_bars(t)).select("ticker", "bar_start", *B.BAR_FACTORS, "ema")


@query(
    "K16_top_relative_volume",
    f"""SELECT ticker, bar_start, session, close, volume, vwap, relative_volume FROM (
      SELECT *, {FACTOR_SQL['relative_volume']} AS relative_volume FROM bars)
    WHERE relative_volume IS NOT NULL ORDER BY round(relative_volume, 9) DESC, ticker, bar_start LIMIT 20""",
    "close vwap relative_volume",
)
def _(t):
    b = hour_bars(t).withColumn("relative_volume", B.relative_volume(B.bar_window()))
    return (
        b.filter(F.col("relative_volume").isNotNull())
        .orderBy(F.round("relative_volume", 9).desc(), "ticker", "bar_start")
        .limit(20)
        .select("ticker", "bar_start", "session", "close", "volume", "vwap", "relative_volume")
    )
