"""Snapshot validation, calendar and readiness."""

from pyspark.sql import functions as F

from tapewright.functions import session as S
from tapewright.functions.calendar import is_early_close, is_trading_day, missing_dates, with_calendar
from tapewright.operators import quality as Q
from tapewright.operators.ticks import drop_delayed
from tapewright.plans.ctes import fragment
from tapewright.plans.q_bars import market_days
from tapewright.plans.q_snapshots import snap
from tapewright.plans.registry import query

H = 3_600_000
fragment("sizes", "SELECT date, window_ms, count(*) AS rows FROM snap GROUP BY 1, 2")
fragment(
    "intervals",
    f"SELECT date, min(g) AS min_interval_ms, max(g) AS max_interval_ms, avg(g) AS avg_interval_ms, count(*) FILTER (g > {H}) AS gap_count FROM (SELECT *, lead(window_ms) OVER (PARTITION BY date ORDER BY window_ms) - window_ms AS g FROM sizes) GROUP BY 1",
)
fragment(
    "size_checks",
    """SELECT *, snapshots < 20 AS too_few, minutes < 1200 AS too_short FROM (SELECT date, count(*) AS snapshots, min(rows) AS min_rows, max(rows) AS max_rows, avg(rows) AS avg_rows, count(*) FILTER (rows < 6) AS low_row_count,
      count(*) FILTER (rows > 25) AS high_row_count, (max(window_ms) - min(window_ms)) / 60000 AS minutes FROM sizes GROUP BY 1)""",
)
BOUNDS = dict(low=6, high=25, min_snapshots=20, min_minutes=1200)


@query("Q1_snapshot_intervals", "SELECT * FROM intervals", "avg_interval_ms")
def _(t):
    return Q.interval_report(Q.snapshot_sizes(snap(t)), H)


@query("Q2_row_count_bounds", "SELECT * FROM size_checks", "avg_rows minutes")
def _(t):
    return Q.size_report(Q.snapshot_sizes(snap(t)), **BOUNDS)


fragment(
    "verdicts",
    """SELECT *, issues = '' AS is_valid FROM (SELECT s.*, i.* EXCLUDE (date), n.null_count, concat_ws(',', CASE WHEN gap_count > 0 THEN 'gaps' END, CASE WHEN low_row_count > 0 THEN 'low_rows' END, CASE WHEN high_row_count > 0 THEN 'high_rows' END,
      CASE WHEN too_few THEN 'too_few_snapshots' END, CASE WHEN too_short THEN 'short_coverage' END, CASE WHEN null_count > 0 THEN 'nulls' END) AS issues
    FROM size_checks s JOIN intervals i ON i.date = s.date JOIN (SELECT date, count(*) FILTER (price IS NULL OR ticker IS NULL) AS null_count FROM snap GROUP BY 1) n ON n.date = s.date)""",
)


def verdicts(t):
    return Q.date_verdicts(snap(t), H, **BOUNDS)


@query("Q3_date_verdicts", "SELECT * FROM verdicts", "avg_rows minutes avg_interval_ms")
def _(t):
    return verdicts(t)


@query("Q3_verdict_summary", "SELECT count(*) AS n_dates, count(*) FILTER (is_valid) AS n_valid, CAST(sum(snapshots) AS BIGINT) AS snapshots, CAST(sum(gap_count) AS BIGINT) AS gaps, avg(avg_rows) AS mean_rows FROM verdicts", "mean_rows")
def _(t):
    return Q.verdict_summary(verdicts(t))


@query(
    "Q4_ticker_coverage",
    """SELECT g.date, ticker, windows, first_ms, last_ms, expected, windows / expected AS coverage, windows / expected < 0.1::DOUBLE AS incomplete FROM (
      SELECT date, ticker, count(*) AS windows, min(window_ms) AS first_ms, max(window_ms) AS last_ms FROM snap GROUP BY 1, 2) g JOIN (SELECT date, count(DISTINCT window_ms) AS expected FROM snap GROUP BY 1) e ON e.date = g.date""",
    "coverage",
)
def _(t):
    return Q.ticker_coverage(snap(t), 0.1)


def dated(df):
    return df.withColumn("date", S.et_date(S.to_et_ms("ts_ms")))


@query(
    "Q5_readiness",
    """SELECT m.date, trading_day, FALSE AS early_close, coalesce(nt, 0) AS n_trades, coalesce(nq, 0) AS n_quotes, coalesce(ns, 0) AS n_snapshots, NOT trading_day OR (coalesce(nt, 0) > 0 AND coalesce(nq, 0) > 0 AND coalesce(ns, 0) > 0) AS ready FROM market_days m
    LEFT JOIN (SELECT DATE '1970-01-01' + CAST(et_ms // 86400000 AS INTEGER) AS date, count(*) AS nt FROM wide_clean GROUP BY 1) a ON a.date = m.date
    LEFT JOIN (SELECT DATE '1970-01-01' + CAST(et_ms // 86400000 AS INTEGER) AS date, count(*) AS nq FROM quotes GROUP BY 1) b ON b.date = m.date
    LEFT JOIN (SELECT date, count(*) AS ns FROM snap WHERE change_pct > 0 GROUP BY 1) c ON c.date = m.date""",
)
def _(t):
    return Q.readiness(market_days(t), trades=dated(drop_delayed(t.wide_trades())), quotes=dated(t.quotes()), snapshots=snap(t).filter("change_pct > 0"))


# The market's rules in SQL, for the years of the line items (special closures of those years included).
_EASTER = {1995: "1995-04-14", 1996: "1996-04-05", 1997: "1997-03-28", 1998: "1998-04-10", 1999: "1999-04-02", 2000: "2000-04-21", 2001: "2001-04-13", 2002: "2002-03-29"}
_NTH = "month(d) = {m} AND isodow(d) = {w} AND (day(d) + 6) // 7 = {n}"
_OBS = "((month(d) = {m} AND day(d) = {k}) OR (isodow(d) = 1 AND month(d - 1) = {m} AND day(d - 1) = {k}) OR (isodow(d) = 5 AND month(d + 1) = {m} AND day(d + 1) = {k}))"
_HOLIDAY = " OR ".join(
    f"({c})"
    for c in (
        "month(d) = 1 AND day(d) = 1", "month(d) = 1 AND day(d) = 2 AND isodow(d) = 1", "year(d) >= 1998 AND " + _NTH.format(m=1, w=1, n=3), _NTH.format(m=2, w=1, n=3),
        "d IN (" + ", ".join(f"DATE '{x}'" for x in _EASTER.values()) + ")", "month(d) = 5 AND isodow(d) = 1 AND month(d + 7) = 6", _OBS.format(m=7, k=4), _NTH.format(m=9, w=1, n=1),
        _NTH.format(m=11, w=4, n=4), _OBS.format(m=12, k=25), "d BETWEEN DATE '2001-09-11' AND DATE '2001-09-14'",
    )
)
fragment("ship_days", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem")
fragment("ship_calendar", f"SELECT d, isodow(d) < 6 AND NOT ({_HOLIDAY}) AS trading_day FROM ship_days")
_THANKS = _NTH.format(m=11, w=4, n=4).replace("(d)", "(d - 1)")
_EARLY = f"trading_day AND (({_THANKS}) OR (month(d) = 7 AND day(d) = 3 AND isodow(d) BETWEEN 1 AND 4) OR (month(d) = 12 AND day(d) = 24))"


def ship_days(t):
    return t.read("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


@query("Q6_trading_calendar", f"SELECT d AS date, trading_day, {_EARLY} AS early_close, CAST(CASE WHEN {_EARLY} THEN 46800000 WHEN trading_day THEN 57600000 END AS BIGINT) AS close_ms FROM ship_calendar")
def _(t):
    return with_calendar(ship_days(t), "date").select("date", "trading_day", "early_close", "close_ms")


@query(
    "Q6_missing_dates",
    "SELECT d AS date, CASE WHEN trading_day THEN 'missing' ELSE 'non_trading' END AS reason FROM ship_calendar WHERE d NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 49 AND l_linenumber < 3)",
)
def _(t):
    have = t.read("lineitem").filter("l_quantity > 49 AND l_linenumber < 3").select(F.to_date("l_shipdate").alias("date"))
    return missing_dates(have, ship_days(t))


@query(
    "Q8_symbol_coverage",
    """SELECT date, count(a) AS n_snapshot, count(b) AS n_ticks, count(*) FILTER (b IS NULL) AS missing_ticks, count(*) FILTER (a IS NULL) AS extra_ticks, coalesce((count(a) - count(*) FILTER (b IS NULL)) / nullif(count(a), 0), 0) AS coverage FROM (
      SELECT coalesce(x.date, y.date) AS date, x.ticker AS a, y.ticker AS b FROM (SELECT DISTINCT date, ticker FROM snap) x FULL JOIN (
        SELECT DISTINCT DATE '1970-01-01' + CAST(et_ms // 86400000 AS INTEGER) AS date, ticker FROM wide_trades WHERE exchange <> 2) y ON x.date = y.date AND x.ticker = y.ticker) GROUP BY 1""",
    "coverage",
)
def _(t):
    return Q.symbol_coverage(snap(t), dated(t.wide_trades()).filter("exchange <> 2"))
