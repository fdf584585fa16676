"""Event rules over the merged factor table (trade rate in trades per hour here)."""

from pyspark.sql import Window, functions as F

from tapewright.functions import session as S
from tapewright.functions.durable import checkpoint
from tapewright.functions.folds import thin_by_interval
from tapewright.functions.rules import Condition, Rule, all_of, keyword_conditions, rule
from tapewright.operators import events as E, joins as J, tick_factors as T, ticks as K
from tapewright.plans.ctes import fragment
from tapewright.plans.q_snapshots import windows
from tapewright.plans.q_ticks import _ALL, clean, merged_table
from tapewright.plans.registry import query

HOUR = 3_600_000
TIMEOUT = 8 * HOUR
FWD = 6 * HOUR

ENTRY = (
    rule("momentum", ("trade_rate", "gt", 3.0), ("rel_vol_20", "gt", 1.2), ("session_phase", "ne", "early")),
    rule("activity", ("trade_rate", "gte", 2.0), ("relative_volume", "gt", 1.0)),
    rule("quiet_buyers", ("aggressor_ratio", "gte", 0.6), ("trade_rate", "between", (1.0, 3.0)), ("session_phase", "eq", "late")),
)
ANTI = (
    rule("false_breakout", ("price_direction", "between", (0.5, 0.7)), avoid=True),
    rule("dead_ticker", ("trade_rate", "lt", 1.0), avoid=True),
    rule("gap_down", ("gap_percent", "lte", -40.0), avoid=True),
)
WATCH = (rule("gap_watch", ("entry_gap_pct", "gt", 10.5), stage="watch", trigger="first_entry"),)

RULE_SQL = {
    "momentum": "(trade_rate > 3.0 AND relative_volume > 1.2 AND session_phase <> 'early')",
    "activity": "(trade_rate >= 2.0 AND relative_volume > 1.0)",
    "quiet_buyers": "(aggressor_ratio >= 0.6 AND trade_rate BETWEEN 1.0 AND 3.0 AND session_phase = 'late')",
}
ANTI_SQL = "(coalesce(price_direction BETWEEN 0.5 AND 0.7, FALSE) OR coalesce(trade_rate < 1.0, FALSE) OR coalesce(gap_percent <= -40.0, FALSE))"

_ET = "epoch_us(timezone('America/New_York', timezone('UTC', make_timestamp(ts_ms * 1000)))) // 1000"
fragment(
    "event_table",
    f"""SELECT *, DATE '1970-01-01' + CAST(et // 86400000 AS INTEGER) AS date,
      CASE WHEN et % 86400000 < 25200000 THEN 'early' WHEN et % 86400000 < 32400000 THEN 'mid' ELSE 'late' END AS session_phase
    FROM (SELECT * REPLACE (trade_rate * 3600 AS trade_rate), {_ET} AS et FROM merged_factors)""",
)
fragment(
    "priced",
    f"""SELECT e.* EXCLUDE (et), arg_max(c.price, (c.ts_ms, c.seq)) FILTER (c.ts_ms <= e.ts_ms) AS price,
      CASE WHEN max(c.ts_ms) > any_value(e.ts_ms) THEN (arg_max(c.price, (c.ts_ms, c.seq)) / arg_max(c.price, (c.ts_ms, c.seq)) FILTER (c.ts_ms <= e.ts_ms) - 1) * 100 END AS ret
    FROM event_table e JOIN clean c ON c.ticker = e.ticker AND c.ts_ms <= e.ts_ms + {FWD} GROUP BY ALL""",
)


def event_table(t):
    et = S.to_et_ms("ts_ms")
    m = merged_table(t).withColumn("trade_rate", F.col("trade_rate") * 3600)
    return m.withColumn("date", S.et_date(et)).withColumn("session_phase", S.session_phase(et))


def priced(t):
    """Factor rows with their price and the return over the next six hours."""
    tr = clean(t)
    p = J.entry_prices(event_table(t), tr, ts="ts_ms", fallback_ms=None).withColumnRenamed("entry_price", "price")
    return J.forward_returns(p, tr, {"6h": FWD}).withColumnRenamed("fwd_6h", "ret")


@query("F7_condition_predicates", f"SELECT ticker, ts_ms, coalesce({RULE_SQL['quiet_buyers']}, FALSE) AS hit, coalesce(gap_percent <> 0, FALSE) AS gapped FROM event_table")
def _(t):
    e = event_table(t)
    return e.select("ticker", "ts_ms", ENTRY[2].matches(e.columns).alias("hit"), Condition("gap_pct", "ne", 0.0).column(e.columns).alias("gapped"))


@query(
    "F9_keyword_matcher",
    "SELECT ticker, ts_ms, trade_rate, relative_volume FROM event_table WHERE trade_rate > 2 AND relative_volume <= 1.5 AND session_phase = 'late'",
    "trade_rate relative_volume",
)
def _(t):
    e = event_table(t)
    conds = keyword_conditions(trade_rate__gt=2.0, relative_volume__lte=1.5, session_phase="late")
    return e.filter(all_of(conds, e.columns)).select("ticker", "ts_ms", "trade_rate", "relative_volume")


@query("E1_rule_flags", "SELECT ticker, ts_ms, " + ", ".join(f"coalesce({s}, FALSE) AS {n}" for n, s in RULE_SQL.items()) + " FROM event_table")
def _(t):
    return E.rule_flags(event_table(t), ENTRY).select("ticker", "ts_ms", *[r.name for r in ENTRY])


_LONG = " UNION ALL ".join(f"SELECT ticker, date, ts_ms, '{n}' AS rule FROM event_table WHERE {s}" for n, s in RULE_SQL.items())
fragment("rule_matches", _LONG)


@query("E1_rule_matches", "SELECT * FROM rule_matches")
def _(t):
    return E.rule_matches(event_table(t), ENTRY, ("ticker", "date", "ts_ms"))


_FIRST = "CASE " + " ".join(f"WHEN {s} THEN '{n}'" for n, s in RULE_SQL.items()) + " END"


@query("E2_first_match_classification", f"SELECT ticker, ts_ms, {ANTI_SQL} AS rejected, CASE WHEN NOT {ANTI_SQL} THEN {_FIRST} END AS event_name FROM event_table")
def _(t):
    return E.classify(event_table(t), ENTRY, ANTI).select("ticker", "ts_ms", "rejected", "event_name")


def candidates(t):
    """Per ticker and date: the first trade at 30 or more, as the ticker's entry into the watched set."""
    tr = clean(t).filter("price >= 30").withColumn("date", S.et_date(S.to_et_ms("ts_ms")))
    k = K.order_key()
    return tr.groupBy("date", "ticker").agg(
        F.min("ts_ms").alias("first_entry_ms"), (F.min_by("price", k) - 20).alias("gain_at_entry"), F.min_by("price", k).alias("entry_price")
    )


fragment(
    "day_candidates",
    """SELECT DATE '1970-01-01' + CAST(et_ms // 86400000 AS INTEGER) AS date, ticker, min(ts_ms) AS first_entry_ms,
      arg_min(price, (ts_ms, seq)) - 20 AS gain_at_entry, arg_min(price, (ts_ms, seq)) AS entry_price, min(et_ms) AS entry_et FROM clean WHERE price >= 30 GROUP BY 1, 2""",
)
fragment(
    "staged",
    """SELECT e.*, gain_at_entry AS entry_gap_pct, first_entry_ms FROM event_table e JOIN day_candidates c
    ON c.date = e.date AND c.ticker = e.ticker AND e.ts_ms >= c.first_entry_ms""",
)
fragment(
    "watched",
    """SELECT date, ticker, min(ts_ms) AS watch_ms, 'gap_watch' AS watch_event FROM staged GROUP BY 1, 2 HAVING max(entry_gap_pct) > 10.5""",
)


def staged(t):
    """The factor rows of each day's candidates from their first entry on: few rows behind a long plan, read by both stages, so written."""
    c = candidates(t).select("date", "ticker", "first_entry_ms", F.col("gain_at_entry").alias("entry_gap_pct"))
    return checkpoint(event_table(t).join(c, ["date", "ticker"]).filter("ts_ms >= first_entry_ms").drop("first_entry_ms"))


_RANKED = "SELECT s.date, s.ticker, s.ts_ms, watch_ms, watch_event, r.i, r.rule FROM staged s JOIN watched USING (date, ticker) JOIN (" + " UNION ALL ".join(
    f"SELECT date, ticker, ts_ms, {i} AS i, '{n}' AS rule FROM staged WHERE {s}" for i, (n, s) in enumerate(RULE_SQL.items())
) + f") r ON r.date = s.date AND r.ticker = s.ticker AND r.ts_ms = s.ts_ms WHERE s.ts_ms >= watch_ms AND s.ts_ms - watch_ms <= {TIMEOUT} AND NOT {ANTI_SQL}"
fragment("stage_hits", _RANKED)


def _stage_sql(order: str) -> str:
    return f"""SELECT date, ticker, any_value(watch_ms) AS watch_ms, any_value(watch_event) AS watch_event,
      arg_min(ts_ms, {order}) AS entry_ms, arg_min(rule, {order}) AS event_name FROM stage_hits GROUP BY 1, 2"""


fragment("stage_entries", _stage_sql("(ts_ms, i)"))


@query("E3_watch_entry_stages", "SELECT * FROM stage_entries")
def _(t):
    return E.stage_signals(staged(t), candidates(t), WATCH, ENTRY, ANTI, TIMEOUT, ("date", "ticker"))


@query("E4_first_entry_in_rule_order", _stage_sql("(i, ts_ms)"))
def _(t):
    return E.stage_signals(staged(t), candidates(t), WATCH, ENTRY, ANTI, TIMEOUT, ("date", "ticker"), rule_order_first=True)


@query(
    "E7_cooldown",
    f"""SELECT rule, ticker, ts_ms FROM (
      WITH RECURSIVE chain AS (SELECT rule, ticker, min(ts_ms) AS ts_ms FROM rule_matches GROUP BY 1, 2
        UNION ALL SELECT c.rule, c.ticker, min(m.ts_ms) FROM chain c JOIN rule_matches m ON m.rule = c.rule AND m.ticker = c.ticker AND m.ts_ms >= c.ts_ms + {5 * HOUR}
          GROUP BY c.rule, c.ticker, c.ts_ms)
      SELECT * FROM chain)""",
)
def _(t):
    return E.cooldown(E.rule_matches(event_table(t), ENTRY), 5 * HOUR).select("rule", "ticker", "ts_ms")


fragment(
    "activity_points",
    """SELECT ticker, ts_ms, row_number() OVER (PARTITION BY ticker ORDER BY ts_ms) AS i, coalesce(n >= 2 AND CASE WHEN sd < 1e-9 THEN FALSE ELSE (trade_rate - mean) / sd > 1.0 END AND accel > 0, FALSE) AS active FROM (
      SELECT ticker, ts_ms, trade_rate, trade_rate - lag(trade_rate) OVER (PARTITION BY ticker ORDER BY ts_ms) AS accel, count(trade_rate) OVER w AS n, avg(trade_rate) OVER w AS mean, stddev_pop(trade_rate) OVER w AS sd
      FROM event_table WHERE trade_rate IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY ts_ms ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
)


STATES_SQL = f"""SELECT ticker, ts_ms, state FROM (
      WITH RECURSIVE st AS (SELECT ticker, CAST(0 AS BIGINT) AS i, 'QUIET' AS state, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS ts_ms, FALSE AS moved FROM activity_points WHERE i = 1
        UNION ALL SELECT ticker, i, CASE WHEN up THEN 'ACTIVE' WHEN down THEN 'QUIET' ELSE state END, CASE WHEN up OR down THEN ts_ms ELSE since END, ts_ms, up OR down FROM (
          SELECT p.ticker, p.i, p.ts_ms, s.state, s.since, s.state = 'QUIET' AND p.active AS up, s.state = 'ACTIVE' AND NOT p.active AND p.ts_ms - s.since >= {2 * HOUR} AS down
          FROM st s JOIN activity_points p ON p.ticker = s.ticker AND p.i = s.i + 1))
      SELECT * FROM st WHERE moved)"""


def activity_points(t):
    """z of the hourly trade rate against its last 20 points; acceleration is the change of the rate."""
    f = event_table(t).filter("trade_rate IS NOT NULL")
    w = Window.partitionBy("ticker").orderBy("ts_ms")
    return T.z_score(f, "trade_rate", 20, order="ts_ms").withColumn("accel", F.col("trade_rate") - F.lag("trade_rate").over(w))


@query("E8_activity_states", STATES_SQL)
def _(t):
    return E.activity_states(activity_points(t), 1.0, 2 * HOUR)


fragment("fast_signals", "SELECT ticker, ts_ms, trade_rate FROM event_table WHERE trade_rate > 2.0")


@query(
    "E10_interval_thinning",
    f"""SELECT s.ticker, s.ts_ms, s.trade_rate FROM fast_signals s JOIN (
      WITH RECURSIVE chain AS (SELECT ticker, min(ts_ms) AS ts_ms FROM fast_signals GROUP BY 1
        UNION ALL SELECT c.ticker, min(m.ts_ms) FROM chain c JOIN fast_signals m ON m.ticker = c.ticker AND m.ts_ms >= c.ts_ms + {6 * HOUR} GROUP BY c.ticker, c.ts_ms)
      SELECT * FROM chain) k ON k.ticker = s.ticker AND k.ts_ms = s.ts_ms""",
    "trade_rate",
)
def _(t):
    e = event_table(t)
    sig = e.filter(all_of(keyword_conditions(trade_rate__gt=2.0), e.columns)).select("ticker", "ts_ms", "trade_rate")
    return thin_by_interval(sig, ["ticker"], "ts_ms", 6 * HOUR)


fragment(
    "catalysts",
    """SELECT obs_id, symbol AS ticker, trigger_ms AS ts_ms, score FROM observations WHERE verdict = 'YES'""",
)


def news(t):
    return t.observations().select("obs_id", F.col("symbol").alias("ticker"), F.col("trigger_ms").alias("ts_ms"), "score", (F.col("verdict") == "YES").alias("is_catalyst"))


@query(
    "E11_catalyst_events",
    """SELECT obs_id, c.ticker, c.ts_ms, score, arg_max(w.price, w.window_ms) AS price, arg_max(w.volume, w.window_ms) AS volume,
      any_value(p.float_shares) AS float_shares, any_value(p.sector) AS sector
    FROM catalysts c LEFT JOIN tw w ON w.ticker = c.ticker AND w.window_ms <= c.ts_ms LEFT JOIN profiles p ON p.ticker = c.ticker GROUP BY 1, 2, 3, 4""",
    "price float_shares",
)
def _(t):
    out = E.catalyst_events(news(t), windows(t), t.profiles())
    return out.select("obs_id", "ticker", "ts_ms", "score", "price", "volume", "float_shares", "sector")


_VALID = """SELECT rule, CAST(sum(c) AS BIGINT) AS total_signals, avg(m) AS avg_return, avg(w) AS win_rate, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END) AS positive_dates_ratio,
      stddev_pop(m) AS return_std, stddev_pop(w) AS win_rate_std, count(*) AS n_dates FROM (
      SELECT r.rule, r.date, avg(ret) AS m, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS w, count(*) AS c
      FROM rule_matches r JOIN priced p ON p.ticker = r.ticker AND p.ts_ms = r.ts_ms GROUP BY 1, 2 HAVING avg(ret) IS NOT NULL) GROUP BY 1"""
_VALID = f"""SELECT *, CASE WHEN return_std = 0 THEN 1 ELSE greatest(0, 1 - return_std / (abs(avg_return) + 0.01)) END AS stability,
  avg_return > 0 AND win_rate > 0.4 AS passes_basic, CASE WHEN rule = 'quiet_buyers' THEN avg_return < -0.02 AND win_rate < 0.40 AND positive_dates_ratio < 0.4 AND total_signals >= 100
  ELSE avg_return > 0.02 AND win_rate > 0.45 AND positive_dates_ratio > 0.6 AND total_signals >= 100 END AS is_valid FROM ({_VALID})"""
_VF = "avg_return win_rate positive_dates_ratio return_std win_rate_std stability"


def validated(t):
    p = priced(t)
    return E.validate_rules(E.rule_matches(p, ENTRY, ("ticker", "date", "ts_ms", "ret")), "ret", avoid=("quiet_buyers",))


@query("E12_rule_validation", _VALID, _VF)
def _(t):
    return validated(t)


@query("E13_rule_comparison", f"SELECT * FROM ({_VALID}) ORDER BY avg_return DESC, rule", _VF)
def _(t):
    return E.compare_rules(validated(t))
