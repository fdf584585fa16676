"""Exits, forward returns and trade simulation over the dense trades."""

from pyspark.sql import functions as F

from tapewright.functions import session as S
from tapewright.functions.durable import checkpoint
from tapewright.functions.folds import thin_by_interval
from tapewright.functions.rules import rule
from tapewright.operators import events as E, exits as X, joins as J
from tapewright.plans.ctes import fragment
from tapewright.plans.q_bars import hour_bars
from tapewright.plans.q_events import ANTI, ANTI_SQL, ENTRY, RULE_SQL, TIMEOUT, WATCH, candidates, event_table, staged
from tapewright.plans.q_joins import signals
from tapewright.plans.q_ticks import clean
from tapewright.plans.registry import query

HOUR = 3_600_000


def entries(t):
    """Day candidates as entries that run to 20:00 US/Eastern of their date."""
    c = candidates(t)
    left = S.AFTERHOURS_END_MS - S.ms_of_day(S.to_et_ms("first_entry_ms"))
    return c.select(
        F.concat_ws("-", "ticker", F.col("date").cast("string")).alias("entry_id"), "date", "ticker",
        F.col("first_entry_ms").alias("entry_ms"), "entry_price", (F.col("first_entry_ms") + left).alias("session_end_ms"), "gain_at_entry",
    )


fragment(
    "entries",
    """SELECT ticker || '-' || CAST(date AS VARCHAR) AS entry_id, date, ticker, first_entry_ms AS entry_ms, entry_price,
      first_entry_ms + 72000000 - entry_et % 86400000 AS session_end_ms, gain_at_entry FROM day_candidates""",
)
fragment(
    "path",
    """SELECT *, row_number() OVER w AS step, max(px) OVER (w ROWS UNBOUNDED PRECEDING) AS peak, min(px) OVER (w ROWS UNBOUNDED PRECEDING) AS trough FROM (
      SELECT e.*, c.ts_ms, c.seq, c.price AS px, c.size AS sz FROM entries e JOIN clean c ON c.ticker = e.ticker AND c.ts_ms > e.entry_ms AND c.ts_ms <= e.session_end_ms)
    WINDOW w AS (PARTITION BY entry_id ORDER BY ts_ms, seq)""",
)


def path(t):
    return X.price_path(entries(t), clean(t))


def strategy_rows(strategies, tp="tp"):
    """SQL of the first-hit simulation for a list of strategies."""
    values = ", ".join(
        f"('{s.name}', {s.tp if s.tp is not None else 'NULL'}::DOUBLE, {s.sl if s.sl is not None else 'NULL'}::DOUBLE, "
        f"{s.trail if s.trail is not None else 'NULL'}::DOUBLE, {s.time_min if s.time_min is not None else 'NULL'}::DOUBLE)"
        for s in strategies
    )
    return f"""SELECT entry_id, ticker, date, entry_ms, entry_price, session_end_ms, strategy, coalesce(x.ts_ms, session_end_ms) AS exit_ms, coalesce(x.px, l.px) AS exit_price,
        coalesce(x.reason, 'session_end') AS exit_reason, (coalesce(x.px, l.px) / entry_price - 1) * 100 AS pnl_pct, (coalesce(x.peak, l.peak) / entry_price - 1) * 100 AS mfe_pct,
        (coalesce(x.trough, l.trough) / entry_price - 1) * 100 AS mae_pct, (coalesce(x.ts_ms, session_end_ms) - entry_ms) / 60000 AS duration_min
      FROM (SELECT entry_id, ticker, date, entry_ms, entry_price, session_end_ms, strategy,
          arg_min(struct_pack(ts_ms, px, peak, trough, reason), step) FILTER (reason IS NOT NULL) AS x, arg_max(struct_pack(ts_ms, px, peak, trough, reason), step) AS l
        FROM (SELECT *, CASE WHEN px <= entry_price * (1 - sl / 100) THEN 'stop_loss' WHEN px >= entry_price * (1 + {tp} / 100) THEN 'take_profit'
            WHEN px <= greatest(peak, entry_price) * (1 - trail / 100) THEN 'trailing_stop' WHEN ts_ms >= entry_ms + CAST(time_min * 60000 AS BIGINT) THEN 'time_stop' END AS reason
          FROM path, (VALUES {values}) s(strategy, tp, sl, trail, time_min)) GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


_REPORT = """SELECT {keys}, count(*) AS n_trades, count(*) FILTER (pnl_pct > 0) AS n_profitable, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate,
  coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0) AS avg_win_pct, coalesce(avg(pnl_pct) FILTER (pnl_pct <= 0), 0) AS avg_loss_pct, avg(pnl_pct) AS expectancy_pct,
  avg(mfe_pct) AS avg_mfe_pct, avg(duration_min) AS avg_duration_min FROM ({rows}) GROUP BY ALL"""
REPORT_F = "win_rate avg_win_pct avg_loss_pct expectancy_pct avg_mfe_pct avg_duration_min"
ONE = (X.Strategy(tp=10.0, sl=5.0, trail=7.0, time_min=240.0),)
fragment("sim_one", strategy_rows(ONE))
fragment("sim_sweep", strategy_rows(X.SWEEP))
fragment("sweep_report", _REPORT.format(keys="strategy", rows="SELECT * FROM sim_sweep"))


def report_sql(rows, keys="strategy"):
    return _REPORT.format(keys=keys, rows=rows)


@query(
    "X2_first_hit_exit",
    "SELECT entry_id, strategy, exit_ms, exit_price, exit_reason, pnl_pct, mfe_pct, mae_pct, duration_min FROM sim_one",
    "exit_price pnl_pct mfe_pct mae_pct duration_min",
)
def _(t):
    return X.simulate_entries(entries(t), clean(t), ONE).select("entry_id", "strategy", "exit_ms", "exit_price", "exit_reason", "pnl_pct", "mfe_pct", "mae_pct", "duration_min")


@query("X3_strategy_report", report_sql("SELECT * FROM sim_one"), REPORT_F)
def _(t):
    return X.strategy_report(X.simulate_entries(entries(t), clean(t), ONE))


@query("X4_strategy_sweep", "SELECT * FROM sweep_report", REPORT_F)
def _(t):
    return X.strategy_report(X.simulate_entries(entries(t), clean(t), X.SWEEP))


@query("X4_best_strategies", "SELECT * FROM sweep_report ORDER BY expectancy_pct DESC, strategy LIMIT 5", REPORT_F)
def _(t):
    return X.best_strategies(X.strategy_report(X.simulate_entries(entries(t), clean(t), X.SWEEP)))


fragment(
    "excursions",
    """SELECT entry_id, ticker, entry_price, (max(px) / entry_price - 1) * 100 AS mfe_pct, (min(px) / entry_price - 1) * 100 AS mae_pct,
      (arg_max(px, step) / entry_price - 1) * 100 AS close_pct FROM path GROUP BY 1, 2, 3""",
)


@query("X5_excursions", "SELECT * FROM excursions", "entry_price mfe_pct mae_pct close_pct")
def _(t):
    return X.excursions(entries(t), clean(t))


@query(
    "X5_excursion_summary",
    """SELECT count(*) AS n, avg(mfe_pct) AS mean_mfe, median(mfe_pct) AS median_mfe, avg(close_pct) AS mean_close, median(close_pct) AS median_close,
    count(*) FILTER (mfe_pct >= 5) AS hit_5pct, count(*) FILTER (mfe_pct >= 10) AS hit_10pct, count(*) FILTER (mfe_pct >= 15) AS hit_15pct FROM excursions""",
    "mean_mfe median_mfe mean_close median_close",
)
def _(t):
    return X.excursion_summary(X.excursions(entries(t), clean(t)))


def partial_sql(c: X.PartialExits) -> str:
    """SQL of a scaled exit without trailing: first rows per event, then weights."""
    k = range(len(c.steps))
    big = 2**62
    f = "".join(f", coalesce(min(step) FILTER (gain >= {at}), {big}) AS f{i}" for i, (at, _) in enumerate(c.steps))
    time = f"coalesce(min(step) FILTER ((ts_ms - entry_ms) / 60000.0 >= {c.max_hold_min}), {big})" if c.max_hold_min else str(big)
    w = "".join(f", CASE WHEN f{i} < st AND f{i} <= tm THEN {s} ELSE 0 END AS w{i}" for i, (_, s) in enumerate(c.steps))
    rest_tm = "1" + "".join(f" - CASE WHEN f{i} <= tm THEN {s} ELSE 0 END" for i, (_, s) in enumerate(c.steps))
    sold = " + ".join(f"w{i}" for i in k) or "0"
    gains = "".join(f" + coalesce(max(gain) FILTER (step = f{i}) * any_value(w{i}), 0)" for i in k)
    return f"""SELECT entry_id, '{c.name}' AS strategy, coalesce(max(gain) FILTER (step = e), arg_max(gain, step)) * any_value(rest){gains} AS return_pct,
        any_value(sold) AS take_profit_share, CASE WHEN any_value(e) = any_value(st) AND any_value(st) < {big} THEN any_value(rest) ELSE 0 END AS stop_loss_share, 0.0 AS trailing_share,
        CASE WHEN any_value(e) = any_value(lim) AND any_value(st) <> any_value(e) AND any_value(lim) < {big} THEN any_value(rest) ELSE 0 END AS time_share,
        CASE WHEN any_value(e) = {big} THEN any_value(rest) ELSE 0 END AS close_share,
        greatest(any_value(entry_price), max(px) FILTER (step <= e)) AS max_price, least(any_value(entry_price), min(px) FILTER (step <= e)) AS min_price,
        CASE WHEN max(px) FILTER (step <= e) > any_value(entry_price) THEN arg_min(ts_ms, (-px, step)) FILTER (step <= e) - any_value(entry_ms) ELSE 0 END AS time_to_max_ms,
        CASE WHEN min(px) FILTER (step <= e) < any_value(entry_price) THEN arg_min(ts_ms, (px, step)) FILTER (step <= e) - any_value(entry_ms) ELSE 0 END AS time_to_min_ms
      FROM (SELECT *, least(st, lim) AS e, {sold} AS sold, 1 - ({sold}) AS rest FROM (
        SELECT *{w}, CASE WHEN tm < st AND {rest_tm} > 1e-12 THEN tm ELSE {big} END AS lim FROM (
          SELECT * FROM (SELECT *, (px - entry_price) / entry_price * 100 AS gain FROM path) p JOIN (
            SELECT entry_id, coalesce(min(step) FILTER (gain <= -{c.stop_loss}), {big}) AS st, {time} AS tm{f}
            FROM (SELECT *, (px - entry_price) / entry_price * 100 AS gain FROM path) GROUP BY 1) USING (entry_id)))) GROUP BY 1"""


PARTIALS = (X.SCALE_FAST, X.TP10_SL15, X.simple_hold(240))
PART_COLS = ["entry_id", "strategy", "return_pct", "take_profit_share", "stop_loss_share", "trailing_share", "time_share", "close_share", "max_price", "min_price", "time_to_max_ms", "time_to_min_ms"]
PART_F = "return_pct take_profit_share stop_loss_share trailing_share time_share close_share max_price min_price"


def union_partials(p, configs):
    out = None
    for c in configs:
        part = X.partial_exits(p, c, ("date",))
        out = part if out is None else out.unionByName(part)
    return out


fragment("partials", " UNION ALL ".join(f"({partial_sql(c)})" for c in PARTIALS))


@query("X1_scaled_exits", "SELECT * FROM partials", PART_F)
def _(t):
    return union_partials(path(t), PARTIALS).select(*PART_COLS)


TRAILING = X.PartialExits("trailing", ((5.0, 0.50), (15.0, 0.30)), 8.0, trail_trigger=5.0, trail=4.0, max_hold_min=480)


def trailing_sql(c: X.PartialExits) -> str:
    """SQL of a scaled exit with a trailing stop, which starts at the first sale at or above the trigger."""
    big, k = 2**62, range(len(c.steps))
    firsts = "".join(f", coalesce(min(step) FILTER (gain >= {at}), {big}) AS f{i}, arg_min(gain, step) FILTER (gain >= {at}) AS g{i}" for i, (at, _) in enumerate(c.steps))
    start = "least(" + ", ".join(f"CASE WHEN g{i} >= {c.trail_trigger} THEN f{i} ELSE {big} END" for i in k) + f", {big})"
    w = "".join(f", CASE WHEN f{i} < cut AND f{i} <= tm THEN {s} ELSE 0 END AS w{i}" for i, (_, s) in enumerate(c.steps))
    left_at_time = "1" + "".join(f" - CASE WHEN f{i} <= tm THEN {s} ELSE 0 END" for i, (_, s) in enumerate(c.steps))
    sold = " + ".join(f"w{i}" for i in k)
    gains = "".join(f" + coalesce(max(gain) FILTER (step = f{i}) * any_value(w{i}), 0)" for i in k)
    reason = lambda hit: f"CASE WHEN any_value({hit}) THEN any_value(rest) ELSE 0 END"
    return f"""WITH p AS (SELECT *, (px - entry_price) / entry_price * 100 AS gain FROM path),
      f AS (SELECT entry_id, coalesce(min(step) FILTER (gain <= -{c.stop_loss}), {big}) AS st, coalesce(min(step) FILTER ((ts_ms - entry_ms) / 60000.0 >= {c.max_hold_min}), {big}) AS tm{firsts} FROM p GROUP BY 1),
      r AS (SELECT p.*, f.* EXCLUDE (entry_id), {start} AS a FROM p JOIN f USING (entry_id)),
      t AS (SELECT entry_id, min(step) AS tr FROM (SELECT *, (max(px) OVER (PARTITION BY entry_id ORDER BY step) - entry_price) / entry_price * 100 AS top FROM r WHERE step >= a) WHERE step > a AND gain <= top - {c.trail} GROUP BY 1),
      x AS (SELECT *, least(cut, lim) AS e, 1 - ({sold}) AS rest, {sold} AS sold FROM (SELECT *{w}, CASE WHEN tm < cut AND {left_at_time} > 1e-12 THEN tm ELSE {big} END AS lim FROM (
        SELECT r.*, coalesce(tr, {big}) AS tr, least(st, coalesce(tr, {big})) AS cut FROM r LEFT JOIN t USING (entry_id))))
      SELECT entry_id, '{c.name}' AS strategy, coalesce(max(gain) FILTER (step = e), arg_max(gain, step)) * any_value(rest){gains} AS return_pct, any_value(sold) AS take_profit_share,
        {reason(f'e = st AND e < {big}')} AS stop_loss_share, {reason(f'e = tr AND e <> st AND e < {big}')} AS trailing_share, {reason(f'e = lim AND e <> st AND e <> tr AND e < {big}')} AS time_share, {reason(f'e = {big}')} AS close_share,
        greatest(any_value(entry_price), max(px) FILTER (step <= e)) AS max_price, least(any_value(entry_price), min(px) FILTER (step <= e)) AS min_price,
        CASE WHEN max(px) FILTER (step <= e) > any_value(entry_price) THEN arg_min(ts_ms, (-px, step)) FILTER (step <= e) - any_value(entry_ms) ELSE 0 END AS time_to_max_ms,
        CASE WHEN min(px) FILTER (step <= e) < any_value(entry_price) THEN arg_min(ts_ms, (px, step)) FILTER (step <= e) - any_value(entry_ms) ELSE 0 END AS time_to_min_ms FROM x GROUP BY 1"""


@query("X1_scaled_exits_trailing", f"SELECT * FROM ({trailing_sql(TRAILING)})", PART_F)
def _(t):
    return X.partial_exits(path(t), TRAILING).select(*PART_COLS)


@query(
    "X6_fixed_hold_stats",
    f"""SELECT s.signal_id, any_value(p.price) AS entry_price, coalesce(arg_max(c.price, (c.ts_ms, c.seq)) FILTER (c.ts_ms <= entry_ms + {6 * HOUR}), arg_min(c.price, (c.ts_ms, c.seq)), any_value(p.price)) AS exit_price,
      greatest(any_value(p.price), max(c.price) FILTER (c.ts_ms <= entry_ms + {6 * HOUR})) AS max_price, least(any_value(p.price), min(c.price) FILTER (c.ts_ms <= entry_ms + {6 * HOUR})) AS min_price,
      CASE WHEN count(c.seq) FILTER (c.ts_ms <= entry_ms + {6 * HOUR}) = 0 THEN coalesce(min(c.ts_ms) - any_value(entry_ms), 0)
        WHEN max(c.price) FILTER (c.ts_ms <= entry_ms + {6 * HOUR}) > any_value(p.price) THEN arg_min(c.ts_ms, (-c.price, c.ts_ms)) FILTER (c.ts_ms <= entry_ms + {6 * HOUR}) - any_value(entry_ms) ELSE 0 END AS time_to_max_ms,
      CASE WHEN count(c.seq) FILTER (c.ts_ms <= entry_ms + {6 * HOUR}) = 0 THEN coalesce(min(c.ts_ms) - any_value(entry_ms), 0)
        WHEN min(c.price) FILTER (c.ts_ms <= entry_ms + {6 * HOUR}) < any_value(p.price) THEN arg_min(c.ts_ms, (c.price, c.ts_ms)) FILTER (c.ts_ms <= entry_ms + {6 * HOUR}) - any_value(entry_ms) ELSE 0 END AS time_to_min_ms
    FROM signals s JOIN clean p ON p.seq = s.signal_id LEFT JOIN clean c ON c.ticker = s.ticker AND c.ts_ms > s.entry_ms GROUP BY 1""",
    "entry_price exit_price max_price min_price",
)
def _(t):
    out = J.signal_exit_stats(signals(t), clean(t), 6 * HOUR)
    return out.select("signal_id", "entry_price", "exit_price", "max_price", "min_price", "time_to_max_ms", "time_to_min_ms")


HZ = {"1h": HOUR, "6h": 6 * HOUR, "24h": 24 * HOUR}


@query(
    "X7_forward_returns",
    "SELECT s.signal_id, " + ", ".join(
        f"(arg_max(c.price, (c.ts_ms, c.seq)) FILTER (c.ts_ms <= s.entry_ms + {h}) / any_value(p.price) - 1) * 100 AS fwd_{n}" for n, h in HZ.items()
    ) + f" FROM signals s JOIN clean p ON p.seq = s.signal_id LEFT JOIN clean c ON c.ticker = s.ticker AND c.ts_ms > s.entry_ms AND c.ts_ms <= s.entry_ms + {24 * HOUR} GROUP BY 1",
    " ".join(f"fwd_{n}" for n in HZ),
)
def _(t):
    s = J.entry_prices(signals(t), clean(t), fallback_ms=None)
    return J.forward_returns(s, clean(t), HZ, ts="entry_ms", price="entry_price").select("signal_id", *[f"fwd_{n}" for n in HZ])


def _close_sql(off):
    return f"""CASE WHEN et_ms + {off} - max(b.bar_start) FILTER (b.bar_start <= et_ms + {off}) < {HOUR} THEN arg_max(b.close, b.bar_start) FILTER (b.bar_start <= et_ms + {off})
      WHEN min(b.bar_start) FILTER (b.bar_start > et_ms + {off}) - (et_ms + {off}) <= {2 * HOUR} THEN arg_min(b.close, b.bar_start) FILTER (b.bar_start > et_ms + {off}) END"""


@query(
    "X8_return_backfill",
    "SELECT s.signal_id, " + ", ".join(f"{_close_sql(h)} / price - 1 AS return_{n}" for n, h in HZ.items())
    + " FROM signals s JOIN clean c ON c.seq = s.signal_id JOIN bars b ON b.ticker = s.ticker GROUP BY s.signal_id, et_ms, price",
    " ".join(f"return_{n}" for n in HZ),
)
def _(t):
    tr = clean(t).filter("size >= 90").select(F.col("seq").alias("signal_id"), "ticker", S.to_et_ms("ts_ms").alias("et"), "price")
    out = X.backfill_returns(tr, hour_bars(t), HZ, "et", "price", HOUR, 2 * HOUR)
    return out.select("signal_id", *[f"return_{n}" for n in HZ])


W9 = 2 * HOUR
_NEAR = "arg_min(c.price, (abs(c.ts_ms - ({t})), c.ts_ms, CASE WHEN c.ts_ms <= ({t}) THEN -c.seq ELSE c.seq END)) FILTER (abs(c.ts_ms - ({t})) <= %d)" % W9
H9 = {"6h": 6 * HOUR, "24h": 24 * HOUR}
fragment(
    "outcomes",
    f"""SELECT obs_id, trigger_price, {', '.join(f'(f_{n} - trigger_price) / trigger_price AS return_{n}, (m_{n} - trigger_price) / trigger_price AS max_return_{n}' for n in H9)} FROM (
      SELECT obs_id, {_NEAR.format(t='trigger_ms')} AS trigger_price,
        {', '.join(f"{_NEAR.format(t=f'trigger_ms + {h}')} AS f_{n}, max(c.price) FILTER (c.ts_ms BETWEEN trigger_ms AND trigger_ms + {h}) AS m_{n}" for n, h in H9.items())}
      FROM dense_observations o LEFT JOIN clean c ON c.ticker = o.ticker GROUP BY obs_id)""",
)
fragment(
    "dense_observations",
    """SELECT obs_id, trigger_ms, score, verdict, source, lang, (['click', 'error', 'purchase', 'signup', 'view'])[1 + obs_id % 5] AS ticker FROM observations""",
)


def dense_observations(t):
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return t.observations().withColumn("ticker", F.element_at(names, (1 + F.col("obs_id") % 5).cast("int"))).drop("symbol")


def outcome_table(t):
    return X.outcomes(dense_observations(t), clean(t), H9, window_ms=W9)


OUT_COLS = ["trigger_price", *[f"{p}_{n}" for n in H9 for p in ("return", "max_return")]]


@query("X9_observation_outcomes", f"SELECT obs_id, {', '.join(OUT_COLS)} FROM outcomes", " ".join(OUT_COLS))
def _(t):
    return outcome_table(t).select("obs_id", *OUT_COLS)


def hold_trades(t):
    """Signals of each ticker thinned to one per six hours, held for up to twelve."""
    s = signals(t).select("ticker", F.col("entry_ms").alias("ts_ms"), F.col("signal_id"))
    s = thin_by_interval(s, ["ticker"], "ts_ms", 6 * HOUR, ["signal_id"])
    e = J.entry_prices(s.withColumnRenamed("ts_ms", "entry_ms"), clean(t), fallback_ms=None)
    e = e.select(F.col("signal_id").alias("entry_id"), "ticker", "entry_ms", "entry_price", (F.col("entry_ms") + 12 * HOUR).alias("session_end_ms"))
    return X.simulate_holds(e, clean(t), -5.0, 10.0)


fragment(
    "thin_signals",
    f"""SELECT * FROM (WITH RECURSIVE chain AS (SELECT ticker, min(entry_ms) AS entry_ms FROM signals GROUP BY 1
      UNION ALL SELECT c.ticker, min(s.entry_ms) FROM chain c JOIN signals s ON s.ticker = c.ticker AND s.entry_ms >= c.entry_ms + {6 * HOUR} GROUP BY c.ticker, c.entry_ms)
      SELECT s.signal_id, s.ticker, s.entry_ms FROM chain JOIN signals s USING (ticker, entry_ms))""",
)
fragment(
    "hold_trades",
    f"""SELECT entry_id, exit_ms, exit_price, exit_reason, (exit_price / entry_price - 1) * 100 AS return_pct, (exit_ms - entry_ms) / 60000 AS hold_minutes FROM (
      SELECT entry_id, entry_ms, entry_price, coalesce(min(ts_ms) FILTER (r IS NOT NULL), max(ts_ms)) AS exit_ms, coalesce(arg_min(px, ts_ms) FILTER (r IS NOT NULL), arg_max(px, ts_ms)) AS exit_price,
        coalesce(arg_min(r, ts_ms) FILTER (r IS NOT NULL), 'hold_expired') AS exit_reason FROM (
        SELECT s.signal_id AS entry_id, s.entry_ms, p.price AS entry_price, c.ts_ms, c.price AS px,
          CASE WHEN (c.price / p.price - 1) * 100 <= -5 THEN 'stop_loss' WHEN (c.price / p.price - 1) * 100 >= 10 THEN 'take_profit' END AS r
        FROM thin_signals s JOIN clean p ON p.seq = s.signal_id JOIN clean c ON c.ticker = s.ticker AND c.ts_ms > s.entry_ms AND c.ts_ms <= s.entry_ms + {12 * HOUR}) GROUP BY 1, 2, 3)""",
)


@query("X10_hold_simulation", "SELECT * FROM hold_trades", "exit_price return_pct hold_minutes")
def _(t):
    return hold_trades(t).select("entry_id", "exit_ms", "exit_price", "exit_reason", "return_pct", "hold_minutes")


@query(
    "X11_trade_summary",
    """SELECT count(*) AS total_trades, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(return_pct) AS avg_return, sum(return_pct) AS total_return,
    max(return_pct) AS max_return, min(return_pct) AS min_return, avg(hold_minutes) AS avg_hold_minutes, count(*) FILTER (exit_reason = 'stop_loss') AS n_stop_loss,
    count(*) FILTER (exit_reason = 'take_profit') AS n_take_profit, count(*) FILTER (exit_reason = 'hold_expired') AS n_hold_expired FROM hold_trades""",
    "win_rate avg_return total_return max_return min_return avg_hold_minutes",
)
def _(t):
    return X.trade_summary(hold_trades(t))


fragment("sim_base", strategy_rows((X.Strategy(tp=5.0, sl=15.0), X.Strategy(tp=10.0, sl=15.0))))
fragment("sim_chosen", strategy_rows((X.Strategy(sl=15.0),), "(CASE WHEN gain_at_entry >= 12 THEN 10 ELSE 5 END)"))


@query("X13_chosen_target", report_sql("SELECT * REPLACE ('chosen' AS strategy) FROM sim_chosen UNION ALL SELECT * FROM sim_base"), REPORT_F)
def _(t):
    e, tr = entries(t), clean(t)
    chosen = X.simulate_entries(e, tr, (X.Strategy(sl=15.0),), ("gain_at_entry",), F.when(F.col("gain_at_entry") >= 12, 10.0).otherwise(5.0)).drop("gain_at_entry")
    base = X.simulate_entries(e, tr, (X.Strategy(tp=5.0, sl=15.0), X.Strategy(tp=10.0, sl=15.0)))
    return X.strategy_report(chosen.withColumn("strategy", F.lit("chosen")).unionByName(base))


fragment(
    "labels5",
    """SELECT p.entry_id, p.ticker, p.entry_price, hit_ms, hit_price, CASE WHEN max(px) >= p.entry_price * 1.10::DOUBLE THEN 'runner' WHEN min(px) <= p.entry_price THEN 'fader' ELSE 'drift' END AS label
    FROM path p JOIN (SELECT entry_id, arg_min(ts_ms, step) AS hit_ms, arg_min(px, step) AS hit_price FROM path WHERE px >= entry_price * 1.05::DOUBLE GROUP BY 1) h ON h.entry_id = p.entry_id AND p.ts_ms > h.hit_ms
    GROUP BY 1, 2, 3, 4, 5""",
)


@query("X14_continuation_labels", "SELECT entry_id, hit_ms, hit_price, label FROM labels5", "hit_price")
def _(t):
    return X.continuation_labels(entries(t), clean(t)).select("entry_id", "hit_ms", "hit_price", "label")


def backtest(t, config=X.TP10_SL15):
    """Stage signals with their entry price, walked to the end of the day under one exit configuration."""
    return walked(t, E.stage_signals(staged(t), candidates(t), WATCH, ENTRY, ANTI, TIMEOUT, ("date", "ticker")), config)


def walked(t, s, config=X.TP10_SL15):
    # A few rows a day, behind a long plan, which the path reads more than once: written.
    e = checkpoint(J.entry_prices(s, clean(t), fallback_ms=None))
    left = S.AFTERHOURS_END_MS - S.ms_of_day(S.to_et_ms("entry_ms"))
    e = e.withColumn("entry_id", F.concat_ws("-", "ticker", F.col("date").cast("string"))).withColumn("session_end_ms", F.col("entry_ms") + left)
    return X.partial_exits(X.price_path(e, clean(t), include_entry=True), config, ("date", "event_name"))


_BT_PATH = """SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY ts_ms, seq) AS step FROM (
  SELECT e.*, c.ts_ms, c.seq, c.price AS px FROM (
    SELECT ticker || '-' || CAST(date AS VARCHAR) AS entry_id, date, ticker, event_name, entry_ms, price AS entry_price, entry_ms + 72000000 - et % 86400000 AS session_end_ms FROM (
      SELECT s.date, s.ticker, s.event_name, s.entry_ms, arg_max(c.price, (c.ts_ms, c.seq)) AS price,
        any_value(epoch_us(timezone('America/New_York', timezone('UTC', make_timestamp(s.entry_ms * 1000)))) // 1000) AS et
      FROM stage_entries s JOIN clean c ON c.ticker = s.ticker AND c.ts_ms <= s.entry_ms GROUP BY 1, 2, 3, 4)) e
  JOIN clean c ON c.ticker = e.ticker AND c.ts_ms >= e.entry_ms AND c.ts_ms <= e.session_end_ms)"""
fragment("bt_path", _BT_PATH)


@query(
    "E5_rule_backtest",
    f"""SELECT p.entry_id, p.event_name, p.entry_ms, p.return_pct, exit_ms FROM (
      SELECT b.entry_id, b.event_name, b.entry_ms, coalesce(arg_min(b.gain, b.step) FILTER (b.gain >= 10 OR b.gain <= -15), arg_max(b.gain, b.step)) AS return_pct,
        coalesce(min(b.ts_ms) FILTER (b.step = b.f), max(b.ts_ms)) AS exit_ms FROM (
        SELECT *, min(step) FILTER (gain >= 10 OR gain <= -15) OVER (PARTITION BY entry_id) AS f FROM (SELECT *, (px - entry_price) / entry_price * 100 AS gain FROM bt_path)) b GROUP BY 1, 2, 3) p""",
    "return_pct",
)
def _(t):
    return backtest(t).select("entry_id", "event_name", "entry_ms", "return_pct", "exit_ms")


# Batch mode: the factor table gains signal densities, rules may use them, and the first rule that ever matches wins.
DENSITY = (("trade_rate", 2.0, 12 * HOUR, "signal_density_12h"), ("trade_rate", 3.0, 4 * HOUR, "signal_density_4h"))
DENSE_RULES = (rule("dense_rate", ("signal_density_12h", "gte", 6.0), ("signal_density_4h", "gte", 1.0), ("trade_rate", "gt", 2.0)), *ENTRY)
_DENSE_SQL = {"dense_rate": "(signal_density_12h >= 6 AND signal_density_4h >= 1 AND trade_rate > 2.0)"} | RULE_SQL
fragment(
    "dense_staged",
    "SELECT s.*, " + ", ".join(f"d.{name}" for *_, name in DENSITY) + " FROM staged s JOIN (SELECT ticker, ts_ms, "
    + ", ".join(f"CAST(sum(CASE WHEN {f} > {x} THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts_ms RANGE BETWEEN {ms - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) AS {name}" for f, x, ms, name in DENSITY)
    + " FROM event_table) d USING (ticker, ts_ms)",
)
fragment(
    "dense_hits",
    "SELECT r.*, watch_ms, watch_event FROM (" + " UNION ALL ".join(f"SELECT *, {i} AS i, '{n}' AS rule FROM dense_staged WHERE {x}" for i, (n, x) in enumerate(_DENSE_SQL.items()))
    + f") r JOIN watched USING (date, ticker) WHERE ts_ms >= watch_ms AND ts_ms - watch_ms <= {TIMEOUT} AND NOT {ANTI_SQL}",
)
fragment("dense_entries", "SELECT date, ticker, any_value(watch_ms) AS watch_ms, any_value(watch_event) AS watch_event, arg_min(ts_ms, (i, ts_ms)) AS entry_ms, arg_min(rule, (i, ts_ms)) AS event_name FROM dense_hits GROUP BY 1, 2")
fragment("dense_path", _BT_PATH.replace("stage_entries", "dense_entries"))


def dense_signals(t):
    f = E.with_signal_density(event_table(t), DENSITY)
    c = candidates(t).select("date", "ticker", "first_entry_ms", F.col("gain_at_entry").alias("entry_gap_pct"))
    rows = f.join(c, ["date", "ticker"]).filter("ts_ms >= first_entry_ms").drop("first_entry_ms")
    return E.stage_signals(rows, candidates(t), WATCH, DENSE_RULES, ANTI, TIMEOUT, ("date", "ticker"), rule_order_first=True)


@query("E5_signal_density", "SELECT ticker, ts_ms, " + ", ".join(n for *_, n in DENSITY) + " FROM dense_staged", " ".join(n for *_, n in DENSITY))
def _(t):
    c = candidates(t).select("date", "ticker", "first_entry_ms")
    rows = E.with_signal_density(event_table(t), DENSITY).join(c, ["date", "ticker"]).filter("ts_ms >= first_entry_ms")
    return rows.select("ticker", "ts_ms", *[n for *_, n in DENSITY])


@query("E5_density_entries", "SELECT * FROM dense_entries")
def _(t):
    return dense_signals(t)


@query(
    "E5_batch_backtest",
    """SELECT b.entry_id, b.event_name, b.entry_ms, coalesce(arg_min(b.gain, b.step) FILTER (b.gain >= 10 OR b.gain <= -15), arg_max(b.gain, b.step)) AS return_pct,
      coalesce(min(b.ts_ms) FILTER (b.step = b.f), max(b.ts_ms)) AS exit_ms FROM (
      SELECT *, min(step) FILTER (gain >= 10 OR gain <= -15) OVER (PARTITION BY entry_id) AS f FROM (SELECT *, (px - entry_price) / entry_price * 100 AS gain FROM dense_path)) b GROUP BY 1, 2, 3""",
    "return_pct",
)
def _(t):
    return walked(t, dense_signals(t)).select("entry_id", "event_name", "entry_ms", "return_pct", "exit_ms")
