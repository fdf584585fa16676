"""Research statistics over samples derived from the line items (factors: quantity, price, discount, tax)."""

from pyspark.sql import functions as F

from tapewright.operators import exits as X, stats as R
from tapewright.plans.ctes import fragment
from tapewright.functions.rules import any_of
from tapewright.plans.q_events import ANTI, ANTI_SQL, ENTRY, TIMEOUT, WATCH, _stage_sql, candidates, event_table, staged
from tapewright.plans.q_exits import H9, PARTIALS, entries, outcome_table, path, union_partials
from tapewright.plans.q_gates import SNAP_NAMES, entry_snapshot
from tapewright.plans.q_ticks import clean
from tapewright.plans.registry import query
from tapewright.operators import events as E, research as Q, ticks as K

FACTORS = ["quantity", "price", "discount", "tax"]
TIER_SQL = "CASE WHEN max_ret <= 0 THEN 'loser' WHEN max_ret <= 10 THEN 'flat' WHEN max_ret <= 20 THEN 'small' WHEN max_ret <= 50 THEN 'medium' ELSE 'big' END"
fragment("tiered", f"SELECT *, {TIER_SQL} AS tier, CASE WHEN date < DATE '1998-07-01' THEN 'explore' ELSE 'validate' END AS split FROM samples")
WIN_SQL = "tier IN ('big', 'medium')"


def tiered(t):
    split = F.when(F.col("date") < F.lit("1998-07-01").cast("date"), "explore").otherwise("validate")
    return R.with_tier(t.samples()).withColumn("split", split)


def _avg_rank(col, part=""):
    """SQL of an average rank."""
    p = f"PARTITION BY {part} " if part else ""
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER (PARTITION BY {(part + ', ') if part else ''}{col}) - 1) / 2.0)"


@query("R1_spearman", f"SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {_avg_rank('quantity')} AS rx, {_avg_rank('ret')} AS ry FROM samples)", "rho")
def _(t):
    return R.spearman(t.samples(), "quantity", "ret")


@query("R1_pearson", "SELECT count(*) AS n, corr(price, ret) AS rho FROM samples", "rho")
def _(t):
    return R.pearson(t.samples(), "price", "ret")


# Student's two-sided tail: one less the density from -t to t, by Simpson's rule over 2,000 strips of half of it.
_TAIL = """SELECT n, rho, 1 - 2 * any_value(t) / 6000 * sum(c * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(t * i / 2000, 2) / v, -(v + 1) / 2)) AS p_value FROM (
    SELECT n, rho, CAST(n - 2 AS DOUBLE) AS v, abs(rho) * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300)) AS t FROM ({stat})),
    (SELECT i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM range(2001) r(i)) GROUP BY n, rho"""


@query(
    "R1_spearman_p_value",
    _TAIL.format(stat=f"SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {_avg_rank('discount')} AS rx, {_avg_rank('ret')} AS ry FROM samples)"),
    "rho p_value",
)
def _(t):
    return R.spearman(t.samples(), "discount", "ret", p_value=True)


_DESC = "count(*) AS n, avg(ret) AS mean, median(ret) AS median, stddev_pop(ret) AS std, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS pos_rate, quantile_cont(ret, 0.95) AS p95, quantile_cont(ret, 0.05) AS p05"


@query(
    "R2_quantile_buckets",
    f"""WITH e AS (SELECT quantile_cont(price, 0.2) AS a, quantile_cont(price, 0.4) AS b, quantile_cont(price, 0.6) AS c, quantile_cont(price, 0.8) AS d FROM samples),
      x AS (SELECT price, ret, CAST(price > a AS INTEGER) + CAST(price > b AS INTEGER) + CAST(price > c AS INTEGER) + CAST(price > d AS INTEGER) AS bucket FROM samples, e)
    SELECT bucket, min(price) AS lo, max(price) AS hi, {_DESC} FROM (SELECT * FROM x UNION ALL SELECT price, ret, -1 FROM x) GROUP BY 1""",
    "lo hi mean median std pos_rate p95 p05",
)
def _(t):
    return R.quantile_buckets(t.samples(), "price", "ret")


@query(
    "R3_equal_count_slices",
    """SELECT CAST(i + 1 AS INTEGER) AS slice, count(*) AS n, avg(ret) AS mean, median(ret) AS median, stddev_samp(ret) AS std, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS pos_rate
    FROM (SELECT ret, row_number() OVER (ORDER BY quantity, ret) - 1 AS r, count(*) OVER () AS n FROM samples) JOIN (SELECT unnest(range(5)) AS i) g ON r >= n * i // 5 AND r < n * (i + 1) // 5 GROUP BY 1""",
    "mean median std pos_rate",
)
def _(t):
    return R.equal_count_slices(t.samples(), "quantity", "ret").withColumn("slice", F.col("slice").cast("int"))


@query(
    "R3_per_symbol_correlation",
    f"""SELECT count(*) AS n_symbols, count(*) FILTER (rho > 0) AS n_positive, avg(rho) AS mean_rho FROM (
      SELECT symbol, corr(rx, ry) AS rho FROM (SELECT symbol, {_avg_rank('discount', 'symbol')} AS rx, {_avg_rank('ret', 'symbol')} AS ry FROM samples) GROUP BY 1 HAVING count(*) >= 5)""",
    "mean_rho",
)
def _(t):
    return R.per_symbol_correlation(t.samples(), "discount", "ret")


_LONGF = " UNION ALL ".join(f"SELECT *, '{f}' AS factor, CAST({f} AS DOUBLE) AS x FROM tiered" for f in FACTORS)
fragment("long_samples", _LONGF)


@query(
    "R4_welch_cohen",
    """SELECT factor, n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(vs_a / n_a + vs_b / n_b) AS t_stat, coalesce((mean_a - mean_b) / nullif(sqrt((vp_a + vp_b) / 2), 0), 0) AS cohens_d FROM (
      SELECT factor, count(x) FILTER (tier = 'big') AS n_a, count(x) FILTER (tier = 'flat') AS n_b, avg(x) FILTER (tier = 'big') AS mean_a, avg(x) FILTER (tier = 'flat') AS mean_b,
        var_samp(x) FILTER (tier = 'big') AS vs_a, var_samp(x) FILTER (tier = 'flat') AS vs_b, var_pop(x) FILTER (tier = 'big') AS vp_a, var_pop(x) FILTER (tier = 'flat') AS vp_b
      FROM long_samples GROUP BY 1)""",
    "mean_a mean_b t_stat cohens_d",
)
def _(t):
    return R.welch(tiered(t), FACTORS, "tier", "big", "flat")


@query("R5_outcome_tiers", "SELECT tier, count(*) AS n FROM tiered GROUP BY 1")
def _(t):
    return tiered(t).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "R6_distribution_by_tier",
    "SELECT factor, tier, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.25) AS q25, median(x) AS median, quantile_cont(x, 0.75) AS q75 FROM long_samples GROUP BY 1, 2",
    "mean std q25 median q75",
)
def _(t):
    return R.distribution_by(tiered(t), FACTORS, "tier")


@query(
    "R7_ks_statistic",
    """SELECT factor, max(abs(ca / na - cb / nb)) AS ks_stat, max(na) AS n_a, max(nb) AS n_b FROM (
      SELECT factor, CAST(sum(a) OVER w AS BIGINT) AS ca, CAST(sum(b) OVER w AS BIGINT) AS cb, CAST(sum(a) OVER (PARTITION BY factor) AS BIGINT) AS na, CAST(sum(b) OVER (PARTITION BY factor) AS BIGINT) AS nb FROM (
        SELECT factor, x, count(*) FILTER (tier = 'big') AS a, count(*) FILTER (tier = 'flat') AS b FROM long_samples GROUP BY 1, 2) WINDOW w AS (PARTITION BY factor ORDER BY x)) GROUP BY 1""",
    "ks_stat",
)
def _(t):
    return R.ks_two_sample(tiered(t), FACTORS, F.col("tier") == "big", F.col("tier") == "flat")


@query(
    "R8_single_factor_auc",
    f"""SELECT factor, np AS n_pos, nn AS n_neg, greatest(auc, 1 - auc) AS auc FROM (
      SELECT factor, count(*) FILTER ({WIN_SQL}) AS np, count(*) FILTER (NOT {WIN_SQL}) AS nn,
        (sum(r) FILTER ({WIN_SQL}) - count(*) FILTER ({WIN_SQL}) * (count(*) FILTER ({WIN_SQL}) + 1) / 2) / (CAST(count(*) FILTER ({WIN_SQL}) AS DOUBLE) * count(*) FILTER (NOT {WIN_SQL})) AS auc
      FROM (SELECT factor, tier, {_avg_rank('x', 'factor')} AS r FROM long_samples) GROUP BY 1)""",
    "auc",
)
def _(t):
    return R.single_factor_auc(tiered(t), FACTORS, F.col("tier").isin(*R.WINNERS))


TH = (5.0, 10.0, 20.0, 30.0, 40.0, 49.0)
_TV = ", ".join(f"({x}::DOUBLE)" for x in TH)


@query(
    "R9_threshold_sensitivity",
    f"""SELECT th AS threshold, count(*) AS n_signals, avg(CASE WHEN {WIN_SQL} THEN 1.0 ELSE 0 END) AS precision, count(*) FILTER ({WIN_SQL}) / (SELECT count(*) FROM tiered WHERE {WIN_SQL}) AS recall, avg(max_ret) AS avg_return
    FROM tiered, (VALUES {_TV}) v(th) WHERE quantity > th GROUP BY 1 HAVING count(*) >= 5""",
    "threshold precision recall avg_return",
)
def _(t):
    return R.threshold_sensitivity(tiered(t), "quantity", TH)


MF = ["quantity", "discount", "tax"]
_MG = {"quantity": (10.0, 25.0, 40.0), "discount": (0.02, 0.05, 0.08)}
fragment(
    "matrix",
    f"""SELECT q.v AS quantity, d.v AS discount, x.v AS tax, count(*) AS n_signals, avg(CASE WHEN {WIN_SQL} THEN 1.0 ELSE 0 END) AS precision,
      count(*) FILTER ({WIN_SQL}) / (SELECT count(*) FROM tiered WHERE {WIN_SQL}) AS recall, avg(max_ret) AS avg_return
    FROM tiered s JOIN (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (40.0::DOUBLE)) q(v) ON s.quantity > q.v JOIN (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.08::DOUBLE)) d(v) ON s.discount > d.v
      JOIN (SELECT unnest(quantile_cont(tax, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v, unnest(range(5)) AS i FROM samples) x ON s.tax > x.v GROUP BY q.v, d.v, x.v, x.i HAVING count(*) >= 5""",
)
MAT_F = "quantity discount tax precision recall avg_return"


def matrix(t):
    return R.condition_matrix(tiered(t), MF, _MG)


@query("R10_condition_matrix", "SELECT * FROM matrix", MAT_F)
def _(t):
    return matrix(t)


@query(
    "R10_condition_medians",
    """SELECT q.v AS quantity, d.v AS discount, median(max_ret) AS median_return FROM tiered s JOIN (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (40.0::DOUBLE)) q(v) ON s.quantity > q.v
    JOIN (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.08::DOUBLE)) d(v) ON s.discount > d.v GROUP BY 1, 2""",
    "quantity discount median_return",
)
def _(t):
    return R.condition_medians(tiered(t), list(_MG), _MG)


fragment("frontier", """SELECT * FROM matrix a WHERE NOT EXISTS (SELECT 1 FROM matrix b WHERE b.recall >= a.recall AND b.precision >= a.precision AND (b.recall > a.recall OR b.precision > a.precision))""")


@query("R11_pareto_frontier", "SELECT * FROM frontier", MAT_F)
def _(t):
    return R.pareto_frontier(matrix(t))


@query("R12_locate_configuration", "SELECT * FROM matrix WHERE quantity = 25 AND discount = 0.05::DOUBLE", MAT_F)
def _(t):
    return R.locate(matrix(t), {"quantity": 25.0, "discount": 0.05})


def variants():
    q, d, x = F.col("quantity"), F.col("discount"), F.col("tax")
    return {"loose": q > 10, "middle": (q > 25) & (d > 0.02), "tight": (q > 40) & (d > 0.05) & (x < 0.06)}


VAR_SQL = {"loose": "quantity > 10", "middle": "quantity > 25 AND discount > 0.02::DOUBLE", "tight": "quantity > 40 AND discount > 0.05::DOUBLE AND tax < 0.06::DOUBLE"}


def _variant_sql(keys=""):
    k = f"{keys}, " if keys else ""
    parts = [
        f"SELECT {k}'{n}' AS variant, count(*) FILTER ({c}) AS n_signals, count(*) FILTER ({c} AND {WIN_SQL}) / nullif(count(*) FILTER ({c}), 0) AS precision, coalesce(count(*) FILTER ({c} AND {WIN_SQL}) / nullif(count(*) FILTER ({WIN_SQL}), 0), 0) AS recall,"
        f" avg(max_ret) FILTER ({c}) AS avg_return, avg(CASE WHEN max_ret > 0 THEN 1.0 ELSE 0 END) FILTER ({c}) AS win_rate FROM tiered {'GROUP BY ' + keys if keys else ''}"
        for n, c in VAR_SQL.items()
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_signals >= 5"


VF = "precision recall avg_return win_rate"


@query("R13_variants", _variant_sql(), VF)
def _(t):
    return R.evaluate_variants(tiered(t), variants())


@query("R13_variants_by_date", _variant_sql("date"), VF)
def _(t):
    return R.evaluate_variants(tiered(t), variants(), keys=("date",))


@query("R14_best_thresholds", "SELECT * FROM matrix WHERE n_signals >= 10 ORDER BY round(precision, 9) DESC, n_signals DESC, quantity, discount, tax LIMIT 1", MAT_F)
def _(t):
    m = matrix(t)
    return R.best_thresholds(m.withColumn("precision", F.round("precision", 9)))


fragment("split_eval", _variant_sql("split"))
_M4 = ("precision", "recall", "avg_return", "win_rate")


@query(
    "R15_split_deltas",
    "SELECT variant, " + ", ".join(f"max({m}) FILTER (split = 'explore') AS explore_{m}, max({m}) FILTER (split = 'validate') AS validate_{m}, max({m}) FILTER (split = 'validate') - max({m}) FILTER (split = 'explore') AS delta_{m}" for m in _M4) + " FROM split_eval GROUP BY 1",
    " ".join(f"{p}_{m}" for m in _M4 for p in ("explore", "validate", "delta")),
)
def _(t):
    return R.split_deltas(tiered(t), variants(), "split", "explore", "validate")


@query(
    "R15_date_mean_t_test",
    """SELECT ne AS n_e, nv AS n_v, me AS mean_e, mv AS mean_v, (me - mv) / sqrt(((ne - 1) * ve + (nv - 1) * vv) / (ne + nv - 2) * (1.0 / ne + 1.0 / nv)) AS t_stat, ne + nv - 2 AS dof FROM (
      SELECT count(m) FILTER (split = 'explore') AS ne, count(m) FILTER (split = 'validate') AS nv, avg(m) FILTER (split = 'explore') AS me, avg(m) FILTER (split = 'validate') AS mv,
        var_samp(m) FILTER (split = 'explore') AS ve, var_samp(m) FILTER (split = 'validate') AS vv FROM (SELECT split, date, avg(max_ret) AS m FROM tiered WHERE quantity > 25 GROUP BY 1, 2))""",
    "mean_e mean_v t_stat",
)
def _(t):
    return R.date_mean_t_test(tiered(t), F.col("quantity") > 25, "split", "explore", "validate")


# --- slices over observation outcomes ----------------------------------------------------------------

_BIN = "CASE WHEN score >= 8 THEN '8-10' WHEN score >= 6 THEN '6-7' WHEN score >= 4 THEN '4-5' ELSE '1-3' END"
SLICES = {
    "score_bucket": (lambda: R.score_bucket(), _BIN),
    "verdict": (lambda: F.when(F.col("verdict") == "YES", "catalyst").otherwise("non-catalyst"), "CASE WHEN verdict = 'YES' THEN 'catalyst' ELSE 'non-catalyst' END"),
    "source": (lambda: F.col("source"), "source"),
    "symbol": (lambda: F.col("ticker"), "ticker"),
    "date": (lambda: F.to_date(F.timestamp_millis("trigger_ms")), "strftime(make_timestamp(trigger_ms * 1000), '%Y-%m-%d')"),
    "lang": (lambda: F.col("lang"), "lang"),
}
fragment("obs_outcomes", "SELECT o.*, d.* EXCLUDE (obs_id) FROM outcomes o JOIN dense_observations d USING (obs_id)")
SL_F = "avg_return avg_max_return win_rate hit_rate_gt_5pct hit_rate_gt_10pct hit_rate_gt_20pct hit_rate_gt_50pct"


def _slice_sql(dim, key):
    hits = ", ".join(f"coalesce(avg(CASE WHEN max_return_24h >= {x / 100} THEN 1.0 WHEN max_return_24h IS NOT NULL THEN 0 END), 0) AS hit_rate_gt_{x}pct" for x in (5, 10, 20, 50))
    return f"""SELECT '{dim}' AS dimension, {key} AS label, count(*) AS count, coalesce(avg(return_24h), 0) AS avg_return, coalesce(avg(max_return_24h), 0) AS avg_max_return,
      coalesce(avg(CASE WHEN return_24h > 0 THEN 1.0 WHEN return_24h IS NOT NULL THEN 0 END), 0) AS win_rate, {hits} FROM obs_outcomes GROUP BY 2"""


@query("R16_slices", " UNION ALL ".join(_slice_sql(d, k) for d, (_, k) in SLICES.items()), SL_F)
def _(t):
    o = outcome_table(t)
    out = None
    for dim, (key, _) in SLICES.items():
        part = R.slice_metrics(o, key(), dim, "return_24h", "max_return_24h")
        out = part if out is None else out.unionByName(part)
    return out


@query("U5_custom_slice_key", _slice_sql("custom", "CAST(score AS VARCHAR)"), SL_F)
def _(t):
    return R.slice_metrics(outcome_table(t), F.col("score"), "custom", "return_24h", "max_return_24h")


@query("R17_best_per_symbol", "SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, trigger_ms) = 1")
def _(t):
    return R.best_per_symbol(t.observations())


@query(
    "R18_slice_report",
    f"SELECT label, CAST(pos AS INTEGER) AS pos, obs_id, max_return_24h FROM (SELECT {_BIN} AS label, obs_id, max_return_24h, row_number() OVER (PARTITION BY {_BIN} ORDER BY max_return_24h DESC NULLS LAST, obs_id) AS pos FROM obs_outcomes) WHERE pos <= 5",
    "max_return_24h",
)
def _(t):
    return R.top_per_slice(outcome_table(t), R.score_bucket(), "max_return_24h").select("label", "pos", "obs_id", "max_return_24h")


# --- experiments: the scaled-exit results, one experiment per configuration ---------------------------

fragment("exp_signals", "SELECT p.*, e.date, e.ticker FROM partials p JOIN entries e USING (entry_id)")


def exp_signals(t):
    return union_partials(path(t), PARTIALS).withColumnRenamed("strategy", "experiment_id")


_STAT = "count(*) AS n, avg(return_pct) AS avg_return, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate"


@query("R19_experiments", f"SELECT strategy AS experiment_id, min(date) AS date, {_STAT} FROM exp_signals GROUP BY 1", "avg_return win_rate")
def _(t):
    return Q.experiment_stats(exp_signals(t), ["experiment_id"], first_date=True)


@query("R19_experiment_tickers", f"SELECT strategy AS experiment_id, ticker, {_STAT} FROM exp_signals GROUP BY 1, 2", "avg_return win_rate")
def _(t):
    return Q.experiment_stats(exp_signals(t), ["experiment_id", "ticker"])


@query(
    "R20_diagnostics",
    """SELECT strategy AS experiment_id, count(*) AS total_signals, avg(return_pct) AS avg_return, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(time_to_max_ms) / 1000 AS avg_time_to_max_sec,
      avg(time_to_min_ms) / 1000 AS avg_time_to_min_sec, avg((max_price - entry_price) / entry_price * 100) AS avg_mfe_pct, avg(abs((min_price - entry_price) / entry_price * 100)) AS avg_mae_pct,
      coalesce(avg((max_price - entry_price) / entry_price * 100) / nullif(avg(abs((min_price - entry_price) / entry_price * 100)), 0), 0) AS mfe_mae_ratio,
      count(*) FILTER (stop_loss_share > 0) AS n_stop, count(*) FILTER (take_profit_share > 0) AS n_take_profit, count(*) FILTER (close_share > 0) AS n_close
    FROM partials JOIN entries USING (entry_id) GROUP BY 1""",
    "avg_return win_rate avg_time_to_max_sec avg_time_to_min_sec avg_mfe_pct avg_mae_pct mfe_mae_ratio",
)
def _(t):
    return Q.diagnostics(exp_signals(t))


fragment("exp_factors", "SELECT p.strategy AS experiment_id, p.return_pct, p.time_to_max_ms, s.* FROM partials p JOIN entry_snap s USING (entry_id)")


def exp_factors(t):
    snap = entry_snapshot(t).select("entry_id", F.to_json(F.struct(*SNAP_NAMES)).alias("factors"))
    return exp_signals(t).join(snap, "entry_id")


@query(
    "R20_factor_correlations",
    " UNION ALL ".join(f"SELECT experiment_id, '{n}' AS factor, count({n}) AS n, corr({n}, return_pct) AS correlation FROM exp_factors WHERE {n} IS NOT NULL GROUP BY 1" for n in SNAP_NAMES),
    "correlation",
)
def _(t):
    return Q.factor_correlations(exp_factors(t))


@query(
    "R20_loss_patterns",
    " UNION ALL ".join(
        f"SELECT experiment_id, '{n}' AS pattern, count(*) AS n, avg(return_pct) AS avg_return FROM exp_factors WHERE return_pct < 0 AND {c} GROUP BY 1"
        for n, c in (("high_gap", "gap_percent > 8"), ("high_trade_rate", "trade_rate > 2.5"), ("early_max", "time_to_max_ms < 3600000"))
    ),
    "avg_return",
)
def _(t):
    return Q.loss_patterns(exp_factors(t), {"high_gap": ("gap_percent", 8.0), "high_trade_rate": ("trade_rate", 2.5)}, 3_600_000)


@query(
    "R21_winner_loser_factors",
    """SELECT factor, wm AS winner_mean, lm AS loser_mean, wd AS winner_median, ld AS loser_median, CASE WHEN lm <> 0 THEN (wm - lm) / abs(lm) * 100 END AS diff_pct FROM (
      SELECT factor, avg(x) FILTER (ret > 0) AS wm, avg(x) FILTER (ret <= 0) AS lm, median(x) FILTER (ret > 0) AS wd, median(x) FILTER (ret <= 0) AS ld FROM long_samples GROUP BY 1)""",
    "winner_mean loser_mean winner_median loser_median diff_pct",
)
def _(t):
    return Q.winner_loser_factors(tiered(t), FACTORS, "ret")


@query(
    "R22_mfe_histogram",
    """SELECT CASE WHEN mfe_pct < 0 THEN '<0' WHEN mfe_pct < 3 THEN '0-3' WHEN mfe_pct < 5 THEN '3-5' WHEN mfe_pct < 10 THEN '5-10' ELSE '10+' END AS bucket, count(*) AS n,
      count(*) FILTER (close_pct <= 0 AND mfe_pct >= 3) AS losers_with_mfe, avg(close_pct) AS mean_close FROM excursions GROUP BY 1""",
    "mean_close",
)
def _(t):
    return Q.mfe_histogram(X.excursions(entries(t), clean(t)))


HOURS = (2, 4, 8)
fragment("event_clean", f"SELECT ticker, ts_ms FROM event_table WHERE NOT {ANTI_SQL}")
fragment("stage_order", _stage_sql("(i, ts_ms)"))


@query(
    "R23_watch_timeouts",
    " UNION ALL ".join(
        f"SELECT CAST({h} AS BIGINT) AS timeout_h, count(*) AS n_entries, avg(d) AS mean_delay_min FROM (SELECT date, ticker, (min(ts_ms) - any_value(watch_ms)) / 60000 AS d FROM stage_hits WHERE ts_ms - watch_ms <= {h * 3_600_000} GROUP BY 1, 2)" for h in HOURS
    ),
    "mean_delay_min",
)
def _(t):
    w = E.watch(staged(t), candidates(t), WATCH, ("date", "ticker")).withColumn("timeout_h", F.explode(F.array(*[F.lit(h).cast("long") for h in HOURS])))
    keys = ("date", "ticker", "timeout_h")
    f = staged(t).join(w.select(*keys), ["date", "ticker"])
    e = E.entries(f, w, ENTRY, ANTI, F.col("timeout_h") * 3_600_000, keys)
    return e.groupBy("timeout_h").agg(F.count(F.lit(1)).alias("n_entries"), F.avg((F.col("entry_ms") - F.col("watch_ms")) / 60000.0).alias("mean_delay_min"))


@query(
    "R23_single_vs_two_stage",
    """SELECT 'two_stage' AS mode, count(*) AS n_entries FROM stage_entries UNION ALL
    SELECT 'single_stage', count(*) FROM (SELECT DISTINCT date, ticker FROM rule_matches SEMI JOIN (SELECT ticker, ts_ms FROM event_clean) USING (ticker, ts_ms))""",
)
def _(t):
    two = E.stage_signals(staged(t), candidates(t), WATCH, ENTRY, ANTI, TIMEOUT, ("date", "ticker")).agg(F.count(F.lit(1)).alias("n_entries")).select(F.lit("two_stage").alias("mode"), "n_entries")
    ev = event_table(t)
    one = ev.filter(any_of(ENTRY, ev.columns) & ~any_of(ANTI, ev.columns)).select("date", "ticker").distinct().agg(F.count(F.lit(1)).alias("n_entries")).select(F.lit("single_stage").alias("mode"), "n_entries")
    return two.unionByName(one)


@query(
    "R24_mode_comparison",
    """SELECT date, ticker, CASE WHEN a.event_name IS NULL THEN 'rule_order_only' WHEN b.event_name IS NULL THEN 'earliest_only' WHEN a.event_name = b.event_name AND a.entry_ms = b.entry_ms THEN 'same' ELSE 'different' END AS agreement
    FROM stage_entries a FULL JOIN stage_order b USING (date, ticker)""",
)
def _(t):
    keys = ("date", "ticker")
    args = (staged(t), candidates(t), WATCH, ENTRY, ANTI, TIMEOUT, keys)
    return Q.compare_signal_sets(E.stage_signals(*args), E.stage_signals(*args, rule_order_first=True), list(keys))


@query("R25_exits_by_date", f"SELECT strategy AS experiment_id, date, {_STAT} FROM exp_signals GROUP BY 1, 2", "avg_return win_rate")
def _(t):
    return Q.experiment_stats(exp_signals(t), ["experiment_id", "date"])


# --- extreme winners ---------------------------------------------------------------------------------

fragment("winners", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY max_ret DESC, sample_id) AS INTEGER) AS pos FROM tiered) WHERE pos <= 2")


@query("R26_extreme_winners", "SELECT date, sample_id, pos, max_ret FROM winners", "max_ret")
def _(t):
    return Q.extreme_winners(tiered(t)).select("date", "sample_id", "pos", "max_ret")


@query(
    "R26_factor_percentiles",
    """SELECT w.date, w.sample_id, w.factor, avg(CASE WHEN l.x < w.x THEN 1.0 ELSE 0 END) * 100 AS percentile FROM (SELECT w.date, w.sample_id, l.factor, l.x FROM winners w JOIN long_samples l USING (sample_id)) w
    JOIN long_samples l ON l.date = w.date AND l.factor = w.factor GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
    "percentile",
)
def _(t):
    return Q.winner_percentiles(tiered(t), FACTORS)


@query(
    "R27_filter_overlap",
    "SELECT w.date, w.sample_id, " + ", ".join(f"{c} AS {n}_pass, (SELECT count(*) FROM tiered d WHERE d.date = w.date AND {c.replace('quantity', 'd.quantity').replace('discount', 'd.discount').replace('tax', 'd.tax')}) AS {n}_day" for n, c in VAR_SQL.items()) + " FROM winners w",
)
def _(t):
    return Q.filter_overlap(tiered(t), variants())


@query(
    "R28_extreme_vs_rest",
    "SELECT date, count(*) AS n_total, count(*) FILTER (max_ret > 50) AS n_extreme, count(*) FILTER (max_ret > 0 AND max_ret <= 50) AS n_rest, "
    + ", ".join(f"avg({f}) FILTER (max_ret > 50) AS extreme_{f}, avg({f}) FILTER (max_ret > 0 AND max_ret <= 50) AS rest_{f}" for f in ("ret", *FACTORS)) + " FROM tiered GROUP BY 1",
    " ".join(f"extreme_{f} rest_{f}" for f in ("ret", *FACTORS)),
)
def _(t):
    return Q.extreme_vs_rest(tiered(t), ("ret", *FACTORS), 50.0)


fragment(
    "composite",
    """SELECT *, (rank() OVER (PARTITION BY date ORDER BY round(c, 9) DESC) ) AS overall FROM (SELECT date, sample_id, n, rq, rp, rd, 0.4 * rq + 0.3 * rp + 0.3 * rd AS c FROM (
      SELECT date, sample_id, count(*) OVER (PARTITION BY date) AS n,
        (rank() OVER (PARTITION BY date ORDER BY quantity DESC) + (count(*) OVER (PARTITION BY date, quantity) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS rq,
        (rank() OVER (PARTITION BY date ORDER BY price DESC) + (count(*) OVER (PARTITION BY date, price) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS rp,
        (rank() OVER (PARTITION BY date ORDER BY discount DESC) + (count(*) OVER (PARTITION BY date, discount) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS rd FROM tiered))""",
)


@query("R29_composite_rank", "SELECT w.date, w.sample_id, n AS n_total, rq AS quantity_pct, rp AS price_pct, rd AS discount_pct, c AS composite, CAST(overall AS INTEGER) AS overall_rank FROM winners w JOIN composite USING (sample_id)", "quantity_pct price_pct discount_pct composite")
def _(t):
    return Q.composite_rank(tiered(t), {"quantity": 0.4, "price": 0.3, "discount": 0.3})


@query(
    "R30_mask_evaluation",
    """SELECT date, n, mean_return, win_rate, best, CASE WHEN best IS NOT NULL THEN best_ret END AS best_return FROM (SELECT date, count(*) AS n, avg(ret) AS mean_return, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate,
      arg_max(sample_id, (max_ret, sample_id)) AS best, max(max_ret) AS best_ret FROM tiered WHERE quantity > 30 AND discount > 0.05::DOUBLE GROUP BY 1)""",
    "mean_return win_rate best_return",
)
def _(t):
    return Q.mask_by_date(tiered(t), (F.col("quantity") > 30) & (F.col("discount") > 0.05))


fragment(
    "cuts",
    "SELECT " + ", ".join(f"median({f}) FILTER (pos) > median({f}) FILTER (NOT pos) AS up_{f}, min({f}) FILTER (pos) AS lo_{f}, max({f}) FILTER (pos) AS hi_{f}" for f in FACTORS)
    + " FROM (SELECT *, max_ret > 40 AND linenumber = 1 AS pos FROM tiered)",
)
_CUT = " AND ".join(f"CASE WHEN up_{f} THEN {f} >= lo_{f} ELSE {f} <= hi_{f} END" for f in FACTORS)
fragment("survivors", f"SELECT s.* FROM tiered s JOIN cuts ON TRUE WHERE NOT (max_ret > 40 AND linenumber = 1) AND {_CUT}")


def positive():
    return (F.col("max_ret") > 40) & (F.col("linenumber") == 1)


@query("R31_recall_cuts", "SELECT sample_id, price, tax FROM survivors", "price tax")
def _(t):
    return Q.recall_cuts(tiered(t), FACTORS, positive()).select("sample_id", "price", "tax")


@query(
    "J17_hard_cases",
    """SELECT s.sample_id, s.symbol, s_name, 'HARD_FALSE' AS review_flag FROM survivors s LEFT JOIN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, s_name FROM supplier) p USING (symbol)
    UNION ALL SELECT s.sample_id, s.symbol, s_name, 'TRUE_MOMO' FROM tiered s LEFT JOIN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, s_name FROM supplier) p USING (symbol) WHERE max_ret > 40 AND linenumber = 1""",
)
def _(t):
    d = tiered(t)
    prof = t.read("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), "s_name")
    return Q.hard_cases(Q.recall_cuts(d, FACTORS, positive()), d.filter(positive()), prof).select("sample_id", "symbol", "s_name", "review_flag")


@query(
    "R32_dense_signals",
    """SELECT s.seq, s.ticker, s.ts_ms, any_value(s.price) AS entry_price, coalesce(arg_max(c.price, (c.ts_ms, c.seq)), any_value(s.price)) AS last_price, greatest(any_value(s.price), max(c.price)) AS max_price
    FROM clean s LEFT JOIN clean c ON c.ticker = s.ticker AND c.ts_ms > s.ts_ms AND c.ts_ms <= s.ts_ms + 7200000
    WHERE s.ts_ms % 7200000 <= 3600000 AND s.et_ms % 86400000 < 32400000 AND s.et_ms % 86400000 >= 25200000 GROUP BY 1, 2, 3""",
    "entry_price last_price max_price",
)
def _(t):
    return Q.dense_signals(K.drop_delayed(t.trades()), 7_200_000, 3_600_000, 7_200_000)


@query("R33_sample_stats", f"SELECT count(*) AS n, count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date, avg(ret) AS mean_ret, count(*) FILTER (tier = 'big') AS n_big, count(*) FILTER (tier = 'medium') AS n_medium, count(*) FILTER (tier = 'small') AS n_small, count(*) FILTER (tier = 'flat') AS n_flat, count(*) FILTER (tier = 'loser') AS n_loser FROM tiered", "mean_ret")
def _(t):
    return Q.sample_stats(tiered(t))


fragment(
    "delayed",
    """SELECT ticker, count(*) AS n_trades, count(*) FILTER (exchange = 4) AS n_off_exchange, count(*) FILTER (exchange = 4 AND sip_ns - part_ns > 1000000000) AS n_delayed,
      count(*) FILTER (exchange = 4 AND sip_ns - part_ns > 1000000000) / count(*) AS delayed_share FROM wide_trades GROUP BY 1""",
)


@query("R34_ticker_strata", "SELECT p.ticker, CASE WHEN float_shares > 25000000 AND delayed_share < 0.10 THEN 'clean' WHEN float_shares > 25000000 THEN 'delayed' ELSE 'low_float' END AS stratum, delayed_share FROM profiles p JOIN delayed d USING (ticker)", "delayed_share")
def _(t):
    return Q.ticker_strata(t.profiles(), Q.delayed_share(t.wide_trades()), 25_000_000)


@query("R35_mining_search", "SELECT * FROM matrix WHERE n_signals >= 30 AND precision >= 0.7 AND recall >= 0.05 AND avg_return > 30", MAT_F)
def _(t):
    return Q.mining_gates(matrix(t), 30, 0.7, 0.05, 30.0)


@query("R36_ticker_performance", "SELECT symbol, count(*) AS n, avg(ret) AS mean_ret, avg(max_ret) AS mean_max_ret, stddev_samp(ret) AS std_ret, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate, max(max_ret) AS best FROM samples GROUP BY 1", "mean_ret mean_max_ret std_ret win_rate best")
def _(t):
    return Q.symbol_performance(t.samples())


@query("R37_delayed_report_share", "SELECT * FROM delayed", "delayed_share")
def _(t):
    return Q.delayed_share(t.wide_trades())
