"""Training samples, splits, models and evaluation over the line-item samples."""

from pyspark.sql import functions as F

from tapewright.functions.rules import Condition, Rule
from tapewright.operators import events as E, joins as J, research as R, ticks as K, training as L
from tapewright.plans.ctes import fragment
from tapewright.plans.q_events import event_table
from tapewright.plans.q_exits import HZ
from tapewright.plans.q_joins import signals
from tapewright.plans.q_ticks import clean
from tapewright.plans.q_stats import tiered
from tapewright.plans.registry import query
from tapewright.operators.ignition import factor_snapshot

FACTORS = ["quantity", "price", "discount", "tax"]
SIG = ["trade_rate", "relative_volume", "aggressor_ratio"]
H = 3_600_000


def signal_rows(t):
    """Signals with their six-hour return and their factors as JSON."""
    s = J.forward_returns(J.entry_prices(signals(t), clean(t), fallback_ms=None), clean(t), {"6h": HZ["6h"]}, ts="entry_ms", price="entry_price")
    f = factor_snapshot(event_table(t), s, SIG, "entry_ms", H, 12)
    return f.select("signal_id", "ticker", F.col("entry_ms").alias("ts_ms"), F.col("fwd_6h").alias("return_6h"), F.to_json(F.struct(*SIG)).alias("factors"))


_SNAP = ", ".join(f"arg_max(f.{n}, f.ts_ms) FILTER (f.{n} IS NOT NULL AND f.ts_ms >= g.at - {12 * H}) AS {n}" for n in SIG)


@query(
    "L1_signal_samples",
    f"""SELECT g.signal_id, g.ticker, g.entry_ms AS ts_ms, any_value(r.ret) AS return_pct, {_SNAP} FROM (
      SELECT s.signal_id, s.ticker, s.entry_ms, max(e.ts_ms) AS at FROM signals s LEFT JOIN event_table e ON e.ticker = s.ticker AND e.ts_ms <= s.entry_ms GROUP BY 1, 2, 3) g
    JOIN (SELECT s.signal_id, (arg_max(c.price, (c.ts_ms, c.seq)) / any_value(p.price) - 1) * 100 AS ret FROM signals s JOIN clean p ON p.seq = s.signal_id JOIN clean c ON c.ticker = s.ticker AND c.ts_ms > s.entry_ms AND c.ts_ms <= s.entry_ms + {6 * H} GROUP BY 1) r ON r.signal_id = g.signal_id
    LEFT JOIN event_table f ON f.ticker = g.ticker AND f.ts_ms <= g.at GROUP BY 1, 2, 3""",
    "return_pct " + " ".join(SIG),
)
def _(t):
    return L.samples_from_signals(signal_rows(t), "return_6h", SIG)


@query(
    "L2_dense_samples",
    """SELECT s.seq, s.ticker, coalesce((arg_max(c.price, (c.ts_ms, c.seq)) / any_value(s.price) - 1) * 100, 0) AS return_pct, (greatest(any_value(s.price), max(c.price)) / any_value(s.price) - 1) * 100 AS max_return_pct
    FROM clean s LEFT JOIN clean c ON c.ticker = s.ticker AND c.ts_ms > s.ts_ms AND c.ts_ms <= s.ts_ms + 7200000
    WHERE s.ts_ms % 7200000 <= 3600000 AND s.et_ms % 86400000 < 32400000 AND s.et_ms % 86400000 >= 25200000 GROUP BY 1, 2""",
    "return_pct max_return_pct",
)
def _(t):
    d = R.dense_signals(K.drop_delayed(t.trades()), 7_200_000, 3_600_000, 7_200_000)
    pct = lambda c: (F.col(c) - F.col("entry_price")) / F.col("entry_price") * 100
    return d.select("seq", "ticker", pct("last_price").alias("return_pct"), pct("max_price").alias("max_return_pct"))


TEST_DATES = ("1996-03-01", "1997-05-12", "1999-10-20")


@query("L3_split_by_dates", f"SELECT CASE WHEN date IN ({', '.join(f'DATE {chr(39)}{d}{chr(39)}' for d in TEST_DATES)}) THEN 'test' ELSE 'train' END AS part, count(*) AS n, avg(ret) AS mean_ret FROM samples GROUP BY 1", "mean_ret")
def _(t):
    return L.split_by_dates(t.samples(), TEST_DATES).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))


@query("L3_split_by_ratio", "SELECT CASE WHEN CAST('0x' || substr(md5(sample_id || ':42'), 1, 8) AS BIGINT) < 0.3 * 4294967296 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM samples GROUP BY 1")
def _(t):
    return L.split_by_ratio(t.samples(), "sample_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "L4_date_folds",
    """SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM samples JOIN (
      SELECT date, least((dense_rank() OVER (ORDER BY date) - 1) // (count(*) OVER () // 5), 4) AS fold FROM (SELECT DISTINCT date FROM samples)) USING (date) GROUP BY 1""",
)
def _(t):
    f = L.date_folds(t.samples(), 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def split(t):
    s = L.split_by_ratio(t.samples(), "sample_id")
    return s.filter("part = 'train'"), s.filter("part = 'test'")


@query("L5_ridge_metrics")
def _(t):
    tr, te = split(t)
    m = L.train(tr, FACTORS, "ret")
    w = L.importance(m, FACTORS)
    fit = L.model_fit(L.score(m, te, FACTORS), "prediction", "ret")
    return fit.select("*", *[F.lit(v).alias(f"importance_{k}") for k, v in w.items()])


@query("L5_cross_validation")
def _(t):
    r2 = L.cross_validate(t.samples(), FACTORS, "ret", 3)
    return t.spark.createDataFrame(list(enumerate(r2)), "fold int, r2 double")


@query("L5_boosted_trees_metrics")
def _(t):
    tr, te = split(t)
    m = L.train(tr, FACTORS, "ret", "gbt", trees=20)
    return L.model_fit(L.score(m, te, FACTORS), "prediction", "ret")


@query("L6_batch_scores")
def _(t):
    tr, te = split(t)
    return L.score(L.train(tr, FACTORS, "ret"), te, FACTORS).select("sample_id", "prediction")


W7 = {"quantity": 0.5, "price": 0.25, "discount": 0.15, "tax": 0.1}


@query("L7_contributions", "SELECT sample_id, " + ", ".join(f"{f} * {w}::DOUBLE AS contribution_{f}" for f, w in W7.items()) + " FROM samples", " ".join(f"contribution_{f}" for f in W7))
def _(t):
    return L.contributions(t.samples(), W7).select("sample_id", *[f"contribution_{f}" for f in W7])


@query(
    "L8_clip_and_encode",
    "SELECT sample_id, " + ", ".join(f"least({f}, (SELECT quantile_cont({f}, 0.995) FROM samples)) AS {f}" for f in ("price", "quantity")) + ", CASE phase WHEN 'early' THEN 0 WHEN 'mid' THEN 1 WHEN 'late' THEN 2 ELSE -1 END AS phase_code FROM samples",
    "price quantity",
)
def _(t):
    return L.preprocess(t.samples(), ["price", "quantity"]).select("sample_id", "price", "quantity", "phase_code")


# A fixed linear prediction stands for a trained model where the evaluation is compared with SQL.
fragment("predicted", "SELECT *, 0.4::DOUBLE * price / 1000 + 0.3::DOUBLE * quantity - 20 * discount AS prediction FROM samples")


def predicted(t):
    return t.samples().withColumn("prediction", F.lit(0.4) * F.col("price") / 1000 + F.lit(0.3) * F.col("quantity") - 20 * F.col("discount"))


@query(
    "L9_decile_table",
    """SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, avg(prediction) AS mean_pred, avg(max_ret) AS mean_actual, avg(CASE WHEN max_ret > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(ret) AS mean_return, median(max_ret) AS median_actual FROM (
      SELECT p.*, len(list_filter(e.q, lambda x: x < prediction)) AS decile FROM predicted p JOIN (SELECT quantile_cont(prediction, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM predicted) e ON TRUE) GROUP BY 1""",
    "mean_pred mean_actual win_rate mean_return median_actual",
)
def _(t):
    return L.decile_table(predicted(t), "prediction", "max_ret", "ret")


_FIT = "count(*) AS n, sqrt(avg((prediction - max_ret) * (prediction - max_ret))) AS rmse, corr(prediction, max_ret) AS correlation FROM predicted"


@query("L9_fit", f"SELECT {_FIT}", "rmse correlation")
def _(t):
    return L.model_fit(predicted(t), "prediction", "max_ret")


@query("L9_fit_by_date", f"SELECT date, {_FIT} GROUP BY 1 HAVING count(*) > 20", "rmse correlation")
def _(t):
    return L.model_fit(predicted(t), "prediction", "max_ret", ("date",), 20)


@query(
    "L10_top_share_signals",
    """SELECT top_pct, CAST(sum(n) AS BIGINT) AS n, sum(s) / sum(n) AS mean_max_return, sum(w) / sum(n) AS win_rate, sum(sr) / sum(n) AS mean_return, stddev_samp(s / n) AS date_std FROM (
      SELECT top_pct, date, count(*) AS n, sum(max_ret) AS s, sum(ret) AS sr, count(*) FILTER (max_ret > 0) AS w FROM predicted p JOIN (
        SELECT unnest([5, 10, 20, 30, 50]) AS top_pct, unnest(quantile_cont(prediction, [0.95, 0.9, 0.8, 0.7, 0.5])) AS th FROM predicted) t ON p.prediction >= th GROUP BY 1, 2) GROUP BY 1""",
    "mean_max_return win_rate mean_return date_std",
)
def _(t):
    return L.top_share_signals(predicted(t), "prediction", "max_ret", "ret")


@query("L11_partial_dependence")
def _(t):
    tr, te = split(t)
    return L.partial_dependence(L.train(tr, FACTORS, "ret"), te, "price", FACTORS, 20)


GATE_RULE = Rule("model_entry", (), hard_constraints=(Condition("discount", "lt", 0.09), Condition("tax", "between", (0.01, 0.07))), min_expected_return=15.0, min_confidence=0.55)


@query(
    "E9_model_gate",
    """SELECT sample_id, hard AND prediction >= 15 AND conf >= 0.55 AS should_enter, CASE WHEN hard THEN conf ELSE 0 END AS confidence,
      CASE WHEN NOT hard THEN 'hard_constraints' WHEN prediction < 15 THEN 'below_threshold' WHEN conf < 0.55 THEN 'low_confidence' ELSE 'enter' END AS gate_reason FROM (
      SELECT sample_id, prediction, discount < 0.09::DOUBLE AND tax BETWEEN 0.01::DOUBLE AND 0.07::DOUBLE AS hard,
        CASE WHEN prediction > 15 THEN least(1, 0.5 + (prediction - 15) / 15.05 * 0.5) ELSE greatest(0, 0.5 + (prediction - 15) / 15 * 0.5) END AS conf FROM predicted)""",
    "confidence",
)
def _(t):
    return E.model_gate(predicted(t), GATE_RULE).select("sample_id", "should_enter", "confidence", "gate_reason")
