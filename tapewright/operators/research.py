"""Reports over backtest signals, extreme winners and sample sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions import session as S
from tapewright.functions.extremes import window_extremes
from tapewright.functions.numeric import ratio
from tapewright.functions.ranks import attach_scalars, average_ranks, exact_quantiles, running_counts
from tapewright.operators.stats import long_factors
from tapewright.operators.ticks import OFF_EXCHANGE, on_time


def experiment_stats(signals: DataFrame, keys: Sequence[str], first_date: bool = False) -> DataFrame:
    r = F.col("return_pct")
    head = [F.min("date").alias("date")] if first_date else []
    return signals.groupBy(*keys).agg(*head, F.count(F.lit(1)).alias("n"), F.avg(r).alias("avg_return"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def diagnostics(signals: DataFrame) -> DataFrame:
    """Price-path summary and exit-reason counts per experiment."""
    ep = F.col("entry_price")
    mfe, mae = (F.col("max_price") - ep) / ep * 100, F.abs((F.col("min_price") - ep) / ep * 100)
    r = F.col("return_pct")
    g = signals.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("total_signals"), F.avg(r).alias("avg_return"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        (F.avg("time_to_max_ms") / 1000).alias("avg_time_to_max_sec"), (F.avg("time_to_min_ms") / 1000).alias("avg_time_to_min_sec"),
        F.avg(mfe).alias("avg_mfe_pct"), F.avg(mae).alias("avg_mae_pct"),
        F.count(F.when(F.col("stop_loss_share") > 0, 1)).alias("n_stop"), F.count(F.when(F.col("take_profit_share") > 0, 1)).alias("n_take_profit"), F.count(F.when(F.col("close_share") > 0, 1)).alias("n_close"),
    )
    return g.withColumn("mfe_mae_ratio", ratio("avg_mfe_pct", "avg_mae_pct", otherwise=0.0))


def factor_correlations(signals: DataFrame, json_col: str = "factors") -> DataFrame:
    """Pearson correlation of each factor in the JSON factor map with the return."""
    m = signals.withColumn("_m", F.from_json(json_col, "map<string,double>"))
    long = m.select("experiment_id", "return_pct", F.explode("_m").alias("factor", "x")).filter(F.col("x").isNotNull())
    return long.groupBy("experiment_id", "factor").agg(F.count("x").alias("n"), F.corr("x", "return_pct").alias("correlation"))


def loss_patterns(signals: DataFrame, above: Mapping[str, tuple[str, float]], early_ms: int, json_col: str = "factors") -> DataFrame:
    """Losing signals per pattern: a factor above its bound, or an early maximum. Patterns may overlap."""
    m = signals.filter(F.col("return_pct") < 0).withColumn("_m", F.from_json(json_col, "map<string,double>"))
    tags = [F.when(F.col("_m")[f] > bound, F.lit(n)) for n, (f, bound) in above.items()] + [F.when(F.col("time_to_max_ms") < early_ms, F.lit("early_max"))]
    long = m.withColumn("pattern", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())))
    return long.groupBy("experiment_id", "pattern").agg(F.count(F.lit(1)).alias("n"), F.avg("return_pct").alias("avg_return"))


def winner_loser_factors(df: DataFrame, factors: Sequence[str], value: str) -> DataFrame:
    """Mean and median of each factor for winners (value > 0) and losers, and the relative difference."""
    d = long_factors(df.withColumn("_win", F.col(value) > 0), factors, ["_win"])
    means = d.groupBy("factor").agg(F.avg(F.when(F.col("_win"), F.col("x"))).alias("winner_mean"), F.avg(F.when(~F.col("_win"), F.col("x"))).alias("loser_mean"))
    med = exact_quantiles(d, "x", {"m": 0.5}, ["factor", "_win"])
    med = med.groupBy("factor").agg(F.max(F.when(F.col("_win"), F.col("m"))).alias("winner_median"), F.max(F.when(~F.col("_win"), F.col("m"))).alias("loser_median"))
    return means.join(med, "factor").withColumn("diff_pct", ratio(F.col("winner_mean") - F.col("loser_mean"), F.abs("loser_mean")) * 100)


def mfe_histogram(exc: DataFrame) -> DataFrame:
    m = F.col("mfe_pct")
    bucket = F.when(m < 0, "<0").when(m < 3, "0-3").when(m < 5, "3-5").when(m < 10, "5-10").otherwise("10+")
    return exc.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("close_pct") <= 0) & (m >= 3), 1)).alias("losers_with_mfe"), F.avg("close_pct").alias("mean_close")
    )


def compare_signal_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement of two signal sets per key."""
    x = a.select(*keys, F.col("event_name").alias("_ea"), F.col("entry_ms").alias("_ta"))
    y = b.select(*keys, F.col("event_name").alias("_eb"), F.col("entry_ms").alias("_tb"))
    same = (F.col("_ea") == F.col("_eb")) & (F.col("_ta") == F.col("_tb"))
    label = F.when(F.col("_ea").isNull(), "rule_order_only").when(F.col("_eb").isNull(), "earliest_only").when(same, "same").otherwise("different")
    return x.join(y, keys, "full").select(*keys, label.alias("agreement"))


def extreme_winners(df: DataFrame, n: int = 2, value: str = "max_ret") -> DataFrame:
    """The n greatest rows of every date; the limit is applied before the shuffle as well."""
    w = Window.partitionBy("date").orderBy(F.desc(value), "sample_id")
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def winner_percentiles(df: DataFrame, factors: Sequence[str], n: int = 2, min_rows: int = 10) -> DataFrame:
    """Share of the date's rows strictly below each extreme winner, per factor."""
    # A date's few winners go to each of its rows, and the counts are combined before the shuffle.
    w = long_factors(extreme_winners(df, n), factors, ["date", "sample_id", "pos"]).withColumnRenamed("x", "_x")
    w = w.groupBy("date", "factor").agg(F.collect_list(F.struct("sample_id", "pos", "_x")).alias("_w"))
    rows = long_factors(df, factors, ["date"]).join(F.broadcast(w), ["date", "factor"]).select("date", "factor", "x", F.inline("_w"))
    g = rows.groupBy("date", "sample_id", "factor", "pos").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("x") < F.col("_x"), 1)).alias("_b"))
    return g.filter(F.col("_n") >= min_rows).select("date", "sample_id", "factor", (F.col("_b") / F.col("_n") * 100).alias("percentile"))


def filter_overlap(df: DataFrame, filters: Mapping[str, Column], n: int = 2) -> DataFrame:
    """Which filters each extreme winner passes, with the filter's number of signals that day."""
    days = df.groupBy("date").agg(*[F.count(F.when(c, 1)).alias(f"{k}_day") for k, c in filters.items()])
    w = extreme_winners(df, n).select("date", "sample_id", *[c.alias(f"{k}_pass") for k, c in filters.items()])
    return w.join(days, "date")


def extreme_vs_rest(df: DataFrame, cols: Sequence[str], bound: float, value: str = "max_ret") -> DataFrame:
    hi, lo = F.col(value) > bound, (F.col(value) > 0) & (F.col(value) <= bound)
    return df.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(hi, 1)).alias("n_extreme"), F.count(F.when(lo, 1)).alias("n_rest"),
        *[F.avg(F.when(c, F.col(f))).alias(f"{p}_{f}") for f in cols for p, c in (("extreme", hi), ("rest", lo))],
    )


def composite_rank(df: DataFrame, weights: Mapping[str, float], n: int = 2) -> DataFrame:
    """Percent rank of each factor (descending, ties averaged), their weighted sum and its rank, for the extreme winners."""
    # Ranks come from running counts over value ranges, so a date is spread over many tasks. Equal rows are ranked once.
    whole = df
    for c in ("date", *weights):
        whole = whole.filter(F.col(c).isNotNull())
    ranks = {f: average_ranks(df, f, ["date"]).select("date", f, ((F.col("n") + 1 - F.col("rank")) / F.col("n")).alias(f"{f}_pct")) for f in weights}

    def scored(rows: DataFrame) -> DataFrame:
        for f in weights:
            rows = rows.join(ranks[f], ["date", f])
        score = sum((F.col(f"{f}_pct") * w for f, w in weights.items()), F.lit(0.0))
        return rows.withColumn("composite", score).withColumn("_c", F.round("composite", 9))

    places = running_counts(scored(whole.groupBy("date", *weights).agg(F.count(F.lit(1)).alias("_w"))), "_c", {"n": "_w"}, ["date"])
    places = places.select("date", "_c", F.col("total_n").alias("n_total"), (F.col("total_n") - F.col("before_n") - F.col("cnt_n") + 1).cast("int").alias("overall_rank"))
    winners = extreme_winners(whole.select("date", "sample_id", "max_ret", *weights), n)
    return scored(winners).join(places, ["date", "_c"]).select("date", "sample_id", "n_total", *[f"{f}_pct" for f in weights], "composite", "overall_rank")


def mask_by_date(df: DataFrame, on: Column, value: str = "ret", best: str = "max_ret") -> DataFrame:
    d = df.filter(on)
    return d.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_return"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.max_by("sample_id", F.struct(best, "sample_id")).alias("best"), F.max(best).alias("best_return"),
    )


def recall_cuts(df: DataFrame, factors: Sequence[str], positive: Column) -> DataFrame:
    """Negatives that survive every cut keeping all positives: at the positives' minimum where their median is higher, else at their maximum."""
    d = df.withColumn("_pos", positive)
    long = long_factors(d, factors, ["_pos"])
    med = exact_quantiles(long, "x", {"m": 0.5}, ["factor", "_pos"])
    span = long.filter("_pos").groupBy("factor").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    cuts = med.groupBy("factor").agg((F.max(F.when(F.col("_pos"), F.col("m"))) > F.max(F.when(~F.col("_pos"), F.col("m")))).alias("_up")).join(span, "factor")
    wide = cuts.agg(*[F.max(F.when(F.col("factor") == f, F.col(c))).alias(f"{c}_{f}") for f in factors for c in ("_up", "_lo", "_hi")])
    out = attach_scalars(d.filter(~F.col("_pos")), wide)
    for f in factors:
        out = out.filter(F.when(F.col(f"_up_{f}"), F.col(f) >= F.col(f"_lo_{f}")).otherwise(F.col(f) <= F.col(f"_hi_{f}")))
    return out.select(*df.columns)


def hard_cases(survivors: DataFrame, positives: DataFrame, profiles: DataFrame, key: str = "symbol") -> DataFrame:
    both = survivors.withColumn("review_flag", F.lit("HARD_FALSE")).unionByName(positives.withColumn("review_flag", F.lit("TRUE_MOMO")))
    return both.join(profiles, key, "left")


def dense_signals(trades: DataFrame, block_ms: int = 120_000, first_ms: int = 60_000, hold_ms: int = 1_800_000) -> DataFrame:
    """Mid-phase rows in the first part of every block, with the last and highest price of the following hold."""
    et = S.to_et_ms("ts_ms")
    m = S.ms_of_day(et)
    s = trades.filter((F.pmod(F.col("ts_ms"), F.lit(block_ms)) <= first_ms) & (m >= 7 * S.HOUR_MS) & (m < 9 * S.HOUR_MS))
    s = s.select("seq", "ticker", "ts_ms", F.col("price").alias("entry_price"))
    after = window_extremes(s, trades, "seq", "ts_ms", hold_ms)
    return s.join(after, "seq", "left").select(
        "seq", "ticker", "ts_ms", "entry_price", F.coalesce("last", "entry_price").alias("last_price"), F.greatest("entry_price", "hi").alias("max_price")
    )


def sample_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("n_symbols"), F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("ret").alias("mean_ret"), *[F.count(F.when(F.col("tier") == x, 1)).alias(f"n_{x}") for x in ("big", "medium", "small", "flat", "loser")],
    )


def delayed_share(trades: DataFrame) -> DataFrame:
    """Off-exchange and delayed reports per ticker."""
    return trades.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count(F.when(F.col("exchange") == OFF_EXCHANGE, 1)).alias("n_off_exchange"), F.count(F.when(~on_time(), 1)).alias("n_delayed"),
        (F.count(F.when(~on_time(), 1)) / F.count(F.lit(1))).alias("delayed_share"),
    )


# Strata bounds.
MIN_FLOAT = 500_000
MAX_DELAYED_SHARE = 0.10


def ticker_strata(profiles: DataFrame, delayed: DataFrame, min_float: float = MIN_FLOAT, max_delayed: float = MAX_DELAYED_SHARE) -> DataFrame:
    j = profiles.join(delayed.select("ticker", "delayed_share"), "ticker")
    big = F.col("float_shares") > min_float
    return j.select("ticker", F.when(big & (F.col("delayed_share") < max_delayed), "clean").when(big, "delayed").otherwise("low_float").alias("stratum"), "delayed_share")


def mining_gates(matrix: DataFrame, min_signals: int, min_precision: float, min_recall: float, min_return: float) -> DataFrame:
    return matrix.filter((F.col("n_signals") >= min_signals) & (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall) & (F.col("avg_return") > min_return))


def symbol_performance(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"), F.avg("max_ret").alias("mean_max_ret"), F.stddev_samp("ret").alias("std_ret"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.max("max_ret").alias("best"),
    )
