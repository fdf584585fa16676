"""Training samples, splits, models and their evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from tapewright.functions.numeric import ratio
from tapewright.functions.ranks import attach_scalars, exact_quantiles
from tapewright.operators.stats import long_factors

# Phase codes and the default regression parameters.
PHASES = {"early": 0, "mid": 1, "late": 2}
RIDGE_ALPHA = 10.0
TREES = 100
CLIP = 0.995


def samples_from_signals(signals: DataFrame, horizon: str, factors: Sequence[str], json_col: str = "factors", limit: int | None = None) -> DataFrame:
    """Signals with a known return at the horizon, factors read from their JSON map, newest first when limited."""
    s = signals.filter(F.col(horizon).isNotNull()).withColumn("_m", F.from_json(json_col, "map<string,double>"))
    out = s.select("signal_id", "ticker", "ts_ms", F.col(horizon).alias("return_pct"), *[F.col("_m")[f].alias(f) for f in factors])
    return out.orderBy(F.desc("ts_ms"), "signal_id").limit(limit) if limit else out


def split_by_dates(df: DataFrame, test_dates: Sequence[str]) -> DataFrame:
    return df.withColumn("part", F.when(F.col("date").isin(*[F.lit(d).cast("date") for d in test_dates]), "test").otherwise("train"))


def split_by_ratio(df: DataFrame, key: str, test_ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """Seeded split by md5 of key and seed: the same row always falls on the same side, whatever the partitioning or engine."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("part", F.when(u < test_ratio, "test").otherwise("train"))


def date_folds(df: DataFrame, n: int = 5) -> DataFrame:
    """Contiguous date folds of equal date counts, the remainder in the last. The distinct dates are a calendar."""
    dates = df.select("date").distinct()
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1
    k = F.greatest(F.floor(F.col("_n") / n), F.lit(1)).cast("int")
    folds = attach_scalars(dates.withColumn("_i", i), dates.agg(F.count(F.lit(1)).alias("_n"))).select("date", F.least(F.floor(F.col("_i") / k).cast("int"), F.lit(n - 1)).alias("fold"))
    return df.join(F.broadcast(folds), "date")


def preprocess(df: DataFrame, factors: Sequence[str], q: float = CLIP) -> DataFrame:
    """Clip factors at their upper quantile and encode the session phase (-1 when unknown)."""
    # All factors in one pass over long rows.
    upper = exact_quantiles(long_factors(df, factors, []), "x", {"_u": q}, ["factor"])
    out = attach_scalars(df, upper.agg(*[F.max(F.when(F.col("factor") == f, F.col("_u"))).alias(f"_u_{f}") for f in factors]))
    code = F.lit(-1)
    for name, c in PHASES.items():
        code = F.when(F.col("phase") == name, c).otherwise(code)
    keep = [c for c in df.columns if c not in factors]
    return out.select(*keep, *[F.least(F.col(f), F.col(f"_u_{f}")).alias(f) for f in factors], code.alias("phase_code"))


def train(df: DataFrame, features: Sequence[str], target: str, kind: str = "ridge", alpha: float = RIDGE_ALPHA, trees: int = TREES):
    """Fit a ridge or boosted-tree regression with distributed training; rows with nulls are left out."""
    d = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df.filter(F.col(target).isNotNull()))
    if kind == "ridge":
        # The penalty is alpha on the summed squared error; the estimator takes it per row.
        n = d.count()
        return LinearRegression(featuresCol="features", labelCol=target, regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False).fit(d)
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=trees, maxDepth=3, stepSize=0.1, seed=42).fit(d)


def score(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)).drop("features")


def importance(model, features: Sequence[str]) -> dict[str, float]:
    """Normalised feature weights: split gains, or absolute coefficients."""
    raw = model.featureImportances.toArray() if hasattr(model, "featureImportances") else [abs(c) for c in model.coefficients]
    total = sum(raw) or 1.0
    return {f: float(v) / total for f, v in zip(features, raw)}


def cross_validate(df: DataFrame, features: Sequence[str], target: str, n: int = 5, kind: str = "ridge") -> list[float]:
    """R2 per date fold; n is the number of models, a small constant."""
    folds, ev = date_folds(df.select("date", *features, target), n), RegressionEvaluator(labelCol=target, metricName="r2")
    out = []
    for i in range(n):
        m = train(folds.filter(F.col("fold") != i), features, target, kind)
        out.append(ev.evaluate(score(m, folds.filter(F.col("fold") == i), features)))
    return out


def contributions(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Normalised importance times value per feature."""
    total = sum(weights.values()) or 1.0
    return df.select("*", *[(F.coalesce(F.col(f), F.lit(0.0)) * (w / total)).alias(f"contribution_{f}") for f, w in weights.items()])


def decile_table(df: DataFrame, pred: str, actual: str, ret: str, n: int = 10) -> DataFrame:
    """Realised returns per prediction decile, right-closed at the exact quantiles."""
    edges = exact_quantiles(df, pred, {f"q{i}": i / n for i in range(1, n)}).select(F.array_distinct(F.array(*[f"q{i}" for i in range(1, n)])).alias("_e"))
    d = attach_scalars(df, edges).withColumn("decile", F.size(F.filter("_e", lambda e: e < F.col(pred)))).drop("_e")
    g = d.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(pred).alias("mean_pred"), F.avg(actual).alias("mean_actual"), F.avg(F.when(F.col(actual) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(ret).alias("mean_return")
    )
    return g.join(exact_quantiles(d, actual, {"median_actual": 0.5}, ["decile"]), "decile")


def model_fit(df: DataFrame, pred: str, actual: str, keys: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """RMSE and correlation overall or per key."""
    e = F.col(pred) - F.col(actual)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(pred, actual).alias("correlation"))
    return g.filter(F.col("n") > min_rows)


def top_share_signals(df: DataFrame, pred: str, actual: str, ret: str, shares: Sequence[int] = (5, 10, 20, 30, 50)) -> DataFrame:
    """Results of buying the top p percent of predictions, with the deviation of the date means."""
    th = exact_quantiles(df, pred, {f"_t{s}": 1 - s / 100 for s in shares})
    d = attach_scalars(df, th)
    tags = F.filter(F.array(*[F.when(F.col(pred) >= F.col(f"_t{s}"), F.lit(s)) for s in shares]), lambda x: x.isNotNull())
    d = d.select("date", F.col(actual).alias("_a"), F.col(ret).alias("_r"), F.explode(tags).alias("top_pct"))
    by_date = d.groupBy("top_pct", "date").agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_s"), F.sum("_r").alias("_sr"), F.count(F.when(F.col("_a") > 0, 1)).alias("_w"))
    g = by_date.groupBy("top_pct").agg(F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum("_sr").alias("_sr"), F.sum("_w").alias("_w"), F.stddev_samp(F.col("_s") / F.col("_n")).alias("date_std"))
    return g.select("top_pct", "n", ratio("_s", "n").alias("mean_max_return"), ratio("_w", "n").alias("win_rate"), ratio("_sr", "n").alias("mean_return"), "date_std")


def partial_dependence(model, df: DataFrame, feature: str, features: Sequence[str], points: int = 50) -> DataFrame:
    """Mean prediction with one feature set to each grid point between its 1 % and 99 % quantiles.

    The rows are repeated once per grid point (a constant) by an explode and scored in parallel.
    """
    span = exact_quantiles(df, feature, {"_lo": 0.01, "_hi": 0.99})
    d = attach_scalars(df.select(*features), span).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    d = d.withColumn(feature, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / (points - 1)).drop("_lo", "_hi")
    return score(model, d, features).groupBy(F.col("_i").alias("point"), F.col(feature).alias("value")).agg(F.avg("prediction").alias("predicted_return"))
