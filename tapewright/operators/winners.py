"""Session outcomes of tickers, early features, trajectories and strategy coverage.

All per (date, ticker) within a session; windows are bounded by one ticker's session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions import session as S
from tapewright.functions.numeric import ratio
from tapewright.functions.timewin import UNB
from tapewright.operators.joins import asof_join
from tapewright.operators.ticks import order_key

KEYS = ["date", "ticker"]
MINUTE = 60_000

# Gain tiers, and the gain and volume tiers 1 (best) to 4.
GAIN_TIERS = ((100.0, "super"), (50.0, "big"), (20.0, "medium"), (10.0, "small"))
VOLUME_TIERS = ((1, 100.0, 500_000), (2, 60.0, 1_000_000), (3, 40.0, 1_000_000), (4, 20.0, 500_000))


def gain_tier(gain: str = "max_gain_pct") -> Column:
    out = F.lit("none")
    for bound, name in reversed(GAIN_TIERS):
        out = F.when(F.col(gain) >= bound, name).otherwise(out)
    return out


def volume_tier(gain: str = "max_gain_pct", volume: str = "total_volume", tiers: Sequence[tuple[int, float, float]] = VOLUME_TIERS) -> Column:
    """First tier whose gain band and volume minimum both hold, else 5."""
    out = F.lit(5)
    upper = {t[0]: (tiers[i - 1][1] if i else float("inf")) for i, t in enumerate(tiers)}
    for n, low, vol in reversed(tiers):
        out = F.when((F.col(gain) >= low) & (F.col(gain) < upper[n]) & (F.col(volume) >= vol), n).otherwise(out)
    return out


def premarket_trades(trades: DataFrame) -> DataFrame:
    et = S.to_et_ms("ts_ms")
    t = trades.withColumn("_et", et).filter(F.col("_et") % S.DAY_MS >= S.PREMARKET_START_MS).filter(F.col("_et") % S.DAY_MS < S.REGULAR_START_MS)
    return t.withColumn("date", S.et_date("_et")).drop("_et")


def session_outcomes(trades: DataFrame, min_trades: int = 10) -> DataFrame:
    """Open, high, low, close, gain, volume and timing per (date, ticker) with enough trades. One hash aggregation."""
    k = order_key()
    g = trades.withColumn("_k", k).groupBy(*KEYS).agg(
        F.min_by("price", "_k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_k").alias("close"),
        F.sum("size").alias("total_volume"), F.count(F.lit(1)).alias("total_trades"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.max(F.struct("price", (-F.col("ts_ms")).alias("nt")))["nt"].alias("_nt"),
    ).filter(F.col("total_trades") >= min_trades)
    g = g.withColumn("time_to_high_ms", -F.col("_nt") - F.col("first_ms")).withColumn("duration_min", (F.col("last_ms") - F.col("first_ms")) / 60000.0)
    g = g.withColumn("max_gain_pct", (F.col("high") - F.col("open")) / F.col("open") * 100)
    g = g.withColumn("trade_rate", ratio("total_trades", "duration_min", otherwise=0.0))
    g = g.withColumn("price_acceleration", F.when(F.col("time_to_high_ms") > 0, F.col("max_gain_pct") / (F.col("time_to_high_ms") / 60000.0)).otherwise(0.0))
    return g.drop("_nt").withColumn("tier", gain_tier())


def coverage(outcomes: DataFrame, signals: DataFrame, candidates: DataFrame, min_gap: float = 4.0, min_trades: int = 100, fast_ms: int = 300_000) -> DataFrame:
    """Captured flag per outcome and the reason a winner was missed."""
    s = signals.select(*KEYS).distinct().withColumn("captured", F.lit(True))
    c = candidates.select(*KEYS, F.col("gain_at_entry").alias("gap_pct"), F.lit(True).alias("_cand"))
    j = outcomes.join(s, KEYS, "left").join(c, KEYS, "left").withColumn("captured", F.coalesce("captured", F.lit(False)))
    winner = F.col("tier").isin("super", "big", "medium")
    reason = (
        F.when(F.col("_cand").isNull(), "not_in_candidates").when(F.col("gap_pct") < min_gap, "gap_filter").when(F.col("total_trades") < min_trades, "low_volume")
        .when(F.col("time_to_high_ms") < fast_ms, "too_fast").otherwise("timing")
    )
    return j.withColumn("miss_reason", F.when(winner & ~F.col("captured"), reason)).drop("_cand")


def coverage_summary(covered: DataFrame) -> DataFrame:
    winner = F.col("tier").isin("super", "big", "medium")
    return covered.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_tickers"), F.count(F.when(winner, 1)).alias("n_winners"), F.count(F.when(winner & F.col("captured"), 1)).alias("n_captured"),
        *[F.count(F.when(F.col("miss_reason") == r, 1)).alias(f"n_{r}") for r in ("not_in_candidates", "gap_filter", "low_volume", "too_fast", "timing")],
    ).withColumn("coverage", ratio("n_captured", "n_winners", otherwise=0.0))


def factors_after_entry(missed: DataFrame, factors: DataFrame, names: Sequence[str], offsets_ms: Sequence[int], entry: str = "entry_ms") -> DataFrame:
    """Factor values at the first factor row at or after entry + offset: one row per (missed row, offset)."""
    pts = missed.withColumn("offset_ms", F.explode(F.array(*[F.lit(o).cast("long") for o in offsets_ms]))).withColumn("_t", F.col(entry) + F.col("offset_ms"))
    f = factors.select("ticker", F.col("ts_ms").alias("factor_ms"), *names)
    return asof_join(pts, f, ["ticker"], "_t", "factor_ms", list(names), direction="forward").drop("_t")


def top_decile_ratios(outcomes: DataFrame, cols: Sequence[str], share: float = 0.1, min_n: int = 3) -> DataFrame:
    """Means of the date's top winners (10 %, at least 3) against the rest."""
    w = Window.partitionBy("date")
    r = F.row_number().over(w.orderBy(F.desc("max_gain_pct"), "ticker"))
    n = F.greatest(F.lit(min_n), F.floor(F.count(F.lit(1)).over(w) * share))
    d = outcomes.withColumn("_r", r).withColumn("_n", n).withColumn("_top", F.col("_r") <= F.col("_n"))
    g = d.groupBy("date").agg(*[F.avg(F.when(c, F.col(x))).alias(f"{p}_{x}") for x in cols for p, c in (("top", F.col("_top")), ("rest", ~F.col("_top")))])
    return g.select("date", *[f"{p}_{x}" for x in cols for p in ("top", "rest")], *[ratio(f"top_{x}", f"rest_{x}").alias(f"ratio_{x}") for x in cols])


def early_features(trades: DataFrame, outcomes: DataFrame, windows: Sequence[int] = (5, 10, 15, 30, 60), gains: Sequence[int] = (10, 25, 50), minute_ms: int = MINUTE) -> DataFrame:
    """Gain, volume and trades within the first minutes of a session, volatility of the first window, time to gain levels."""
    t = trades.join(outcomes.select(*KEYS, "open", "first_ms"), KEYS)
    t = t.withColumn("_el", F.col("ts_ms") - F.col("first_ms")).withColumn("_gain", (F.col("price") - F.col("open")) / F.col("open") * 100)
    aggs = []
    for m in windows:
        on = F.col("_el") <= m * minute_ms
        aggs += [F.max(F.when(on, F.col("_gain"))).alias(f"gain_{m}min"), F.sum(F.when(on, F.col("size"))).alias(f"volume_{m}min"), F.count(F.when(on, 1)).alias(f"trades_{m}min")]
    first = windows[0]
    aggs += [F.coalesce(F.min(F.when(F.col("_gain") >= g, F.col("_el"))) / 60000.0, F.lit(0.0)).alias(f"time_to_{g}pct") for g in gains]
    # Only the first minutes are put in order; the rest of a session is summed as it comes.
    w = Window.partitionBy(*KEYS).orderBy("ts_ms", "seq")
    begin = t.filter(F.col("_el") <= first * minute_ms).withColumn("_ret", (F.col("price") - F.lag("price").over(w)) / F.lag("price").over(w))
    moves = begin.groupBy(*KEYS).agg((F.coalesce(F.stddev_pop("_ret"), F.lit(0.0)) * 100).alias(f"volatility_{first}min"))
    f = t.groupBy(*KEYS).agg(*aggs).join(moves, KEYS, "left").withColumn(f"volatility_{first}min", F.coalesce(f"volatility_{first}min", F.lit(0.0)))
    for m in windows[:2]:
        f = f.withColumn(f"acceleration_{m}min", F.when(F.col(f"gain_{m}min") > 0, F.col(f"gain_{m}min") / m).otherwise(0.0)).withColumn(f"trade_rate_{m}min", F.col(f"trades_{m}min") / m)
    return f.withColumn(f"avg_size_{first}min", ratio(f"volume_{first}min", f"trades_{first}min", otherwise=0.0))


def relative_to_median(features: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column over its date's median (0 where the median is not positive). A date's cross-section is small."""
    med = features.groupBy("date").agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in cols])
    j = features.join(med, "date")
    return j.select(*features.columns, *[F.when(F.col(f"_m_{c}") > 0, F.col(c) / F.when(F.col(f"_m_{c}") > 0, F.col(f"_m_{c}"))).otherwise(0.0).alias(f"rel_{c}") for c in cols])


def tier_statistics(features: DataFrame, cols: Sequence[str]) -> DataFrame:
    return features.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def tier_ratios(features: DataFrame, cols: Sequence[str], top: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Mean of the top tiers over that of the rest per column, in long form."""
    a, b = F.col("tier").isin(*top), F.col("tier").isin(*rest)
    one = features.agg(*[F.avg(F.when(c, F.col(x))).alias(f"{p}_{x}") for x in cols for p, c in (("a", a), ("b", b))])
    rows = [F.struct(F.lit(x).alias("feature"), F.col(f"a_{x}").alias("top_mean"), F.col(f"b_{x}").alias("rest_mean"), ratio(f"a_{x}", f"b_{x}").alias("ratio")) for x in cols]
    return one.select(F.inline(F.array(*rows)))


def trajectories(trades: DataFrame, outcomes: DataFrame, step_min: int = 5, points: int = 70, minute_ms: int = MINUTE) -> DataFrame:
    """Best gain so far, last price and cumulative volume at every step after the first trade.

    Trades are reduced to steps first; the grid then carries the reduced rows.
    """
    o = outcomes.select(*KEYS, "open", "first_ms", "tier")
    step = step_min * minute_ms
    t = trades.join(o, KEYS).withColumn("_i", F.ceil((F.col("ts_ms") - F.col("first_ms")) / step).cast("int")).withColumn("_k", order_key())
    g = t.groupBy(*KEYS, "_i").agg(F.max("price").alias("_hi"), F.sum("size").alias("_v"), F.max_by("price", "_k").alias("_px"))
    grid = o.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).join(g, [*KEYS, "_i"], "left")
    w = Window.partitionBy(*KEYS).orderBy("_i").rowsBetween(UNB, 0)
    out = grid.select(
        *KEYS, "tier", (F.col("_i") * step_min).alias("minute"), F.last("_px", ignorenulls=True).over(w).alias("price"),
        F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("cumulative_volume"), ((F.max("_hi").over(w) - F.col("open")) / F.col("open") * 100).alias("gain_pct"),
    )
    return out


def volume_peaks(traj: DataFrame) -> DataFrame:
    """Minute of the strongest volume growth between neighbouring points, the earliest among equals."""
    w = Window.partitionBy(*KEYS).orderBy("minute")
    d = traj.withColumn("_d", F.col("cumulative_volume") - F.lag("cumulative_volume").over(w)).filter(F.col("_d") > 0)
    return d.groupBy(*KEYS).agg(F.max(F.struct("_d", (-F.col("minute")).alias("nm")))["nm"].alias("_nm")).select(*KEYS, (-F.col("_nm")).alias("volume_peak_minute"))


def tier_trajectories(traj: DataFrame) -> DataFrame:
    return traj.groupBy("tier", "minute").agg(F.count(F.lit(1)).alias("n"), F.avg("gain_pct").alias("mean_gain"), F.avg("cumulative_volume").alias("mean_volume"))


def classify_early(features: DataFrame, min_volume: float = 100_000, min_rel: float = 10, min_rate: float = 20, min_gain: float = 5, big_gain: float = 50.0, first: int = 5) -> DataFrame:
    """Early signal against outcome: explosive, slow burner, false positive or other."""
    early = ((F.col(f"volume_{first}min") > min_volume) | (F.col(f"rel_volume_{first}min") > min_rel)) & (F.col(f"trade_rate_{first}min") > min_rate) & (F.col(f"gain_{first}min") > min_gain)
    big = F.col("max_gain_pct") >= big_gain
    label = F.when(early & big, "early_explosive").when(~early & big, "slow_burner").when(early & ~big, "false_positive").otherwise("other")
    return features.withColumn("is_early_signal", early).withColumn("signal_type", label)
