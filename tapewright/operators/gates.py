"""Layered gates over candidate tables, their funnel and subset reports, and tradability scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.ranks import attach_scalars, exact_quantiles
from tapewright.operators.exits import strategy_report


@dataclass(frozen=True)
class Gate:
    """A named gate: ordered (fails, reason) checks; a null check does not fail."""

    name: str
    checks: tuple[tuple[Column, str], ...]

    def reason(self) -> Column:
        out = F.lit(None).cast("string")
        for fails, text in reversed(self.checks):
            out = F.when(fails, text).otherwise(out)
        return out


# The texts of the reject reasons, in the gates below.
def data_quality_gate(min_trade_rate: float = 0.0, max_spread_bps: float = float("inf"), min_fwd_trades: int = 0) -> Gate:
    checks = [(F.col("trade_rate").isNull(), "trade_rate not computable")]
    if min_trade_rate > 0:
        checks.append((F.col("trade_rate") < min_trade_rate, f"trade_rate < {min_trade_rate}"))
    if max_spread_bps < float("inf"):
        checks.append((F.col("bid_ask_spread") > max_spread_bps, f"spread > {max_spread_bps}bps"))
    if min_fwd_trades > 0:
        checks.append((F.col("n_fwd_trades") < min_fwd_trades, f"fwd_trades < {min_fwd_trades}"))
    return Gate("data_quality", tuple(checks))


def static_gate(
    allowed_countries: Sequence[str] = (), blocked_countries: Sequence[str] = ("CN", "HK"), min_price: float = 0.0,
    max_price: float = float("inf"), min_market_cap: float = 0.0,
) -> Gate:
    checks = []
    if allowed_countries:
        checks.append((~F.coalesce(F.col("country").isin(*allowed_countries), F.lit(False)), "country not allowed"))
    if blocked_countries:
        checks.append((F.col("country").isin(*blocked_countries), "country is blocked"))
    if min_price > 0:
        checks.append((F.col("entry_price") < min_price, f"price < {min_price}"))
    if max_price < float("inf"):
        checks.append((F.col("entry_price") > max_price, f"price > {max_price}"))
    if min_market_cap > 0:
        checks += [(F.col("market_cap").isNull(), "marketCap unknown"), (F.col("market_cap") < min_market_cap, f"marketCap < {min_market_cap}")]
    return Gate("static", tuple(checks))


def event_pattern_gate(price_direction: tuple[float, float] | None = None, gap_pct: tuple[float, float] | None = None, min_trade_rate: float = 0.0) -> Gate:
    checks = []
    if min_trade_rate > 0:
        checks.append((F.col("trade_rate").isNull() | (F.col("trade_rate") < min_trade_rate), f"trade_rate < {min_trade_rate}"))
    for name, bounds in (("price_direction", price_direction), ("gap_percent", gap_pct)):
        if bounds:
            checks += [(F.col(name).isNull(), f"{name} not available"), (~F.col(name).between(*bounds), f"{name} not in [{bounds[0]}, {bounds[1]}]")]
    return Gate("event_pattern", tuple(checks))


def liquidity_gate(min_trades_5min: int = 0, min_dollar_vol_5min: float = 0.0, max_gap_sec: float = float("inf"), sustained: bool = False) -> Gate:
    checks = []
    if min_trades_5min > 0:
        checks.append((F.col("n_trades_first_5min") < min_trades_5min, f"trades_5min < {min_trades_5min}"))
    if min_dollar_vol_5min > 0:
        checks.append((F.col("dollar_vol_5min") < min_dollar_vol_5min, f"dollar_vol < {min_dollar_vol_5min}"))
    if max_gap_sec < float("inf"):
        checks.append((F.col("max_gap_sec") > max_gap_sec, f"max_gap > {max_gap_sec}"))
    if sustained:
        checks.append((~F.col("sustained_activity"), "no sustained activity at entry"))
    return Gate("liquidity", tuple(checks))


def trade_intensity_gate(min_trades_5min: int = 0, max_gap_sec: float = float("inf"), sustained: bool = False) -> Gate:
    checks = []
    if sustained:
        checks.append((~F.col("sustained_activity"), "no sustained activity at entry"))
    checks += [c for c in liquidity_gate(min_trades_5min, 0.0, max_gap_sec).checks]
    return Gate("trade_intensity", tuple(checks))


def momentum_gate(min_big_trade_delta: float | None = None, min_price_range_pct: float = 0.0, min_uptick_frac: float = 0.0, min_accel_slope: float | None = None) -> Gate:
    checks = []
    if min_big_trade_delta is not None:
        checks.append((F.col("big_trade_delta") < min_big_trade_delta, f"big_trade_delta < {min_big_trade_delta}"))
    if min_price_range_pct > 0:
        checks.append((F.col("price_range_5min_pct") < min_price_range_pct, f"price_range < {min_price_range_pct}"))
    if min_uptick_frac > 0:
        checks.append((F.col("uptick_frac") < min_uptick_frac, f"uptick_frac < {min_uptick_frac}"))
    if min_accel_slope is not None:
        checks.append((F.col("accel_slope") < min_accel_slope, f"accel < {min_accel_slope}"))
    return Gate("momentum", tuple(checks))


def apply_gates(candidates: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """reject_layer and reject_reason of the first failing gate, null for survivors, plus one bit per failing gate."""
    layer = F.coalesce(*[F.when(g.reason().isNotNull(), F.lit(g.name)) for g in gates])
    reason = F.coalesce(*[g.reason() for g in gates])
    mask = F.lit(0)
    for i, g in enumerate(gates):
        mask = mask + F.when(g.reason().isNotNull(), 1 << i).otherwise(0)
    return candidates.select("*", layer.alias("reject_layer"), reason.alias("reject_reason"), mask.alias("fail_mask"))


def gate_funnel(gated: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Per gate: candidates in, passed, rejected. One pass; the gate order gives what reaches each gate."""
    first = F.coalesce(*[F.when(F.col("reject_layer") == g.name, F.lit(i)) for i, g in enumerate(gates)], F.lit(len(gates)))
    one = gated.withColumn("_f", first).agg(
        *[F.count(F.when(F.col("_f") >= i, 1)).alias(f"_in{i}") for i in range(len(gates))],
        *[F.count(F.when(F.col("_f") > i, 1)).alias(f"_out{i}") for i in range(len(gates))],
    )
    rows = [
        F.struct(F.lit(g.name).alias("gate"), F.lit(i).alias("gate_order"), F.col(f"_in{i}").alias("n_input"), F.col(f"_out{i}").alias("n_passed"), (F.col(f"_in{i}") - F.col(f"_out{i}")).alias("n_rejected"))
        for i, g in enumerate(gates)
    ]
    return one.select(F.inline(F.array(*rows)))


def reject_reasons(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("reject_layer").isNotNull()).groupBy("reject_layer", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def gate_report(gated: DataFrame, results: DataFrame, momo_pct: float = 50.0) -> DataFrame:
    """Survivors against all candidates: trades, expectancy, win rate, median peak, retention of big movers."""
    r = gated.join(results.select("entry_id", "pnl_pct"), "entry_id", "left")
    live, peak, pnl = F.col("reject_layer").isNull(), F.col("entry_to_peak_pct"), F.col("pnl_pct")
    momo = peak >= momo_pct
    win = F.when(pnl > 0, 1.0).when(pnl.isNotNull(), 0.0)
    g = r.agg(
        F.count(F.lit(1)).alias("n_input"), F.count(F.when(live, 1)).alias("n_survivors"),
        F.count(pnl).alias("n_traded_baseline"), F.count(F.when(live, pnl)).alias("n_traded_survivor"),
        F.avg(pnl).alias("baseline_expectancy"), F.avg(F.when(live, pnl)).alias("survivor_expectancy"),
        F.avg(win).alias("baseline_win_rate"), F.avg(F.when(live, win)).alias("survivor_win_rate"),
        F.count(F.when(momo, 1)).alias("baseline_momo"), F.count(F.when(momo & live, 1)).alias("survivor_momo"),
    )
    for name, rows in (("baseline", gated), ("survivor", gated.filter(live))):
        g = attach_scalars(g, exact_quantiles(rows, "entry_to_peak_pct", {f"{name}_median_peak": 0.5}))
    return g.withColumn("expectancy_delta", F.col("survivor_expectancy") - F.col("baseline_expectancy")).withColumn(
        "momo_retention", F.col("survivor_momo") / F.greatest("baseline_momo", F.lit(1))
    )


def gate_subsets(gated: DataFrame, results: DataFrame, gates: Sequence[Gate], momo_pct: float = 50.0) -> DataFrame:
    """Survivors of every subset of gates, numbered by its bits.

    Candidates are first reduced to one row per combination of failed gates (at most 2^n rows); only
    those rows meet the 2^n subsets.
    """
    r = gated.join(results.select("entry_id", "pnl_pct"), "entry_id", "left")
    pnl = F.col("pnl_pct")
    cells = r.groupBy("fail_mask").agg(
        F.count(F.lit(1)).alias("_n"), F.count(pnl).alias("_t"), F.sum(pnl).alias("_s"), F.count(F.when(pnl > 0, 1)).alias("_w"),
        F.count(F.when(F.col("entry_to_peak_pct") >= momo_pct, 1)).alias("_m"),
    )
    subsets = F.filter(F.sequence(F.lit(0), F.lit(2 ** len(gates) - 1)), lambda s: s.bitwiseAND(F.col("fail_mask")) == 0)
    g = cells.withColumn("subset", F.explode(subsets)).groupBy("subset").agg(
        F.sum("_n").alias("n_survivors"), F.sum("_t").alias("n_traded"), F.sum("_m").alias("survivor_momo"),
        (F.sum("_s") / F.when(F.sum("_t") > 0, F.sum("_t"))).alias("expectancy_pct"),
        (F.sum("_w") / F.when(F.sum("_t") > 0, F.sum("_t"))).alias("win_rate"),
    )
    names = F.array(*[F.when(F.col("subset").bitwiseAND(F.lit(1 << i)) != 0, F.lit(g_.name)) for i, g_ in enumerate(gates)])
    return g.withColumn("gates", F.concat_ws("+", F.filter(names, lambda x: x.isNotNull())))


# --- tradability scores -----------------------------------------------------------------------------

# Centres and scales of the scores.
FULL_RATE = 15.0
WORST_SPREAD_BPS = 200.0
PRICE_CENTRE, PRICE_SCALE = 8.0, 7.0
FLOAT_CENTRE_M, FLOAT_SCALE_M = 20.0, 8.0
BLOCKED = ("CN", "HK")
WEIGHTS = {"trade_rate": 0.20, "spread": 0.20, "price": 0.20, "float": 0.20, "country": 0.20}


def _price_score() -> Column:
    z = (F.col("entry_price") - PRICE_CENTRE) / PRICE_SCALE
    return F.when(F.col("entry_price") > 0, F.exp(-0.5 * z * z))


def _float_score() -> Column:
    fs = F.col("float_shares")
    return F.when(fs > 0, 1 / (1 + F.exp((fs / 1_000_000 - FLOAT_CENTRE_M) / FLOAT_SCALE_M)))


def _country_score(blocked: Sequence[str]) -> Column:
    return F.when(F.col("country").isNull() | F.col("country").isin(*blocked), 0.0).otherwise(1.0)


def tradability_score(c: DataFrame, weights: dict[str, float] = WEIGHTS, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """Five scores in 0..1 and their weighted mean; missing inputs score 0."""
    zero = F.lit(0.0)
    s = c.withColumns(
        {
            "score_trade_rate": F.coalesce(F.least(F.col("trade_rate") / FULL_RATE, F.lit(1.0)), zero),
            "score_spread": F.coalesce(F.greatest(zero, 1 - F.col("bid_ask_spread") / WORST_SPREAD_BPS), zero),
            "score_price": F.coalesce(_price_score(), zero),
            "score_float": F.coalesce(_float_score(), zero),
            "score_country": _country_score(blocked),
        }
    )
    total = sum((F.col(f"score_{k}") * w for k, w in weights.items()), F.lit(0.0))
    return s.withColumn("score_composite", total / (sum(weights.values()) or 1.0))


def tradability_score_v2(c: DataFrame, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """Price and float scores inverted; the composite is their mean with the country score."""
    zero = F.lit(0.0)
    s = c.withColumns(
        {"score_price_v2": F.coalesce(1 - _price_score(), zero), "score_float_v2": F.coalesce(1 - _float_score(), zero), "score_country": _country_score(blocked)}
    )
    return s.withColumn("score_composite_v2", (F.col("score_price_v2") + F.col("score_float_v2") + F.col("score_country")) / 3)


def terciles(scored: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("date",)) -> DataFrame:
    """Low, Med and High thirds per dimension (thirds of n div 3, the rest joins High), within each date."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("score")) for d in dims])
    long = scored.withColumn("_p", F.explode(pairs)).select("*", F.col("_p.dim").alias("dim"), F.col("_p.score").alias("score")).drop("_p")
    w = Window.partitionBy(*keys, "dim")
    r = F.row_number().over(w.orderBy("score", "entry_id"))
    k = F.floor(F.count(F.lit(1)).over(w) / 3)
    out = long.withColumn("_r", r).withColumn("_k", k).filter(F.col("_k") >= 1)
    return out.withColumn("tercile", F.when(F.col("_r") <= F.col("_k"), "Low").when(F.col("_r") <= 2 * F.col("_k"), "Med").otherwise("High")).drop("_r", "_k")


def tercile_report(parts: DataFrame, results: DataFrame) -> DataFrame:
    """Strategy report of every (dimension, tercile, strategy)."""
    r = parts.select("entry_id", "dim", "tercile").join(results, "entry_id")
    return strategy_report(r, ("dim", "tercile", "strategy"))


def threshold_sweep(scored: DataFrame, results: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Strategy results of candidates at or above each score threshold, from one pass of conditional aggregates."""
    r = scored.select("entry_id", score).join(results.select("entry_id", "pnl_pct", "mfe_pct"), "entry_id")
    aggs = []
    for i, th in enumerate(thresholds):
        on = F.col(score) >= th
        win = F.when(F.col("pnl_pct") > 0, 1.0).otherwise(0.0)
        aggs += [F.count(F.when(on, 1)).alias(f"n{i}"), F.avg(F.when(on, F.col("pnl_pct"))).alias(f"e{i}"), F.avg(F.when(on, win)).alias(f"w{i}"), F.avg(F.when(on, F.col("mfe_pct"))).alias(f"m{i}")]
    rows = [
        F.struct(F.lit(float(th)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("expectancy_pct"), F.col(f"w{i}").alias("win_rate"), F.col(f"m{i}").alias("mean_mfe"))
        for i, th in enumerate(thresholds)
    ]
    return r.agg(*aggs).select(F.inline(F.array(*rows)))


def tradable_split(c: DataFrame, results: DataFrame) -> DataFrame:
    """Strategy reports of tradable (trade rate known at entry), zombie and all candidates."""
    g = c.select("entry_id", F.when(F.col("trade_rate").isNotNull(), "TRADABLE").otherwise("ZOMBIE").alias("_g"))
    r = results.join(g, "entry_id").withColumn("split", F.explode(F.array("_g", F.lit("ALL")))).drop("_g")
    return strategy_report(r, ("split", "strategy"))


def false_negative_audit(scored: DataFrame, momo_pct: float = 50.0) -> DataFrame:
    """Big movers that the score rules would have rejected, with the reasons."""
    reasons = F.array(
        F.when(F.col("score_trade_rate") < 0.05, "trade_rate"), F.when(F.col("score_spread") < 0.05, "spread"), F.when(F.col("score_country") < 0.5, "country")
    )
    s = scored.withColumn("is_momo", F.col("entry_to_peak_pct") >= momo_pct).withColumn("rejection_reasons", F.concat_ws(",", F.filter(reasons, lambda x: x.isNotNull())))
    s = s.withColumn("would_reject", F.col("rejection_reasons") != "")
    return s.withColumn("is_false_negative", F.col("is_momo") & F.col("would_reject"))
