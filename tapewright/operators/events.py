"""Event rules over factor tables: match flags, classification, the watch-entry stages, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.folds import thin_by_interval, transitions
from tapewright.functions.numeric import clamp, ratio
from tapewright.functions.rules import ANTI_PATTERNS, ENTRY_RULES, WATCH_RULES, WATCH_TIMEOUT_MS, Rule, any_of
from tapewright.functions.timewin import asof_join, sliding
from tapewright.operators.joins import first_at_or_after


def rule_flags(factors: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One boolean column per rule, hard constraints included."""
    cols = factors.columns
    return factors.select("*", *[(r.matches(cols) & r.hard_ok(cols)).alias(r.name) for r in rules])


# The published densities, (factor, threshold, window in ms, name).
DENSITIES = (("trade_rate", 150.0, 300_000, "signal_density_5m"), ("trade_rate", 100.0, 180_000, "signal_density_3m"))


def with_signal_density(factors: DataFrame, densities: Sequence[tuple[str, float, int, str]] = DENSITIES, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """`factors` with, per density, how often its factor exceeded the threshold in (t - window, t]."""
    for factor, threshold, window_ms, name in densities:
        hit = F.when((F.col(factor) > threshold) & ~F.isnan(factor), 1).otherwise(0)
        factors = sliding(factors, list(keys), "ts_ms", {name: ("sum", hit)}, -window_ms + 1)
    return factors.withColumns({name: F.col(name).cast("double") for *_, name in densities})


def rule_matches(factors: DataFrame, rules: Sequence[Rule], ids: Sequence[str] = ("ticker", "ts_ms")) -> DataFrame:
    """Long form: one row per (row, matching rule). Rows without a match are dropped before the explode."""
    cols = factors.columns
    hit = F.filter(F.array(*[F.when(r.matches(cols) & r.hard_ok(cols), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return factors.select(*ids, hit.alias("_r")).filter(F.size("_r") > 0).select(*ids, F.explode("_r").alias("rule"))


def classify(factors: DataFrame, rules: Sequence[Rule], anti: Sequence[Rule], name: str = "event_name") -> DataFrame:
    """First matching rule in order; null where an anti-pattern or no rule matches. Adds `rejected`."""
    cols = factors.columns
    bad = any_of(anti, cols)
    first = F.coalesce(*[F.when(r.matches(cols), F.lit(r.name)) for r in rules])
    return factors.withColumn("rejected", bad).withColumn(name, F.when(~bad, first))


def watch(factors: DataFrame, candidates: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Watch stage: the first factor row at or after each candidate's first entry, against the watch rules in order.

    `factors` already starts at the first entry, so that row is the earliest one of its key.
    """
    name = F.coalesce(*[F.when(r.matches(factors.columns), F.lit(r.name)) for r in rules])
    first = factors.groupBy(*keys).agg(F.min("ts_ms").alias("watch_ms"), F.min_by(name, "ts_ms").alias("watch_event"))
    return first.filter(F.col("watch_event").isNotNull())


def entries(
    factors: DataFrame,
    watched: DataFrame,
    rules: Sequence[Rule],
    anti: Sequence[Rule] = (),
    timeout_ms: int | Column = WATCH_TIMEOUT_MS,
    keys: Sequence[str] = ("ticker",),
    rule_order_first: bool = False,
) -> DataFrame:
    """Entry stage: one entry per key within the timeout after its watch.

    The earliest matching row wins, ties by rule order; with `rule_order_first` the first rule that ever
    matches wins and its earliest row is taken. A plain min_by, combined on the map side.
    """
    cols = factors.columns
    rank = F.coalesce(*[F.when(r.matches(cols), F.lit(i)) for i, r in enumerate(rules)])
    timeout = timeout_ms if isinstance(timeout_ms, Column) else F.lit(timeout_ms).cast("long")
    rows = factors.join(watched, list(keys))
    rows = rows.filter((F.col("ts_ms") >= F.col("watch_ms")) & (F.col("ts_ms") - F.col("watch_ms") <= timeout) & ~any_of(anti, cols))
    if rule_order_first:
        hits = F.filter(F.array(*[F.when(r.matches(cols), F.lit(i)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
        rows = rows.withColumn("_rank", F.explode(hits))
        order = F.struct("_rank", "ts_ms")
    else:
        rows = rows.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
        order = F.struct("ts_ms", "_rank")
    names = F.array(*[F.lit(r.name) for r in rules])
    best = rows.groupBy(*keys).agg(F.min(order).alias("_o"), F.first("watch_ms").alias("watch_ms"), F.first("watch_event").alias("watch_event"))
    return best.select(*keys, "watch_ms", "watch_event", F.col("_o.ts_ms").alias("entry_ms"), F.element_at(names, F.col("_o._rank") + 1).alias("event_name"))


def stage_signals(
    factors: DataFrame,
    candidates: DataFrame,
    watch_rules: Sequence[Rule] = WATCH_RULES,
    entry_rules: Sequence[Rule] = ENTRY_RULES,
    anti: Sequence[Rule] = ANTI_PATTERNS,
    timeout_ms: int = WATCH_TIMEOUT_MS,
    keys: Sequence[str] = ("ticker",),
    rule_order_first: bool = False,
) -> DataFrame:
    """Watch and entry of every candidate over its factor rows."""
    w = watch(factors, candidates, watch_rules, keys)
    return entries(factors, w, entry_rules, anti, timeout_ms, keys, rule_order_first)


def cooldown(matches: DataFrame, cooldown_ms: int = 60_000, keys: Sequence[str] = ("rule", "ticker")) -> DataFrame:
    """Keep a trigger when the last kept one of its (rule, ticker) is at least `cooldown_ms` old."""
    return thin_by_interval(matches, list(keys), "ts_ms", cooldown_ms)


# The activity state machine's threshold and hold time.
ACTIVE_Z = 5.0
STATE_HOLD_MS = 10_000


def is_active(z_threshold: float = ACTIVE_Z) -> Column:
    """z above the threshold with positive acceleration; null and NaN are no activity."""
    above = lambda c, limit: (F.col(c) > limit) & ~F.isnan(c)
    return F.coalesce(above("z", z_threshold) & above("accel", 0), F.lit(False))


def activity_states(factors: DataFrame, z_threshold: float = ACTIVE_Z, hold_ms: int = STATE_HOLD_MS) -> DataFrame:
    """QUIET/ACTIVE transitions: active on z > threshold with positive acceleration, quiet again no sooner than `hold_ms`.

    `factors` has ticker, ts_ms, z, accel.
    """
    on = is_active(z_threshold)
    moves = transitions(factors.select("ticker", "ts_ms", "z", "accel"), ["ticker"], "ts_ms", [on, ~on], [hold_ms, 0], name="_mode")
    return moves.select("ticker", "ts_ms", F.when(F.col("_mode") == 1, "ACTIVE").otherwise("QUIET").alias("state"))


def model_gate(scored: DataFrame, rule: Rule, prediction: str = "prediction") -> DataFrame:
    """Model-gated entries: hard constraints, minimum expected return, confidence from the distance to it."""
    limit = float(rule.min_expected_return or 0.0)
    dist = F.col(prediction) - limit
    conf = F.when(dist > 0, F.least(F.lit(1.0), 0.5 + dist / (limit + 0.05) * 0.5)).otherwise(
        F.greatest(F.lit(0.0), 0.5 + dist / limit * 0.5) if limit else F.lit(0.0)
    )
    hard = rule.hard_ok(scored.columns)
    out = scored.withColumn("expected_return", F.when(hard, F.col(prediction)).otherwise(0.0)).withColumn("confidence", F.when(hard, conf).otherwise(0.0))
    enter = hard & (F.col("expected_return") >= limit) & (F.col("confidence") >= rule.min_confidence)
    reason = (
        F.when(~hard, "hard_constraints").when(F.col("expected_return") < limit, "below_threshold")
        .when(F.col("confidence") < rule.min_confidence, "low_confidence").otherwise("enter")
    )
    return out.withColumn("should_enter", enter).withColumn("gate_reason", reason)


def catalyst_events(news: DataFrame, snapshots: DataFrame, profiles: DataFrame, tolerance_ms: int | None = None) -> DataFrame:
    """Positive catalyst news with the market row at that time and the ticker's float."""
    pos = news.filter(F.col("is_catalyst"))
    j = asof_join(pos, snapshots, ["ticker"], "ts_ms", "window_ms", ["price", "change_pct", "volume"], tolerance_ms=tolerance_ms)
    return j.join(profiles.select("ticker", "float_shares", "market_cap", "sector"), "ticker", "left")


def validate_rules(signals: DataFrame, value: str = "ret", avoid: Sequence[str] = ()) -> DataFrame:
    """Per rule: date means first, then their mean, deviation, positive share; pass/fail per action.

    Two aggregations; a hot rule or date is combined on the map side.
    """
    s = signals.withColumn("_n", F.lit(1))
    by_date = s.groupBy("rule", "date").agg(
        F.avg(value).alias("_m"), F.avg(F.when(F.col(value) > 0, 1.0).when(F.col(value).isNotNull(), 0.0)).alias("_w"), F.count(F.lit(1)).alias("_c")
    ).filter(F.col("_m").isNotNull())
    out = by_date.groupBy("rule").agg(
        F.sum("_c").alias("total_signals"),
        F.avg("_m").alias("avg_return"),
        F.avg("_w").alias("win_rate"),
        F.avg(F.when(F.col("_m") > 0, 1.0).otherwise(0.0)).alias("positive_dates_ratio"),
        F.stddev_pop("_m").alias("return_std"),
        F.stddev_pop("_w").alias("win_rate_std"),
        F.count(F.lit(1)).alias("n_dates"),
    )
    # Acceptance thresholds.
    accept = (F.col("avg_return") > 0.02) & (F.col("win_rate") > 0.45) & (F.col("positive_dates_ratio") > 0.6) & (F.col("total_signals") >= 100)
    reject = (F.col("avg_return") < -0.02) & (F.col("win_rate") < 0.40) & (F.col("positive_dates_ratio") < 0.4) & (F.col("total_signals") >= 100)
    is_avoid = F.col("rule").isin(*avoid) if avoid else F.lit(False)
    stability = F.when(F.col("return_std") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("return_std") / (F.abs("avg_return") + 0.01)))
    return (
        out.withColumn("stability", stability)
        .withColumn("passes_basic", (F.col("avg_return") > 0) & (F.col("win_rate") > 0.4))
        .withColumn("is_valid", F.when(is_avoid, reject).otherwise(accept))
    )


def compare_rules(validated: DataFrame) -> DataFrame:
    """Validated rules, best mean return first."""
    return validated.orderBy(F.desc("avg_return"), "rule")
