"""Exits and returns of signals.

First-hit exits and excursions come from bucket summaries (`passage`): only the ticks of the bucket that first crosses a level are
looked at. Scaled exits walk the whole path of an entry, numbered bucket by bucket. Any number of strategies is
evaluated as columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.extremes import window_extremes
from tapewright.functions.numeric import floor_div, ratio
from tapewright.functions.ranks import attach_scalars, exact_quantiles
from tapewright.functions.timewin import carried, interval_join
from tapewright.operators.joins import close_at, nearest
from tapewright.operators.passage import first_hits, span_stats

HOUR = 3_600_000


@dataclass(frozen=True)
class Strategy:
    """First-hit exit: stop loss, take profit, trailing stop (percent) and time stop (minutes)."""

    tp: float | None = None
    sl: float | None = None
    trail: float | None = None
    time_min: float | None = None

    @property
    def name(self) -> str:
        parts = [f"{p}{v:.0f}{u}" for p, v, u in (("tp", self.tp, ""), ("sl", self.sl, ""), ("trail", self.trail, ""), ("time", self.time_min, "m")) if v is not None]
        return "_".join(parts) or "hold_to_end"


# The strategies of the standard sweep.
SWEEP = (
    Strategy(),
    *[Strategy(tp=t, sl=s) for t in (5.0, 10.0, 15.0) for s in (5.0, 10.0, 15.0)],
    *[Strategy(trail=x) for x in (2.0, 3.0, 5.0, 7.0)],
    Strategy(trail=3.0, sl=10.0),
    Strategy(trail=5.0, sl=10.0),
    Strategy(time_min=30.0),
    Strategy(time_min=60.0),
)


def price_path(entries: DataFrame, trades: DataFrame, include_entry: bool = False, bucket_ms: int = HOUR) -> DataFrame:
    """Trades of each entry in (entry, session end] ([entry, ... with `include_entry`), with running extremes.

    Rows are ordered inside the time buckets of an entry; a bucket's number of rows and extremes are carried to the next ones.
    """
    t = trades.select("ticker", "ts_ms", "seq", F.col("price").alias("px"), F.col("size").alias("sz"))
    j = interval_join(entries, t, ["ticker"], "entry_ms", "session_end_ms", "ts_ms", include_start=include_entry, bucket_ms=bucket_ms, how="inner")
    j = j.withColumn("_b", floor_div("ts_ms", bucket_ms))
    columns = {"step": F.count(F.lit(1)), "peak": F.max("px"), "trough": F.min("px")}
    return carried(j, ["entry_id"], ["ts_ms", "seq"], columns, {"step": F.sum, "peak": F.max, "trough": F.min}).drop("_b")


def _reason(s: Strategy, tp: Column | None = None) -> Column:
    px, ep = F.col("px"), F.col("entry_price")
    out = F.lit(None).cast("string")
    if s.time_min is not None:
        out = F.when(F.col("ts_ms") >= F.col("entry_ms") + int(s.time_min * 60_000), "time_stop").otherwise(out)
    if s.trail is not None:
        out = F.when(px <= F.greatest("peak", "entry_price") * (1 - s.trail / 100), "trailing_stop").otherwise(out)
    take = tp if tp is not None else (F.lit(s.tp) if s.tp is not None else None)
    if take is not None:
        out = F.when(px >= ep * (1 + take / 100), "take_profit").otherwise(out)
    if s.sl is not None:
        out = F.when(px <= ep * (1 - s.sl / 100), "stop_loss").otherwise(out)
    return out


_KEEP = ["entry_id", "ticker", "entry_ms", "entry_price", "session_end_ms"]


def _results(one: DataFrame, strategies: Sequence[Strategy], keep: Sequence[str]) -> DataFrame:
    """One row per (entry, strategy) from the first hits `_x<i>` and the last row `_end` of each entry."""
    options = []
    for i, s in enumerate(strategies):
        hit, end = F.col(f"_x{i}"), F.col("_end")
        pick = lambda f: F.coalesce(hit[f], end[f])  # noqa: B023, E731
        options.append(
            F.struct(
                F.lit(s.name).alias("strategy"),
                F.coalesce(hit["ts_ms"], F.col("session_end_ms")).alias("exit_ms"),
                pick("px").alias("exit_price"),
                pick("peak").alias("_peak"),
                pick("trough").alias("_trough"),
                F.coalesce(hit["reason"], F.lit("session_end")).alias("exit_reason"),
            )
        )
    out = one.select(*keep, F.inline(F.array(*options)))
    pct = lambda c: (F.col(c) - F.col("entry_price")) / F.col("entry_price") * 100
    return out.select(
        *keep, "strategy", "exit_ms", "exit_price", "exit_reason",
        pct("exit_price").alias("pnl_pct"), pct("_peak").alias("mfe_pct"), pct("_trough").alias("mae_pct"),
        ((F.col("exit_ms") - F.col("entry_ms")) / 60000.0).alias("duration_min"),
    )


def simulate(path: DataFrame, strategies: Sequence[Strategy], ids: Sequence[str] = (), tp: Column | None = None) -> DataFrame:
    """`simulate_entries` over a path that is there already."""
    keep = [*_KEEP, *ids]
    aggs = []
    for i, s in enumerate(strategies):
        r = _reason(s, tp)
        aggs.append(F.min(F.when(r.isNotNull(), F.struct("step", "ts_ms", "px", "peak", "trough", r.alias("reason")))).alias(f"_x{i}"))
    one = path.groupBy(*keep).agg(F.max(F.struct("step", "ts_ms", "px", "peak", "trough")).alias("_end"), *aggs)
    return _results(one, strategies, keep)


def _crossed(s: Strategy, falls: Sequence[float], tp: Column | None = None) -> Column:
    """Whether a bucket holds a row on which the strategy exits (see `passage.first_hits`)."""
    ep, out = F.col("entry_price"), F.lit(False)
    take = tp if tp is not None else (F.lit(s.tp) if s.tp is not None else None)
    if s.sl is not None:
        out = out | (F.col("lo") <= ep * (1 - s.sl / 100))
    if take is not None:
        out = out | (F.col("hi") >= ep * (1 + take / 100))
    if s.trail is not None:
        # Below the highest price before the bucket, or below a higher one inside it.
        out = out | (F.col("lo") <= F.greatest("peak_in", "entry_price") * (1 - s.trail / 100)) | F.col(f"fall{falls.index(s.trail)}")
    if s.time_min is not None:
        out = out | (F.col("last_ms") >= F.col("entry_ms") + int(s.time_min * 60_000))
    return out


def simulate_entries(entries: DataFrame, trades: DataFrame, strategies: Sequence[Strategy], ids: Sequence[str] = (), tp: Column | None = None) -> DataFrame:
    """One row per (entry, strategy): first exit hit, PnL, best and worst excursion until the exit, duration.

    All strategies share one pass over the bucket summaries and one over the ticks of the buckets in which some strategy exits.
    `tp` replaces the strategies' take-profit by a column of the entries. Entries without trades have no row.
    """
    keep = [*_KEEP, *ids]
    falls = sorted({s.trail for s in strategies if s.trail is not None})
    one = first_hits(entries, trades, keep, [_crossed(s, falls, tp) for s in strategies], [_reason(s, tp) for s in strategies], falls)
    return _results(one, strategies, keep)


def strategy_report(results: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Win rate, mean win and loss, expectancy, mean excursion and duration per strategy."""
    win, pnl = F.col("pnl_pct") > 0, F.col("pnl_pct")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count(F.when(win, 1)).alias("n_profitable"),
        F.avg(F.when(win, 1.0).otherwise(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(win, pnl)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(~win, pnl)), F.lit(0.0)).alias("avg_loss_pct"),
        F.avg(pnl).alias("expectancy_pct"),
        F.avg("mfe_pct").alias("avg_mfe_pct"),
        F.avg("duration_min").alias("avg_duration_min"),
    )


def best_strategies(reports: DataFrame, n: int = 5) -> DataFrame:
    return reports.orderBy(F.desc("expectancy_pct"), "strategy").limit(n)


def excursions(entries: DataFrame, trades: DataFrame) -> DataFrame:
    """Best, worst and closing return of each entry over its whole session."""
    pct = lambda c: (F.col(c) - F.col("entry_price")) / F.col("entry_price") * 100
    out = entries.select("entry_id", "ticker", "entry_price").join(span_stats(entries, trades), "entry_id")
    return out.select("entry_id", "ticker", "entry_price", pct("hi").alias("mfe_pct"), pct("lo").alias("mae_pct"), pct("last_px").alias("close_pct"))


def excursion_summary(exc: DataFrame) -> DataFrame:
    hit = lambda x: F.count(F.when(F.col("mfe_pct") >= x, 1)).alias(f"hit_{x}pct")
    out = exc.agg(F.count(F.lit(1)).alias("n"), F.avg("mfe_pct").alias("mean_mfe"), F.avg("close_pct").alias("mean_close"), hit(5), hit(10), hit(15))
    out = attach_scalars(out, exact_quantiles(exc, "mfe_pct", {"median_mfe": 0.5}))
    out = attach_scalars(out, exact_quantiles(exc, "close_pct", {"median_close": 0.5}))
    return out.select("n", "mean_mfe", "median_mfe", "mean_close", "median_close", "hit_5pct", "hit_10pct", "hit_15pct")


@dataclass(frozen=True)
class PartialExits:
    """Scaled exit: (gain percent, share sold) steps, stop loss, optional trailing stop and holding limit."""

    name: str
    steps: tuple[tuple[float, float], ...] = ()
    stop_loss: float = 8.0
    trail_trigger: float = 0.0
    trail: float = 0.0
    max_hold_min: int = 0


# The three published configurations.
SCALE_FAST = PartialExits("scale_fast", ((5.0, 0.50), (10.0, 0.30), (15.0, 0.20)), 8.0)
TP10_SL15 = PartialExits("tp10_sl15", ((10.0, 1.0),), 15.0)


def simple_hold(minutes: int = 10) -> PartialExits:
    return PartialExits("simple_hold", (), 100.0, max_hold_min=minutes)


def partial_exits(path: DataFrame, config: PartialExits, ids: Sequence[str] = ()) -> DataFrame:
    """Position-weighted result of a scaled exit per entry.

    Stop loss is checked before the trailing stop, that before the take-profit steps, and the holding
    limit last, so a step still sells on the row of the holding limit but not on that of a stop. Each
    event is reduced to the number of its first row by an aggregation; the weights follow from comparing those numbers.
    """
    never = 2**62
    gain = (F.col("px") - F.col("entry_price")) / F.col("entry_price") * 100
    held = (F.col("ts_ms") - F.col("entry_ms")) / 60000.0
    p = path.withColumn("gain", gain)
    first = lambda cond: F.min(F.when(cond, F.col("step")))
    firsts = {f"_f{i}": first(F.col("gain") >= at) for i, (at, _) in enumerate(config.steps)} | {"_stop": first(F.col("gain") <= -config.stop_loss)}
    if config.max_hold_min > 0:
        firsts["_time"] = first(held >= config.max_hold_min)
    trailing = config.trail_trigger > 0 and config.trail > 0 and bool(config.steps)
    if trailing:
        # Trailing starts at the first row on which a step sells at or above the trigger.
        for i, (at, _) in enumerate(config.steps):
            firsts[f"_g{i}"] = F.min_by("gain", F.when(F.col("gain") >= at, F.col("step")))
    marks = p.groupBy("entry_id").agg(*[c.alias(n) for n, c in firsts.items()])
    if config.max_hold_min <= 0:
        marks = marks.withColumn("_time", F.lit(None).cast("long"))
    if trailing:
        starts = [F.when(F.col(f"_g{i}") >= config.trail_trigger, F.col(f"_f{i}")) for i in range(len(config.steps))]
        marks = marks.withColumn("_a", F.least(*starts) if len(starts) > 1 else starts[0])
        since = p.join(marks.select("entry_id", "_a"), "entry_id").filter(F.col("step") >= F.col("_a")).withColumn("_b", floor_div("ts_ms", HOUR))
        since = carried(since, ["entry_id"], ["step"], {"_high": F.max("px")}, {"_high": F.max})
        floor = (F.col("_high") - F.col("entry_price")) / F.col("entry_price") * 100 - config.trail
        hit = since.filter((F.col("step") > F.col("_a")) & (F.col("gain") <= floor)).groupBy("entry_id").agg(F.min("step").alias("_trail"))
        marks = marks.join(hit, "entry_id", "left")
    else:
        marks = marks.withColumn("_trail", F.lit(None).cast("long"))
    keep = ["entry_id", "ticker", "entry_ms", "entry_price", *ids]
    p = p.join(marks, "entry_id")
    big = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(never))
    cut = F.least(big("_stop"), big("_trail"))
    sold = F.lit(0.0)
    for i, (_, share) in enumerate(config.steps):
        done = (big(f"_f{i}") < cut) & (big(f"_f{i}") <= big("_time"))
        p = p.withColumn(f"_w{i}", F.when(done, F.lit(share)).otherwise(0.0))
        sold = sold + F.col(f"_w{i}")
    rest_at_time = 1 - sum((F.when(big(f"_f{i}") <= big("_time"), F.lit(s)).otherwise(0.0) for i, (_, s) in enumerate(config.steps)), F.lit(0.0))
    # A position already sold out is not stopped by the holding limit; its extremes run on.
    p = p.withColumn("_limit", F.when((big("_time") < cut) & (rest_at_time > 1e-12), F.col("_time")))
    p = p.withColumn("_end", F.least(cut, big("_limit")))
    p = p.withColumn("_rest", F.greatest(1 - sold, F.lit(0.0)))
    seen = F.col("step") <= F.col("_end")
    sold_here = F.lit(False)
    for i in range(len(config.steps)):
        sold_here = sold_here | ((F.col("step") == F.col(f"_f{i}")) & (F.col(f"_w{i}") > 0))
    agg = p.groupBy(*keep).agg(
        *[F.max(F.when(F.col("step") == F.col(f"_f{i}"), F.col("gain"))).alias(f"g{i}") for i in range(len(config.steps))],
        *[F.first(f"_w{i}").alias(f"w{i}") for i in range(len(config.steps))],
        F.max(F.when(sold_here, F.col("ts_ms"))).alias("last_sale_ms"),
        F.first("_rest").alias("rest"),
        F.first(F.col("_stop") == F.col("_end")).alias("by_stop"),
        F.first(F.col("_trail") == F.col("_end")).alias("by_trail"),
        F.first(F.col("_limit") == F.col("_end")).alias("by_time"),
        F.max(F.when(F.col("step") == F.col("_end"), F.struct("gain", "ts_ms", "px"))).alias("end_row"),
        F.max(F.struct("step", "gain", "ts_ms", "px")).alias("last_row"),
        F.max(F.when(seen, F.struct("px", -F.col("step"), -F.col("ts_ms")))).alias("hi"),
        F.min(F.when(seen, F.struct("px", "step", "ts_ms"))).alias("lo"),
    )
    end_gain = F.coalesce(F.col("end_row.gain"), F.col("last_row.gain"))
    total = end_gain * F.col("rest")
    tp = F.lit(0.0)
    for i in range(len(config.steps)):
        total = total + F.coalesce(F.col(f"g{i}") * F.col(f"w{i}"), F.lit(0.0))
        tp = tp + F.col(f"w{i}")
    stop, trail, limit = (F.coalesce(F.col(c), F.lit(False)) for c in ("by_stop", "by_trail", "by_time"))
    share = lambda cond: F.when(cond, F.col("rest")).otherwise(0.0)
    price = F.col("entry_price")
    return agg.select(
        *keep,
        F.lit(config.name).alias("strategy"),
        total.alias("return_pct"),
        tp.alias("take_profit_share"),
        share(stop).alias("stop_loss_share"),
        share(~stop & trail).alias("trailing_share"),
        share(~stop & ~trail & limit).alias("time_share"),
        share(~stop & ~trail & ~limit).alias("close_share"),
        F.greatest(price, F.col("hi.px")).alias("max_price"),
        F.least(price, F.col("lo.px")).alias("min_price"),
        F.when(F.col("hi.px") > price, -F.col("hi")["col3"] - F.col("entry_ms")).otherwise(0).alias("time_to_max_ms"),
        F.when(F.col("lo.px") < price, F.col("lo.ts_ms") - F.col("entry_ms")).otherwise(0).alias("time_to_min_ms"),
        # The time of the last sale: the end of the path unless the steps sold everything before.
        F.when(F.col("rest") > 1e-12, F.coalesce(F.col("end_row.ts_ms"), F.col("last_row.ts_ms"))).otherwise(F.col("last_sale_ms")).alias("exit_ms"),
    )


def simulate_holds(entries: DataFrame, trades: DataFrame, stop_loss: float = -1.0, take_profit: float = 2.0) -> DataFrame:
    """Simple hold / stop / target up to `session_end_ms`, the end of the hold; an expired hold exits at its last trade."""
    ret = lambda c: (F.col(c) - F.col("entry_price")) / F.col("entry_price") * 100
    reason = F.when(ret("px") <= stop_loss, "stop_loss").when(ret("px") >= take_profit, "take_profit")
    keep = ["entry_id", "ticker", "entry_ms", "entry_price"]
    one = first_hits(entries, trades, keep, [(ret("lo") <= stop_loss) | (ret("hi") >= take_profit)], [reason])
    out = one.select(
        *keep, F.coalesce("_x0.ts_ms", "_end.ts_ms").alias("exit_ms"), F.coalesce("_x0.px", "_end.px").alias("exit_price"), F.coalesce("_x0.reason", F.lit("hold_expired")).alias("exit_reason")
    )
    return out.withColumn("return_pct", ret("exit_price")).withColumn("hold_minutes", (F.col("exit_ms") - F.col("entry_ms")) / 60000.0)


def trade_summary(trades: DataFrame) -> DataFrame:
    """Totals and extremes, with one count per exit reason."""
    r = F.col("return_pct")
    reasons = ("stop_loss", "take_profit", "hold_expired")
    return trades.agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(r).alias("avg_return"), F.sum(r).alias("total_return"), F.max(r).alias("max_return"), F.min(r).alias("min_return"),
        F.avg("hold_minutes").alias("avg_hold_minutes"),
        *[F.count(F.when(F.col("exit_reason") == x, 1)).alias(f"n_{x}") for x in reasons],
    )


def _at_horizons(points: DataFrame, ts: str, horizons_ms: dict[str, int]) -> DataFrame:
    """One row per (point, horizon), so that a single lookup serves all horizons."""
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(h).cast("long").alias("off")) for n, h in horizons_ms.items()])
    return points.withColumn("_h", F.explode(pairs)).withColumn("_t", F.col(ts) + F.col("_h.off"))


def _one_row(rows: DataFrame, points: DataFrame, values: dict[str, Column], horizons_ms: dict[str, int]) -> DataFrame:
    """Back to one row per point (points are distinct rows): <name>_<label> columns."""
    aggs = [F.max(F.when(F.col("_h.label") == n, v)).alias(f"{name}_{n}") for n in horizons_ms for name, v in values.items()]
    return rows.groupBy(*points.columns).agg(*aggs)


def backfill_returns(signals: DataFrame, bars: DataFrame, horizons_ms: dict[str, int], ts: str = "ts_ms", price: str = "price", bar_ms: int = 60_000, forward_ms: int = 120_000) -> DataFrame:
    """return_<label> = fractional return to the close of the bar containing ts + horizon."""
    rows = close_at(bars, _at_horizons(signals, ts, horizons_ms), "_t", bar_ms, forward_ms, "_c")
    return _one_row(rows, signals, {"return": ratio(F.col("_c") - F.col(price), price)}, horizons_ms)


def outcomes(obs: DataFrame, trades: DataFrame, horizons_ms: dict[str, int], key: str = "obs_id", window_ms: int = 120_000) -> DataFrame:
    """Trigger price, return and maximum return per horizon, one row per observation."""
    t = trades.select("ticker", "ts_ms", "seq", "price")
    spans = {"trigger": 0, **horizons_ms}
    rows = nearest(_at_horizons(obs, "trigger_ms", spans), t, "_t", "ts_ms", "price", "seq", window_ms, "_px")
    out = _one_row(rows, obs, {"_p": F.col("_px")}, spans)
    for n, h in horizons_ms.items():
        best = window_extremes(obs, t, key, "trigger_ms", h, include_start=True)
        out = out.join(best.select(key, F.col("hi").alias(f"_m_{n}")), key, "left")
    tp = F.col("_p_trigger")
    cols = []
    for n in horizons_ms:
        cols += [ratio(F.col(f"_p_{n}") - tp, tp).alias(f"return_{n}"), ratio(F.col(f"_m_{n}") - tp, tp).alias(f"max_return_{n}")]
    return out.select(*obs.columns, tp.alias("trigger_price"), *cols)


def continuation_labels(entries: DataFrame, trades: DataFrame, first: float = 5.0, target: float = 10.0) -> DataFrame:
    """What followed the first +5 %: runner (reached +10 % afterwards), fader (fell back to entry) or drift.

    The first hit is a passage; what follows is the span from it to the end of the session.
    """
    up = lambda c: F.col(c) >= F.col("entry_price") * (1 + first / 100)
    keep = ["entry_id", "ticker", "entry_ms", "entry_price", "session_end_ms"]
    hit = first_hits(entries, trades, keep, [up("hi")], [F.when(up("px"), "up")]).filter(F.col("_x0").isNotNull())
    hit = hit.select(*keep, F.col("_x0.ts_ms").alias("hit_ms"), F.col("_x0.px").alias("hit_price"))
    after = span_stats(hit.select("entry_id", "ticker", F.col("hit_ms").alias("entry_ms"), "session_end_ms"), trades)
    label = F.when(F.col("hi") >= F.col("entry_price") * (1 + target / 100), "runner").when(F.col("lo") <= F.col("entry_price"), "fader").otherwise("drift")
    return hit.join(after, "entry_id").select("entry_id", "ticker", "entry_ms", "entry_price", "hit_ms", "hit_price", label.alias("label"))
