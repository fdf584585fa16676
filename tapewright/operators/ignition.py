"""Ignition detectors and activity features over the price path of each entry.

A path is one ticker's trades from an entry to its session end. Windows over its trades are cut into time buckets; only
minutes are ordered by entry. `minute_ms` is the detectors' time unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions.numeric import floor_div, ratio
from tapewright.functions.timewin import UNB, asof_join, interval_join, lagged, range_windows, sliding
from tapewright.operators.passage import span_stats
from tapewright.operators.ticks import spread_bps, valid_quote

MINUTE = 60_000
METHODS = ("vol_exp", "range_breakout", "trade_rate_surge", "sustained_activity", "spread_collapse")


def _first(rows: DataFrame, ms: str | Column, price: str | Column, method: str) -> DataFrame:
    hit = F.struct((F.col(ms) if isinstance(ms, str) else ms).alias("ms"), (F.col(price) if isinstance(price, str) else price).alias("price"))
    return rows.groupBy("entry_id").agg(F.min(hit).alias("_h")).select("entry_id", F.lit(method).alias("method"), "_h.ms", "_h.price")


def volume_expansion(path: DataFrame, ratio_min: float = 3.0, min_history: float = 100.0, minute_ms: int = MINUTE) -> DataFrame:
    """First trade whose last minute's volume exceeds `ratio_min` times the per-minute mean of the five before."""
    p = path.select("entry_id", "entry_ms", "ts_ms", "px", "sz")
    for name, frame in (("_v1", (-minute_ms, 0)), ("_v5", (-6 * minute_ms, -minute_ms - 1))):
        p = sliding(p, ["entry_id"], "ts_ms", {name: ("sum", F.col("sz"))}, *frame)
    ok = (F.col("ts_ms") >= F.col("entry_ms") + 6 * minute_ms) & (F.col("_v5") >= min_history) & (F.col("_v1") / (F.col("_v5") / 5.0) > ratio_min)
    return _first(p.filter(ok), "ts_ms", "px", "vol_exp")


def range_breakout(path: DataFrame, minute_ms: int = MINUTE) -> DataFrame:
    """First trade above the highest price of the ten minutes before it."""
    p = sliding(path.select("entry_id", "entry_ms", "ts_ms", "px"), ["entry_id"], "ts_ms", {"_m": ("max", F.col("px"))}, -10 * minute_ms, -1)
    return _first(p.filter((F.col("ts_ms") >= F.col("entry_ms") + 10 * minute_ms) & (F.col("px") > F.col("_m"))), "ts_ms", "px", "range_breakout")


def minute_counts(path: DataFrame, minute_ms: int = MINUTE) -> DataFrame:
    """Trades per entry-anchored minute that has any; the empty minutes are implied by the numbers."""
    b = F.floor((F.col("ts_ms") - F.col("entry_ms")) / minute_ms).cast("long")
    n = F.ceil((F.col("session_end_ms") - F.col("entry_ms")) / minute_ms)
    return (
        path.withColumn("minute", b).withColumn("minutes", n).filter(F.col("minute") < F.col("minutes"))
        .groupBy("entry_id", "entry_ms", "minute", "minutes")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("step", "px"))["px"].alias("first_px"))
    )


def trade_rate_surge(path: DataFrame, sigma: float = 3.0, warmup: int = 20, minute_ms: int = MINUTE) -> DataFrame:
    """First minute (after `warmup`) with more trades than mean + sigma deviations of all minutes before it.

    Empty minutes add nothing to the sums and cannot fire, so no grid is built for them.
    """
    w = Window.partitionBy("entry_id").orderBy("minute").rowsBetween(UNB, -1)
    c = minute_counts(path, minute_ms).withColumn("_s", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("_q", F.coalesce(F.sum(F.col("n") * F.col("n")).over(w), F.lit(0)))
    mean = F.col("_s") / F.when(F.col("minute") > 0, F.col("minute"))
    sd = F.sqrt(F.greatest(F.col("_q") / F.when(F.col("minute") > 0, F.col("minute")) - mean * mean, F.lit(0.0)))
    ok = (F.col("minutes") > warmup) & (F.col("minute") >= warmup) & (sd > 0) & (F.col("n") > mean + sigma * sd)
    return _first(c.filter(ok), F.col("entry_ms") + F.col("minute") * minute_ms, "first_px", "trade_rate_surge")


def sustained_activity(path: DataFrame, min_trades: int = 3, minute_ms: int = MINUTE) -> DataFrame:
    """First of three consecutive minutes with at least `min_trades` trades each."""
    w = Window.partitionBy("entry_id").orderBy("minute")
    c = minute_counts(path, minute_ms).filter(F.col("n") >= min_trades)
    c = c.withColumn("_n2", F.lead("minute", 2).over(w))
    return _first(c.filter(F.col("_n2") == F.col("minute") + 2), F.col("entry_ms") + F.col("minute") * minute_ms, "first_px", "sustained_activity")


def spread_collapse(entries: DataFrame, quotes: DataFrame, max_bps: float = 100.0) -> DataFrame:
    """First valid quote after the entry with a spread below `max_bps`; the price is its mid."""
    q = quotes.filter(valid_quote(strict=True)).withColumn("_bps", spread_bps()).filter(F.col("_bps") < max_bps)
    q = q.select("ticker", "ts_ms", ((F.col("bid") + F.col("ask")) / 2).alias("_mid"))
    j = interval_join(entries.select("entry_id", "ticker", "entry_ms", "session_end_ms"), q, ["ticker"], "entry_ms", "session_end_ms", "ts_ms", how="inner")
    return _first(j, "ts_ms", "_mid", "spread_collapse")


def detect_all(path: DataFrame, entries: DataFrame, quotes: DataFrame, minute_ms: int = MINUTE, max_bps: float = 100.0) -> DataFrame:
    """Every detector's first hit: (entry_id, method, ms, price)."""
    out = volume_expansion(path, minute_ms=minute_ms)
    for part in (range_breakout(path, minute_ms), trade_rate_surge(path, minute_ms=minute_ms), sustained_activity(path, minute_ms=minute_ms), spread_collapse(entries, quotes, max_bps)):
        out = out.unionByName(part)
    return out


def ignition_table(hits: DataFrame) -> DataFrame:
    """One row per entry with <method>_ms and <method>_price."""
    return hits.groupBy("entry_id").agg(
        *[F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in METHODS for c in ("ms", "price")]
    )


def trade_intensity(path: DataFrame, minute_ms: int = MINUTE) -> DataFrame:
    """Liquidity and momentum features of each entry's path."""
    p = lagged(path.withColumn("_b", floor_div("ts_ms", 60 * MINUTE)), ["entry_id"], ["step"], {"_pt": "ts_ms", "_pp": "px"})
    p = p.withColumn("_gap", (F.col("ts_ms") - F.col("_pt")) / 1000.0)
    p = p.withColumn("_up", F.when(F.col("_pp").isNotNull(), F.when(F.col("px") >= F.col("_pp"), 1.0).otherwise(0.0)))
    # Sizes and gaps repeat: the exact percentiles are aggregates over distinct values with counts, combined on the map side.
    marks = path.groupBy("entry_id").agg(F.percentile("sz", 0.75).alias("_q75"), F.count(F.lit(1)).alias("_n"))
    p = p.join(marks, "entry_id")
    early = F.col("ts_ms") <= F.col("entry_ms") + 5 * minute_ms
    big = F.col("sz") >= F.col("_q75")
    span = (F.col("session_end_ms") - F.col("entry_ms")) / 1000.0
    minute = lambda i: F.count(F.when((F.col("ts_ms") >= F.col("entry_ms") + i * minute_ms) & (F.col("ts_ms") < F.col("entry_ms") + (i + 1) * minute_ms), 1))
    g = p.groupBy("entry_id", "ticker", "entry_ms", "entry_price", "session_end_ms").agg(
        F.count(F.when(early, 1)).alias("n_trades_first_5min"),
        F.count(F.lit(1)).alias("n_fwd_trades"),
        F.max("_gap").alias("_mg"), F.percentile("_gap", 0.5).alias("_dg"), F.stddev_pop("_gap").alias("_sg"), F.avg("_gap").alias("_ag"),
        F.coalesce(F.sum(F.when(early, F.col("px") * F.col("sz"))), F.lit(0.0)).alias("dollar_vol_5min"),
        F.avg(F.when(big & (F.col("_n") >= 5), F.col("px"))).alias("_bp"),
        F.max(F.when(early, F.col("px"))).alias("_hi"), F.min(F.when(early, F.col("px"))).alias("_lo"),
        F.avg("_up").alias("_uf"), F.max("px").alias("_peak"),
        *[minute(i).alias(f"_c{i}") for i in range(5)],
    )
    counts = [F.col(f"_c{i}") for i in range(5)]
    some = F.greatest(*counts) > 0
    ep = F.col("entry_price")
    return g.select(
        "entry_id", "ticker", "entry_ms", "entry_price", "n_trades_first_5min", "n_fwd_trades",
        F.coalesce("_mg", span).alias("max_gap_sec"),
        F.coalesce("_dg", span).alias("median_gap_sec"),
        F.coalesce(F.col("_sg") / F.greatest("_ag", F.lit(0.001)), F.lit(0.0)).alias("gap_cv"),
        "dollar_vol_5min",
        ((F.col("_c0") >= 3) & (F.col("_c1") >= 3) & (F.col("_c2") >= 3)).alias("sustained_activity"),
        F.coalesce(F.col("_bp") - ep, F.lit(0.0)).alias("big_trade_delta"),
        F.when(F.col("n_trades_first_5min") >= 2, (F.col("_hi") - F.col("_lo")) / ep * 100).otherwise(0.0).alias("price_range_5min_pct"),
        F.coalesce("_uf", F.lit(0.0)).alias("uptick_frac"),
        F.when(some, (counts[3] - counts[1] + 2 * (counts[4] - counts[0])) / 10.0).otherwise(0.0).alias("accel_slope"),
        F.when(some, (counts[4] + counts[3]) / F.greatest(counts[0] + counts[1], F.lit(1)).cast("double")).otherwise(0.0).alias("last2_first2_ratio"),
        ((F.col("_peak") - ep) / ep * 100).alias("entry_to_peak_pct"),
    )


def window_stats(anchors: DataFrame, trades: DataFrame, key: str = "entry_id", anchor: str = "anchor_ms", before_ms: int = 0, after_ms: int = 300_000) -> DataFrame:
    """Trade count, dollar volume, largest gap, range and big-trade delta in (anchor - before, anchor + after]."""
    t = trades.select("ticker", "ts_ms", "seq", F.col("price").alias("px"), F.col("size").alias("sz"))
    a = anchors.select(key, "ticker", anchor)
    j = interval_join(a, t, ["ticker"], F.col(anchor) - before_ms, F.col(anchor) + after_ms, "ts_ms", how="inner")
    w = Window.partitionBy(key).orderBy("ts_ms", "seq")
    whole = Window.partitionBy(key)
    j = j.withColumn("_gap", (F.col("ts_ms") - F.lag("ts_ms").over(w)) / 1000.0).withColumn("_avg", F.avg("sz").over(whole)).withColumn("_p0", F.first("px").over(w))
    j = j.withColumn("_any", F.max(F.col("sz") > F.col("_avg")).over(whole))
    delta = (F.col("px") - F.col("_p0")) / F.col("_p0") * 100
    g = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(F.col("px") * F.col("sz")).alias("dollar_vol"),
        F.coalesce(F.max("_gap"), F.lit(0.0)).alias("max_gap_sec"),
        ((F.max("px") - F.min("px")) / F.min("px") * 100).alias("price_range_pct"),
        F.percentile(F.when((F.col("sz") > F.col("_avg")) | ~F.col("_any"), delta), 0.5).alias("big_trade_delta"),
    )
    names = ("trade_count", "dollar_vol", "max_gap_sec", "price_range_pct", "big_trade_delta")
    zero = {n: F.coalesce(F.col(n), F.lit(0 if n == "trade_count" else 0.0)).alias(n) for n in names}
    return anchors.select(key).join(g, key, "left").select(key, *zero.values())


def factor_snapshot(factors: DataFrame, points: DataFrame, names: list[str], ts: str, step_ms: int = 1_000, lookback: int = 120, prefix: str = "") -> DataFrame:
    """Each factor's last non-null value within `lookback` grid steps of the grid row at or before the time."""
    span = lookback * step_ms
    f = factors.select("ticker", "ts_ms", *names)
    exprs = {f"_s_{n}": (lambda w, n=n: F.last(n, ignorenulls=True).over(w.rangeBetween(-span, 0))) for n in names}
    filled = range_windows(f, ["ticker"], "ts_ms", exprs, span).select("ticker", F.col("ts_ms").alias("_ft"), *[F.col(f"_s_{n}").alias(f"{prefix}{n}") for n in names])
    return asof_join(points, filled, ["ticker"], ts, "_ft", [f"{prefix}{n}" for n in names]).drop("_ft")


def two_anchor(entries: DataFrame, hits: DataFrame, trades: DataFrame, timeout_ms: int = 1_800_000, minute_ms: int = MINUTE) -> DataFrame:
    """Accept every entry, wait for ignition (spread collapse first, else volume expansion), else exit as a zombie.

    An ignited entry is held from the ignition price to the last trade of its session; a zombie leaves at
    the last trade before the timeout.
    """
    order = F.when(F.col("method") == "spread_collapse", 0).when(F.col("method") == "vol_exp", 1)
    in_time = hits.join(entries.select("entry_id", "entry_ms"), "entry_id").filter(order.isNotNull() & (F.col("ms") <= F.col("entry_ms") + timeout_ms))
    ig = in_time.groupBy("entry_id").agg(F.min(F.struct(order.alias("o"), "method", "ms", "price")).alias("_g")).select(
        "entry_id", F.col("_g.method").alias("ignition_method"), F.col("_g.ms").alias("ignition_ms"), F.col("_g.price").alias("ignition_price")
    )
    # Three spans of each entry: its session, what follows the ignition, and what comes before the deadline.
    e = entries.select("entry_id", "ticker", "entry_ms", "session_end_ms")
    whole = span_stats(e, trades).select("entry_id", F.col("hi").alias("_peak"))
    lit = e.join(ig, "entry_id").withColumn("entry_ms", F.greatest("entry_ms", "ignition_ms"))
    after = span_stats(lit, trades).select("entry_id", F.col("last_px").alias("_ig_last"), F.col("hi").alias("_ig_peak"))
    early = e.withColumn("session_end_ms", F.least("session_end_ms", F.col("entry_ms") + timeout_ms))
    zombie = span_stats(early, trades).select("entry_id", F.col("last_px").alias("_z"))
    five = window_stats(ig.join(entries.select("entry_id", "ticker"), "entry_id").withColumnRenamed("ignition_ms", "anchor_ms"), trades, after_ms=5 * minute_ms)
    five = five.select("entry_id", F.col("trade_count").alias("ig_trades_5min"), F.col("dollar_vol").alias("ig_dollar_vol_5min"))
    out = entries.join(ig, "entry_id", "left")
    for part in (whole, after, zombie, five):
        out = out.join(part, "entry_id", "left")
    ep, ip = F.col("entry_price"), F.col("ignition_price")
    lit = F.col("ignition_ms").isNotNull()
    zombie_px = F.coalesce("_z", ep)
    peak = F.coalesce((F.col("_peak") - ep) / ep * 100, F.lit(0.0))
    return out.select(
        "entry_id", "ticker", "entry_ms", lit.alias("ignited"), "ignition_method", "ignition_ms",
        peak.alias("entry_to_peak_pct"), (peak >= 50).alias("is_momo"),
        F.when(lit, F.coalesce(ratio(F.col("_ig_last") - ip, ip) * 100, F.lit(0.0))).otherwise((zombie_px - ep) / ep * 100).alias("final_pnl_pct"),
        F.when(lit, F.concat(F.lit("ignited_"), "ignition_method")).otherwise("zombie_timeout").alias("exit_reason"),
        F.when(lit, F.coalesce(ratio(F.col("_ig_peak") - ip, ip) * 100, F.lit(0.0))).otherwise(0.0).alias("ignition_to_peak_pct"),
        F.coalesce("ig_trades_5min", F.lit(0)).alias("ig_trades_5min"),
        F.coalesce("ig_dollar_vol_5min", F.lit(0.0)).alias("ig_dollar_vol_5min"),
    )
