"""Trade and quote factors over time windows.

A compute grid is evaluated against the ticks in [t - window, t]. Ticks are first summed into grid
cells; cells and grid points are unioned and windowed per (ticker, time bucket) with a halo. A hot
ticker is spread over its time buckets, a hot second is one row, and no pair of rows is ever joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tapewright.functions.folds import thin_by_interval
from tapewright.functions.numeric import floor_div, floor_to, ratio
from tapewright.functions.rangecount import count_above
from tapewright.functions.timewin import asof_join, default_bucket, range_windows, sliding, with_halo
from tapewright.operators.ticks import spread_bps, valid_quote


def compute_grid(ticks: DataFrame, step_ms: int = 1_000) -> DataFrame:
    """(ticker, ts_ms) at every aligned step after the first tick up to the last one."""
    span = ticks.groupBy("ticker").agg(F.min("ts_ms").alias("_a"), F.max("ts_ms").alias("_b"))
    step = F.lit(step_ms).cast("long")
    first = floor_to("_a", step_ms) + step
    return span.filter(first <= F.col("_b")).select("ticker", F.explode(F.sequence(first, F.col("_b"), step)).alias("ts_ms"))


def _back(w: WindowSpec, window_ms: int) -> WindowSpec:
    return w.rangeBetween(-window_ms, 0)


def tick_side(trades: DataFrame, sticky: bool = False, bucket_ms: int = 3_600_000) -> DataFrame:
    """Tick test: 1 on an uptick, 0 on a downtick. Flat prices count as buys, or repeat the last side if `sticky`.

    The previous price comes from an as-of style carry, so no ticker is windowed as a whole.
    """
    b = trades.withColumn("_b", floor_div("ts_ms", bucket_ms))
    last = b.groupBy("ticker", "_b").agg(F.max_by("price", F.struct("ts_ms", "seq")).alias("_lp"))
    wk = Window.partitionBy("ticker").orderBy("_b")
    b = b.join(last.select("ticker", "_b", F.lag("_lp").over(wk).alias("_in")), ["ticker", "_b"])
    w = Window.partitionBy("ticker", "_b").orderBy("ts_ms", "seq")
    b = b.withColumn("_prev", F.coalesce(F.lag("price").over(w), F.col("_in")))
    if not sticky:
        return b.withColumn("is_buy", F.when(F.col("price") < F.col("_prev"), 0).otherwise(1)).drop("_b", "_in", "_prev", "_lp")
    b = b.withColumn("_chg", F.when(F.col("price") > F.col("_prev"), 1).when(F.col("price") < F.col("_prev"), 0))
    ends = b.groupBy("ticker", "_b").agg(F.max_by("_chg", F.when(F.col("_chg").isNotNull(), F.struct("ts_ms", "seq"))).alias("_lc"))
    ends = ends.select("ticker", "_b", F.last("_lc", ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("_cin"))
    b = b.join(ends, ["ticker", "_b"])
    side = F.coalesce(F.last("_chg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_cin"), F.lit(1))
    return b.withColumn("is_buy", side).drop("_b", "_in", "_prev", "_chg", "_cin", "_lp")


def _cells(ticks: DataFrame, step_ms: int, sums: dict[str, Column]) -> DataFrame:
    """Ticks summed into grid cells (t - step, t], with the part lying exactly on t kept apart as edge_<name>.

    A hash aggregation with map-side combining: however many ticks a second has, one row per ticker and
    cell goes on. The edge sums let a window closed on both sides be put together from whole cells.
    """
    step = F.lit(step_ms).cast("long")
    cell = F.col("ts_ms") + F.pmod(-F.col("ts_ms"), step)
    on_edge = F.col("ts_ms") == F.col("_cell")
    t = ticks.withColumn("_cell", cell)
    aggs = []
    for n, c in sums.items():
        aggs += [F.sum(c).alias(n), F.sum(F.when(on_edge, c)).alias(f"edge_{n}")]
    return t.groupBy("ticker", F.col("_cell").alias("ts_ms")).agg(*aggs)


def _window_sum(name: str, window_ms: int, step_ms: int):
    """Sum over the ticks in [t - window, t]: the cells after t - window, and that cell's edge."""

    def make(w: WindowSpec) -> Column:
        inner = F.sum(name).over(w.rangeBetween(-window_ms + step_ms, 0))
        edge = F.sum(f"edge_{name}").over(w.rangeBetween(-window_ms, -window_ms))
        return F.coalesce(inner, F.lit(0)) + F.coalesce(edge, F.lit(0))

    return make


def _check_step(step_ms: int, *windows: int) -> None:
    if any(x % step_ms for x in windows):
        raise ValueError(f"windows {windows} must be multiples of the grid step {step_ms}")


def _grid_union(cells: DataFrame, grid: DataFrame) -> DataFrame:
    return cells.withColumn("_cellrow", F.lit(True)).unionByName(grid.select("ticker", "ts_ms"), allowMissingColumns=True)


def trade_factors(
    trades: DataFrame,
    grid: DataFrame,
    window_ms: int = 20_000,
    min_trades: int = 5,
    large_multiplier: float = 2.0,
    names: tuple[str, ...] = ("trade_rate", "large_trade_ratio", "aggressor_ratio"),
    step_ms: int = 1_000,
) -> DataFrame:
    """trade_rate, large_trade_ratio and aggressor_ratio at each grid point; null below `min_trades`.

    Grid points are multiples of `step_ms`, and so is the window. Frames run over cells (one row per
    ticker and step), so their cost does not depend on the tick density.
    """
    _check_step(step_ms, window_ms)
    src = tick_side(trades) if "aggressor_ratio" in names else trades
    sums = {"_n": F.lit(1).cast("long")}
    if "large_trade_ratio" in names:
        sums["_volume"] = F.col("size").cast("long")
    if "aggressor_ratio" in names:
        sums["_buys"] = F.col("is_buy").cast("long")
    exprs = {f"{k}_w": _window_sum(k, window_ms, step_ms) for k in sums}
    cells = _cells(src, step_ms, sums)
    if "large_trade_ratio" in names:
        # Sizes repeat, so a cell has a row for each distinct size, with its count and that on the cell's end.
        step = F.lit(step_ms).cast("long")
        by_size = trades.groupBy("ticker", (F.col("ts_ms") + F.pmod(-F.col("ts_ms"), step)).alias("_c"), "size").agg(
            F.count(F.lit(1)).alias("_k"), F.count(F.when(F.pmod(F.col("ts_ms"), step) == 0, 1)).alias("_e")
        )
    out = range_windows(_grid_union(cells, grid), ["ticker"], "ts_ms", exprs, window_ms, keep=F.col("_cellrow").isNull())
    n = F.col("_n_w")
    ready = n >= min_trades
    cols: dict[str, Column] = {}
    if "trade_rate" in names:
        cols["trade_rate"] = F.when(ready, n / (window_ms / 1000.0))
    if "large_trade_ratio" in names:
        # A point meets the sizes of its window's cells; of the cell just before the window only the end counts.
        limits = out.filter(ready).select("ticker", "ts_ms", (F.col("_volume_w") / n * large_multiplier).alias("_limit"))
        reach = limits.withColumn("_c", F.explode(F.sequence(F.col("ts_ms") - window_ms, F.col("ts_ms"), F.lit(step_ms).cast("long"))))
        counted = F.when(F.col("_c") == F.col("ts_ms") - window_ms, F.col("_e")).otherwise(F.col("_k"))
        larger = reach.join(by_size, ["ticker", "_c"]).filter(F.col("size") > F.col("_limit")).groupBy("ticker", "ts_ms").agg(F.sum(counted).alias("_large"))
        out = out.join(larger, ["ticker", "ts_ms"], "left")
        cols["large_trade_ratio"] = F.when(ready, F.coalesce("_large", F.lit(0)) / n)
    if "aggressor_ratio" in names:
        cols["aggressor_ratio"] = F.when(ready, F.col("_buys_w") / n)
    return out.select("ticker", "ts_ms", *[c.alias(k) for k, c in cols.items()])


def quote_factors(
    quotes: DataFrame,
    grid: DataFrame,
    spread_ms: int = 5_000,
    imbalance_ms: int = 5_000,
    rate_ms: int = 10_000,
    min_quotes: int = 10,
    names: tuple[str, ...] = ("bid_ask_spread", "order_imbalance", "quote_rate"),
    step_ms: int = 1_000,
) -> DataFrame:
    """Window mean of the spread in basis points, size imbalance in [-1, 1], and quotes per second, on a grid."""
    spans = {"bid_ask_spread": spread_ms, "order_imbalance": imbalance_ms, "quote_rate": rate_ms}
    _check_step(step_ms, *[spans[n] for n in names])
    bps = F.when(valid_quote(), spread_bps())
    needed = {
        "bid_ask_spread": {"_bps": bps, "_nbps": F.when(bps.isNotNull(), 1).otherwise(0).cast("long")},
        "order_imbalance": {"_bid": F.col("bid_size"), "_ask": F.col("ask_size")},
        "quote_rate": {"_n": F.lit(1).cast("long")},
    }
    sums, exprs = {}, {}
    for f in names:
        for k, c in needed[f].items():
            sums[k] = c
            exprs[f"{k}_w"] = _window_sum(k, spans[f], step_ms)
    rows = _grid_union(_cells(quotes, step_ms, sums), grid)
    out = range_windows(rows, ["ticker"], "ts_ms", exprs, max(spans[n] for n in names), keep=F.col("_cellrow").isNull())
    makers = {
        "bid_ask_spread": lambda: ratio("_bps_w", "_nbps_w"),
        "order_imbalance": lambda: ratio(F.col("_bid_w") - F.col("_ask_w"), F.col("_bid_w") + F.col("_ask_w")),
        "quote_rate": lambda: F.when(F.col("_n_w") >= min_quotes, F.col("_n_w") / (rate_ms / 1000.0)),
    }
    return out.select("ticker", "ts_ms", *[makers[n]().alias(n) for n in names])


def arrival_quote_factors(
    quotes: DataFrame,
    every_ms: int = 1_000,
    spread_ms: int = 5_000,
    imbalance_ms: int = 5_000,
    rate_ms: int = 10_000,
    min_quotes: int = 10,
    names: tuple[str, ...] = ("bid_ask_spread", "order_imbalance", "quote_rate"),
) -> DataFrame:
    """(ticker, ts_ms, seq, factor, value): each factor on the arrival of a quote, at least `every_ms` after its last value.

    The spread is thrown by valid quotes and is their mean in basis points over [t - window, t]; the size imbalance (0 without
    sizes) and the rate (null below `min_quotes`) are thrown by all quotes. Quotes of one millisecond count together.
    """
    spans = {"bid_ask_spread": spread_ms, "order_imbalance": imbalance_ms, "quote_rate": rate_ms}
    bps = F.when(valid_quote(), spread_bps())
    total = F.col("_bid_w") + F.col("_ask_w")
    sums = {
        "bid_ask_spread": {"_bps_w": ("avg", F.col("_bps"))},
        "order_imbalance": {f"_{s}_w": ("sum", F.col(f"{s}_size")) for s in ("bid", "ask")},
        "quote_rate": {"_n_w": ("count", F.lit(1))},
    }
    values = {
        "bid_ask_spread": lambda: F.col("_bps_w"),
        "order_imbalance": lambda: F.coalesce(ratio(F.col("_bid_w") - F.col("_ask_w"), total), F.lit(0.0)),
        "quote_rate": lambda: F.when(F.col("_n_w") >= min_quotes, F.col("_n_w") / (rate_ms / 1000.0)),
    }
    rows = quotes.select("ticker", "ts_ms", "seq", "bid_size", "ask_size", bps.alias("_bps"))
    rolled = rows
    for n in names:
        rolled = sliding(rolled, ["ticker"], "ts_ms", sums[n], -spans[n])
    out = None
    # Spreads keep a beat of their own, since an invalid quote throws none; the other factors share one.
    for part, fit in ((["bid_ask_spread"], F.col("_bps").isNotNull()), (["order_imbalance", "quote_rate"], F.lit(True))):
        part = [n for n in part if n in names]
        if part:
            named = F.array(*[F.struct(F.lit(n).alias("factor"), values[n]().alias("value")) for n in part])
            beat = thin_by_interval(rolled.filter(fit).select("ticker", "ts_ms", "seq", named.alias("_f")), ["ticker"], "ts_ms", every_ms, ["seq"])
            beat = beat.select("ticker", "ts_ms", "seq", F.inline("_f"))
            out = beat if out is None else out.unionByName(beat)
    return out


def rolling_at_ticks(
    ticks: DataFrame, exprs: dict, window_ms: int, keep_cols: list[str] | None = None
) -> DataFrame:
    """Window aggregates evaluated at the ticks themselves over [t - window, t]."""
    out = range_windows(ticks, ["ticker"], "ts_ms", {n: (lambda w, f=f: f(_back(w, window_ms))) for n, f in exprs.items()}, window_ms)
    return out.select(*(keep_cols or ticks.columns), *exprs) if keep_cols else out


def z_score(values: DataFrame, value: str, history: int, keys: tuple[str, ...] = ("ticker",), order: str = "bar_start") -> DataFrame:
    """z against the previous `history` rows: population deviation, 0 if it vanishes, null below two rows."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-history, -1)
    n, mean, sd = F.count(value).over(frame), F.avg(value).over(frame), F.stddev_pop(value).over(frame)
    return values.withColumn("z", F.when(n < 2, None).when(sd < 1e-9, 0.0).otherwise(ratio(F.col(value) - mean, sd)))


def price_acceleration(trades: DataFrame, half_ms: int) -> DataFrame:
    """Return per second over (t - half, t] minus the same over (t - 2 half, t - half], at every trade.

    Only the first and last trade of each half matter. They are as-of lookups at t, t - half and
    t - 2 half, so the cost does not grow with the number of trades in a window.
    """
    px = trades.select("ticker", F.col("ts_ms").alias("_pt"), F.col("seq").alias("_ps"), F.col("price").alias("_px"))

    def at(offsets: tuple[int, int], direction: str, tag: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).cast("long").alias("off")) for i, o in enumerate(offsets)])
        p = trades.select("ticker", "seq", "ts_ms", F.explode(pairs).alias("_o")).withColumn("_at", F.col("ts_ms") - F.col("_o.off"))
        j = asof_join(p, px, ["ticker"], "_at", "_pt", ["_px"], "_ps", direction, strict=direction == "forward")
        return j.select("ticker", "seq", "ts_ms", F.concat(F.lit(tag), F.col("_o.i").cast("string")).alias("_k"), "_pt", "_px")

    # last0/first0 bound the recent half, last1/first1 the older one.
    rows = at((0, half_ms), "backward", "last").unionByName(at((half_ms, 2 * half_ms), "forward", "first"))
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{k}{c}")
    g = rows.groupBy("ticker", "seq", "ts_ms").agg(*[pick(k, c) for k in ("first0", "last0", "first1", "last1") for c in ("_pt", "_px")])

    def rate(i: int) -> Column:
        t0, t1, p0, p1 = F.col(f"first{i}_pt"), F.col(f"last{i}_pt"), F.col(f"first{i}_px"), F.col(f"last{i}_px")
        secs = (t1 - t0) / 1000.0
        # Both ends lie in the half exactly when the first one is not after the last one.
        return F.when((secs > 0) & (p0 > 0), (p1 / p0 - 1) / F.when(secs > 0, secs)).otherwise(0.0)

    return g.select("ticker", "seq", "ts_ms", (rate(0) - rate(1)).alias("price_accel"))


def signal_density(factors: DataFrame, value: str, threshold: float, window_ms: int) -> DataFrame:
    """How often `value` exceeded the threshold in (t - window, t]."""
    hit = F.when(F.col(value) > threshold, 1).otherwise(0)
    return sliding(factors, ["ticker"], "ts_ms", {"signal_density": ("sum", hit)}, -window_ms + 1)


def labeling_factors(trades: DataFrame, window_ms: int = 30_000, min_trades: int = 5, points: DataFrame | None = None, bucket_ms: int | None = None) -> DataFrame:
    """Trade rate over the effective span, large-trade and sticky-side aggressor shares at every trade.

    `points` (ticker, ts_ms, seq) are the trades to label, all by default; a chart passes those of
    `decimate`. Of equal times a point sees the trades up to its own sequence number. A (ticker, time bucket) with the
    window before it is ordered once; counts, volumes and buys are differences of running sums, and the trades larger than twice the window's
    mean size are counted for all points together (`count_above`), so no trade meets the trades of its window.
    """
    t = tick_side(trades, sticky=True).select("ticker", "ts_ms", "seq", "size", F.col("is_buy").cast("int").alias("is_buy"))
    if points is None:
        t = t.withColumn("_point", F.lit(True))
    else:
        marks = points.select("ticker", "ts_ms", "seq").distinct().withColumn("_point", F.lit(True))
        t = t.join(marks, ["ticker", "ts_ms", "seq"], "left").withColumn("_point", F.coalesce("_point", F.lit(False)))
    halo = with_halo(t, "ts_ms", bucket_ms or default_bucket(window_ms), window_ms).withColumn("_point", F.col("_point") & F.col("_tw_own"))

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts_ms", "seq"], kind="stable", ignore_index=True)
        ts, size = rows["ts_ms"].to_numpy(np.int64), rows["size"].to_numpy(np.int64)
        at = np.flatnonzero(rows["_point"].to_numpy(bool))
        start, end = np.searchsorted(ts, ts[at] - window_ms), at + 1
        total = lambda x: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(x)]))
        n, span = end - start, ts[at] - ts[start]
        large = count_above(size, start, end, total(size) / n * 2.0)
        out = rows.loc[at, ["ticker", "seq", "ts_ms"]]
        return out.assign(_n=n, _buys=total(rows["is_buy"].to_numpy(np.int64)), _large=large, _span=span)

    key = "ticker string, seq long, ts_ms long"
    out = halo.select("ticker", "_tw_bucket", "ts_ms", "seq", "size", "is_buy", "_point").groupBy("ticker", "_tw_bucket").applyInPandas(label, f"{key}, _n long, _buys long, _large long, _span long")
    ok = (F.col("_n") >= min_trades) & (F.col("_span") > 0)
    rate = F.col("_n") / (F.when(F.col("_span") > 0, F.col("_span")) / 1000.0)
    shares = {"trade_rate": rate, "large_trade_ratio": F.col("_large") / F.col("_n"), "aggressor_ratio": F.col("_buys") / F.col("_n")}
    return out.select("ticker", "seq", "ts_ms", *[F.when(ok, F.round(c, 3)).otherwise(0.0).alias(n) for n, c in shares.items()])


def decimate(points: DataFrame, max_points: int, bucket_ms: int = 3_600_000) -> DataFrame:
    """Every n-th point per ticker with n = max(1, points div max_points), numbered through bucket counts."""
    p = points.withColumn("_b", floor_div("ts_ms", bucket_ms))
    counts = p.groupBy("ticker", "_b").agg(F.count(F.lit(1)).alias("_c"))
    wk = Window.partitionBy("ticker").orderBy("_b")
    base = counts.select(
        "ticker",
        "_b",
        F.coalesce(F.sum("_c").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_c").over(Window.partitionBy("ticker")).alias("_total"),
    )
    w = Window.partitionBy("ticker", "_b").orderBy("ts_ms", "seq")
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_total") / max_points))
    return (
        p.join(base, ["ticker", "_b"])
        .withColumn("_i", F.col("_base") + F.row_number().over(w) - 1)
        .filter(F.col("_i") % step == 0)
        .drop("_b", "_base", "_total", "_i")
    )


def forward_fill_wide(factors: DataFrame, names: list[str], order: str = "ts_ms", bucket_ms: int = 3_600_000) -> DataFrame:
    """Carry each factor's last value per ticker; bucket summaries keep a hot ticker spread."""
    b = factors.withColumn("_b", floor_div(order, bucket_ms))
    last = b.groupBy("ticker", "_b").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(f"_l_{n}") for n in names]
    )
    wk = Window.partitionBy("ticker").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("ticker", "_b", *[F.last(f"_l_{n}", ignorenulls=True).over(wk).alias(f"_i_{n}") for n in names])
    w = Window.partitionBy("ticker", "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    others = [c for c in factors.columns if c not in names]
    return b.join(carry, ["ticker", "_b"]).select(
        *others, *[F.coalesce(F.last(n, ignorenulls=True).over(w), F.col(f"_i_{n}")).alias(n) for n in names]
    )


def to_long(factors: DataFrame, names: list[str], ids: tuple[str, ...] = ("ticker", "ts_ms")) -> DataFrame:
    return factors.unpivot(list(ids), names, "factor", "value").filter(F.col("value").isNotNull())


def to_wide(long: DataFrame, names: list[str], ids: tuple[str, ...] = ("ticker", "ts_ms")) -> DataFrame:
    """Pivot with the factor list given, so no extra job looks for distinct names."""
    return long.groupBy(*ids).pivot("factor", names).agg(F.first("value"))


def merge_factor_sets(sets: list[tuple[DataFrame, list[str]]], ids: tuple[str, ...] = ("ticker", "ts_ms")) -> DataFrame:
    """Union factor tables of different cadence into one row per timestamp, then forward-fill every factor."""
    names = [n for _, ns in sets for n in ns]
    rows = None
    for df, ns in sets:
        part = df.select(*ids, *ns)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    one = rows.groupBy(*ids).agg(*[F.max(n).alias(n) for n in names])
    return forward_fill_wide(one, names, ids[1])


def sample_timeline(factors: DataFrame, names: list[str], interval_ms: int) -> DataFrame:
    """Last value of each factor per interval."""
    return factors.groupBy("ticker", floor_to("ts_ms", interval_ms).alias("slot_ms")).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("ts_ms"))).alias(n) for n in names]
    )


def onto_bar_grid(points: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """Last point at or before each grid time; before the first point, that first point's value."""
    first = points.groupBy("ticker").agg(F.min_by(value, F.struct("ts_ms", value)).alias("_f"))
    j = asof_join(grid, points, ["ticker"], "ts_ms", "ts_ms", [value], prefix="p_")
    return j.join(first, "ticker", "left").select(
        *grid.columns, F.coalesce(F.col(f"p_{value}"), F.col("_f"), F.lit(0.0)).alias(value)
    )
