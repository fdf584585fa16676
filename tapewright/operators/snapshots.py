"""Market snapshots: windowed cross-sections, ranks, carry-forward and top-N membership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions import session as S
from tapewright.functions.numeric import floor_to, ratio
from tapewright.operators.ticks import order_key, weighted_mid

# Fixed value: how many tickers of a cross-section count as its top.
TOP_N = 20


def previous_day(daily: DataFrame, max_days: int = 7) -> DataFrame:
    """Per date: the newest earlier date with data, at most `max_days` back. One row per date."""
    days = daily.select("date").distinct()
    # The distinct dates are a calendar, so this unpartitioned order is over a few thousand rows.
    prev = F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    return days.select("date", prev.alias("prev_date")).filter(F.datediff("date", "prev_date") <= max_days)


def previous_close(daily: DataFrame, max_days: int = 7) -> DataFrame:
    """(date, ticker, prev_close, prev_volume) from the newest earlier day file."""
    pairs = previous_day(daily, max_days)
    d = daily.select(F.col("date").alias("prev_date"), "ticker", F.col("close").alias("prev_close"), F.col("volume").alias("prev_volume"))
    return pairs.join(d, "prev_date").select("date", "ticker", "prev_close", "prev_volume")


def split_adjusted_close(prev: DataFrame, splits: DataFrame) -> DataFrame:
    """Scale prev_close by split_from/split_to when a split executes on the date."""
    s = splits.groupBy(F.col("execution_date").alias("date"), "ticker").agg(F.product(F.col("split_from") / F.col("split_to")).alias("_f"))
    return prev.join(s, ["date", "ticker"], "left").withColumn("prev_close", F.col("prev_close") * F.coalesce("_f", F.lit(1.0))).drop("_f")


def trade_windows(trades: DataFrame, prev: DataFrame, window_ms: int = 5_000) -> DataFrame:
    """Last price, volume and turnover per (date, ticker, window), with the change against prev_close.

    The trades are reduced first and only the windows meet the previous closes.
    """
    t = trades.withColumn("date", S.et_date(S.to_et_ms("ts_ms"))).withColumn("window_ms", floor_to("ts_ms", window_ms))
    agg = t.groupBy("date", "ticker", "window_ms").agg(
        F.max_by("price", order_key()).alias("price"),
        F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("turnover"),
    )
    j = agg.join(prev, ["date", "ticker"], "left")
    return j.withColumn("change_pct", ratio(F.col("price") - F.col("prev_close"), "prev_close") * 100)


def quote_windows(quotes: DataFrame, window_ms: int = 5_000) -> DataFrame:
    """Last bid, ask and sizes per (ticker, window)."""
    k = order_key()
    cols = ("bid", "ask", "bid_size", "ask_size")
    return quotes.groupBy("ticker", floor_to("ts_ms", window_ms).alias("window_ms")).agg(*[F.max_by(c, k).alias(c) for c in cols])


def collector(trades_agg: DataFrame, quotes_agg: DataFrame | None = None, unique_quotes: bool = False) -> DataFrame:
    """Joined cross-section with cumulative volume and session VWAP per (date, ticker).

    `unique_quotes` says that `quotes_agg` has at most one row per (ticker, window), as `quote_windows` returns. The
    quotes then repeat no trade row, so the running sums come first, while the rows still lie by (date, ticker).
    """
    cols = ("bid", "ask", "bid_size", "ask_size")
    w = Window.partitionBy("date", "ticker").orderBy("window_ms").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_cv": F.sum("volume").over(w), "_ct": F.sum("turnover").over(w)}
    j = trades_agg.withColumns(sums) if unique_quotes else trades_agg
    if quotes_agg is not None:
        j = j.join(quotes_agg, ["ticker", "window_ms"], "left")
        j = j.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    else:
        j = j.withColumns({c: F.lit(0.0) for c in cols})
    j = j if unique_quotes else j.withColumns(sums)
    return j.select(
        "date", "ticker", "window_ms", "price", F.col("_cv").alias("volume"), "prev_close",
        F.coalesce(F.col("prev_volume").cast("double"), F.lit(0.0)).alias("prev_volume"),
        ratio("_ct", "_cv", otherwise=0.0).alias("vwap"), *cols, "change_pct",
    )


def rank_cross_section(snap: DataFrame, name: str = "rank") -> DataFrame:
    """Ordinal rank by change within each window, ties by ticker."""
    w = Window.partitionBy("date", "window_ms").orderBy(F.desc_nulls_last("change_pct"), "ticker")
    return snap.withColumn(name, F.row_number().over(w))


def carry_forward(snap: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Keep every ticker in all later windows of its date with its last row.

    A row stands for the windows up to the ticker's next row, so it is repeated by an explode over the
    window numbers: nothing is joined pairwise and nothing is searched for. The windows of a date are a
    calendar that is broadcast, so rows are dealt out by ticker once, and not again when they are repeated.
    `wanted` (date, window_ms) names the windows whose rows are returned; all of them if it is not given.
    """
    windows = snap.select("date", "window_ms").distinct()
    if wanted is None:
        windows = windows.withColumn("_at", F.col("window_ms"))
    else:
        w = wanted.select("date", "window_ms").distinct().withColumn("_at", F.col("window_ms"))
        windows = windows.join(w, ["date", "window_ms"], "left")
    w = Window.partitionBy("date").orderBy("window_ms")
    numbered = windows.select(
        "date", "window_ms", F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy("date")).alias("_n"), "_at"
    )
    # The number-th entry is the window of that number, null if it is not wanted.
    at = numbered.groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_at"))), lambda x: x["_at"]).alias("_ats"))
    rows = snap.join(F.broadcast(numbered.drop("_at")), ["date", "window_ms"])
    nxt = F.lead("_i").over(Window.partitionBy("date", "ticker").orderBy("window_ms"))
    rows = rows.withColumn("_until", F.coalesce(nxt - 1, F.col("_n"))).join(F.broadcast(at), "date")
    # A slice is cut without a call per window. Of rows of one window all but the last end at the window before, and stand for both.
    start = F.greatest(F.least("_i", "_until"), F.lit(1))
    seen = F.slice("_ats", start, F.greatest("_i", "_until") - start + 1)
    rows = rows.withColumn("_w", F.explode(seen)).filter(F.col("_w").isNotNull())
    return (
        rows.withColumn("carried", F.col("window_ms") != F.col("_w"))
        .withColumn("seen_ms", F.col("window_ms"))
        .withColumn("window_ms", F.col("_w"))
        .drop("_i", "_n", "_until", "_w", "_ats")
    )


def top_entries(filled: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Rows in the top N of a window whose best change is positive."""
    return top_ranked(rank_cross_section(filled, "rank"), top_n)


def top_ranked(ranked: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """`top_entries` of rows that `rank_cross_section` has ranked."""
    ranked = ranked.filter(F.col("rank") <= top_n)
    # The best change of a window is that of its first rank, which is always among the rows kept.
    w = Window.partitionBy("date", "window_ms")
    return ranked.withColumn("_best", F.max("change_pct").over(w)).filter(F.col("_best") > 0).drop("_best")


def subscriptions(filled: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Tickers that ever entered the top N, with the values of their first entry."""
    e = top_entries(filled, top_n)
    first = e.groupBy("date", "ticker").agg(
        F.min("window_ms").alias("first_entry_ms"),
        *[F.min_by(c, "window_ms").alias(n) for c, n in (("change_pct", "gain_at_entry"), ("price", "price_at_entry"), ("volume", "volume_at_entry"))],
        F.min_by("prev_volume", "window_ms").alias("_pv"),
    )
    rel = F.when(F.col("_pv") > 0, F.col("volume_at_entry") / F.when(F.col("_pv") > 0, F.col("_pv"))).otherwise(1.0)
    return first.withColumn("relative_volume", rel).drop("_pv")


def candidate_peaks(snap: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Maximum gain and peak volume of each subscribed ticker over its positive rows."""
    rows = snap.join(subscribed.select("date", "ticker"), ["date", "ticker"], "left_semi").filter(F.col("change_pct") > 0)
    return rows.groupBy("date", "ticker").agg(
        F.max("change_pct").alias("max_gain"), F.max("volume").alias("peak_volume"), F.min_by("prev_close", "window_ms").alias("prev_close")
    )


def initial_top(snap: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Tickers in the top N of the first window of a date."""
    first = snap.groupBy("date").agg(F.min("window_ms").alias("window_ms"))
    return rank_cross_section(snap.join(first, ["date", "window_ms"], "left_semi")).filter(F.col("rank") <= top_n).select("date", "ticker")


@dataclass(frozen=True)
class CandidateFilter:
    """Entry filters; a zero (or infinite) bound is off."""

    min_gain_pct: float = 0.0
    min_price: float = 0.0
    max_price: float = float("inf")
    min_volume: float = 0.0
    min_relative_volume: float = 0.0
    new_entry_only: bool = True

    def predicate(self) -> Column:
        p = F.lit(True)
        if self.min_gain_pct > 0:
            p = p & (F.col("gain_at_entry") >= self.min_gain_pct)
        if self.min_price > 0:
            p = p & (F.col("price_at_entry") >= self.min_price)
        if self.max_price < float("inf"):
            p = p & (F.col("price_at_entry") <= self.max_price)
        if self.min_volume > 0:
            p = p & (F.col("volume_at_entry") >= self.min_volume)
        if self.min_relative_volume > 0:
            p = p & (F.col("relative_volume") >= self.min_relative_volume)
        return p


def find_candidates(snap: DataFrame, config: CandidateFilter = CandidateFilter(), top_n: int = TOP_N) -> DataFrame:
    """Subscribed tickers with peaks, after the entry filters."""
    sub = subscriptions(carry_forward(snap), top_n)
    out = sub.join(candidate_peaks(snap, sub), ["date", "ticker"], "left")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("max_gain", "peak_volume", "prev_close")})
    if config.new_entry_only:
        out = out.join(initial_top(snap, top_n), ["date", "ticker"], "left_anti")
    return out.filter(config.predicate())


def relative_volume_daily(volume: str = "volume", prev: str = "prev_volume") -> Column:
    return F.when(F.col(prev) > 0, F.col(volume) / F.when(F.col(prev) > 0, F.col(prev))).otherwise(1.0)


def relative_volume_recent(snap: DataFrame, minute_ms: int = 60_000, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """Last minute's volume over the per-minute mean of the last five, from cumulative volume.

    History reaches six minutes back; a shorter history uses its own span (at least one minute), and a
    single row gives 1.0. A (date, ticker) partition holds at most one row per window.
    """
    w = Window.partitionBy(*keys).orderBy("window_ms")
    m = minute_ms
    hist = w.rangeBetween(-6 * m, 0)
    first = F.first("volume").over(hist)
    v1 = F.coalesce(F.last("volume").over(w.rangeBetween(-6 * m, -m)), first)
    v5_raw = F.last("volume").over(w.rangeBetween(-6 * m, -5 * m))
    span = F.when(v5_raw.isNotNull(), 5.0).otherwise(F.greatest((F.col("window_ms") - F.min("window_ms").over(hist)) / m, F.lit(1.0)))
    last1 = F.greatest(F.col("volume") - v1, F.lit(0))
    avg5 = F.greatest(F.col("volume") - F.coalesce(v5_raw, first), F.lit(0)) / span
    ready = (F.count(F.lit(1)).over(hist) >= 2) & (avg5 > 0)
    return snap.withColumn("relative_volume_5min", F.when(ready, last1 / F.when(avg5 > 0, avg5)).otherwise(1.0))


def process_collector(snap: DataFrame, universe: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Ranked, carried-forward rows of the subscribed tickers of a universe, with daily relative volume."""
    filled = carry_forward(snap.join(universe.select("ticker"), "ticker", "left_semi"))
    ranked = rank_cross_section(filled)
    entered = top_entries(filled, top_n).select("date", "ticker").distinct()
    return ranked.join(entered, ["date", "ticker"], "left_semi").withColumn("relative_volume_daily", relative_volume_daily())


def enrich_bulk(snap: DataFrame, minute_ms: int = 60_000) -> DataFrame:
    """Ranks, both relative volumes and the weighted mid for all windows of all dates, without carry-forward."""
    out = relative_volume_recent(rank_cross_section(snap), minute_ms)
    return out.withColumn("relative_volume_daily", relative_volume_daily()).withColumn("weighted_mid", weighted_mid())


def latest_top(ranked: DataFrame, n: int = TOP_N) -> DataFrame:
    """Rank list of each date's newest window."""
    last = ranked.groupBy("date").agg(F.max("window_ms").alias("window_ms"))
    return ranked.join(last, ["date", "window_ms"], "left_semi").filter(F.col("rank") <= n)


def overview_series(ranked: DataFrame, n: int = TOP_N) -> DataFrame:
    """Change history of the tickers in each date's newest top N."""
    return ranked.join(latest_top(ranked, n).select("date", "ticker"), ["date", "ticker"], "left_semi")


def common_stocks(profiles: DataFrame, on_date: str) -> DataFrame:
    """Common stocks and ADRs not delisted by the date."""
    return profiles.filter(
        F.col("type").isin("CS", "ADRC") & (F.col("delisted").isNull() | (F.col("delisted") > F.lit(on_date).cast("date")))
    )


# The canonical numeric snapshot schema.
SNAPSHOT_SCHEMA = {
    "ticker": "string", "window_ms": "bigint", "price": "double", "volume": "double", "prev_close": "double",
    "prev_volume": "double", "vwap": "double", "bid": "double", "ask": "double", "bid_size": "double",
    "ask_size": "double", "change_pct": "double",
}


def enforce_schema(snap: DataFrame, schema: dict[str, str] = SNAPSHOT_SCHEMA) -> DataFrame:
    """Cast known columns to their canonical type; other columns stay."""
    return snap.withColumns({c: F.col(c).cast(t) for c, t in schema.items() if c in snap.columns})


def schema_report(snap: DataFrame, schema: dict[str, str] = SNAPSHOT_SCHEMA) -> DataFrame:
    """One row per canonical column: missing, wrong type, number of nulls. One pass over the data."""
    types = dict(snap.dtypes)
    counts = [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in schema if c in types]
    one = snap.agg(*counts)
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.lit(c not in types).alias("missing"),
            F.lit(c in types and types[c] != t).alias("wrong_type"),
            (F.col(c) if c in types else F.lit(None).cast("long")).alias("nulls"),
        )
        for c, t in schema.items()
    ]
    return one.select(F.inline(F.array(*entries)))


# Bounds of the low-volume exclusion list.
MAX_PAUSE_DAYS = 50
MIN_TURNOVER = 60_000.0


def low_volume_tickers(daily: DataFrame, max_days: int = MAX_PAUSE_DAYS, min_turnover: float = MIN_TURNOVER) -> DataFrame:
    """Tickers that paused longer than `max_days` or turned over less than `min_turnover` a day on average."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("ticker").orderBy("date")))
    g = daily.withColumn("_g", gap).groupBy("ticker").agg(F.max("_g").alias("_g"), F.avg("turnover").alias("_t"))
    return g.filter((F.col("_g") > max_days) | (F.col("_t") < min_turnover)).select("ticker")


def drop_low_volume(daily: DataFrame, max_days: int = MAX_PAUSE_DAYS, min_turnover: float = MIN_TURNOVER) -> DataFrame:
    return daily.join(low_volume_tickers(daily, max_days, min_turnover), "ticker", "left_anti")
