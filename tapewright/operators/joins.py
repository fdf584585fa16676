"""Lookups and joins over market data: as-of prices, intervals, reference data, identities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapewright.functions.components import components
from tapewright.functions import session as S
from tapewright.functions.extremes import window_extremes
from tapewright.functions.numeric import ratio, round_scaled
from tapewright.functions.timewin import UNB, asof_join, sliding

HOUR = 3_600_000


def dimension_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi join to a dimension; the size statistics decide about broadcasting, so no hint is forced."""
    return facts.join(dim, on, how)


def entry_prices(
    signals: DataFrame, trades: DataFrame, ts: str = "entry_ms", fallback_ms: int | None = 120_000, bucket_ms: int = HOUR
) -> DataFrame:
    """entry_price = last trade at or before `ts`, else the first one within `fallback_ms` after it."""
    out = asof_join(signals, trades, ["ticker"], ts, "ts_ms", ["price"], "seq", bucket_ms=bucket_ms, prefix="_b_")
    if fallback_ms is None:
        return out.withColumnRenamed("_b_price", "entry_price").drop("_b_ts_ms")
    out = asof_join(
        out, trades, ["ticker"], ts, "ts_ms", ["price"], "seq", "forward", True, fallback_ms, bucket_ms, prefix="_f_"
    )
    return out.withColumn("entry_price", F.coalesce("_b_price", "_f_price")).drop("_b_price", "_f_price", "_b_ts_ms", "_f_ts_ms")


def first_at_or_after(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, cols: list[str], prefix: str = "r_") -> DataFrame:
    """First right row at or after the time, else the key's last row."""
    out = asof_join(left, right, ["ticker"], left_ts, right_ts, cols, direction="forward", prefix=prefix)
    last = right.groupBy("ticker").agg(*[F.max_by(c, right_ts).alias(f"_l_{c}") for c in [right_ts, *cols]])
    out = out.join(last, "ticker", "left")
    names = list(dict.fromkeys([right_ts, *cols]))
    missing = F.col(prefix + right_ts).isNull()
    return out.select(
        *left.columns, *[F.when(missing, F.col(f"_l_{c}")).otherwise(F.col(prefix + c)).alias(prefix + c) for c in names]
    )


def interval_volume(points: DataFrame, trades: DataFrame, ts: str, hold_ms: int) -> DataFrame:
    """`points` with the number and the volume (0 without any) of their ticker's trades in (ts, ts + hold_ms]; no trade is paired with a point. Points without a time are left out."""
    here = F.struct(*points.columns).alias("_point")
    p = points.select("ticker", F.col(ts).alias("ts_ms"), here)
    rows = trades.select("ticker", "ts_ms", "size", F.lit(1).alias("_one")).unionByName(p, allowMissingColumns=True)
    frames = {"n": ("count", F.col("_one")), "volume": ("sum", F.col("size"))}
    out = sliding(rows.filter(F.col("ticker").isNotNull()), ["ticker"], "ts_ms", frames, 1, hold_ms, F.col("_point").isNotNull())
    blank = p.filter(F.col("ticker").isNull() & F.col("ts_ms").isNotNull()).select("_point.*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("volume"))
    return out.select("_point.*", "n", F.coalesce("volume", F.lit(0)).alias("volume")).unionByName(blank)


def nearest(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, value: str, seq: str | None, window_ms: int, name: str,
    bucket_ms: int = HOUR,
) -> DataFrame:
    """Value of the closest right row within +-window; the earlier row wins a tie."""
    out = asof_join(left, right, ["ticker"], left_ts, right_ts, [value], seq, "backward", tolerance_ms=window_ms, bucket_ms=bucket_ms, prefix="_p_")
    out = asof_join(out, right, ["ticker"], left_ts, right_ts, [value], seq, "forward", tolerance_ms=window_ms, bucket_ms=bucket_ms, prefix="_n_")
    dp, dn = F.col(left_ts) - F.col(f"_p_{right_ts}"), F.col(f"_n_{right_ts}") - F.col(left_ts)
    value_col = F.when(dn.isNull() | (dp <= dn), F.col(f"_p_{value}")).otherwise(F.col(f"_n_{value}"))
    return out.select(*left.columns, value_col.alias(name))


def close_at(bars: DataFrame, points: DataFrame, ts: str, bar_ms: int = 60_000, forward_ms: int = 120_000, name: str = "close_at") -> DataFrame:
    """Close of the bar containing `ts`, else of the next bar starting within `forward_ms`."""
    out = asof_join(points, bars, ["ticker"], ts, "bar_start", ["close"], tolerance_ms=bar_ms - 1, prefix="_c_")
    out = asof_join(out, bars, ["ticker"], ts, "bar_start", ["close"], direction="forward", strict=True, tolerance_ms=forward_ms, prefix="_f_")
    return out.select(*points.columns, F.coalesce("_c_close", "_f_close").alias(name))


def max_in_window(points: DataFrame, trades: DataFrame, ts: str, length_ms: int, key: str, name: str) -> DataFrame:
    """Highest price in [ts, ts + length] per point; null without trades."""
    best = window_extremes(points, trades, key, ts, length_ms, include_start=True)
    return points.select(key).join(best.select(key, F.col("hi").alias(name)), key, "left")


def signal_exit_stats(signals: DataFrame, trades: DataFrame, hold_ms: int, key: str = "signal_id", bucket_ms: int = HOUR) -> DataFrame:
    """Entry, exit, extremes and their delays over (entry, entry + hold] for signals with a price at entry.

    An empty window exits at the next trade after entry, if there is one. Equal extremes count at the first time they are reached.
    """
    sig = entry_prices(signals, trades, fallback_ms=None, bucket_ms=bucket_ms).filter(F.col("entry_price").isNotNull())
    out = sig.join(window_extremes(sig, trades, key, "entry_ms", hold_ms), key, "left")
    out = asof_join(out, trades, ["ticker"], "entry_ms", "ts_ms", ["price"], "seq", "forward", True, bucket_ms=bucket_ms, prefix="_n_")
    empty = F.col("last").isNull()
    price = F.col("entry_price")
    nxt = F.coalesce(F.col("_n_ts_ms") - F.col("entry_ms"), F.lit(0))
    out = out.select(
        *signals.columns,
        "entry_price",
        F.when(empty, F.coalesce("_n_price", price)).otherwise(F.col("last")).alias("exit_price"),
        F.greatest(price, "hi").alias("max_price"),
        F.least(price, "lo").alias("min_price"),
        F.when(empty, nxt).when(F.col("hi") > price, F.col("hi_ms") - F.col("entry_ms")).otherwise(0).alias("time_to_max_ms"),
        F.when(empty, nxt).when(F.col("lo") < price, F.col("lo_ms") - F.col("entry_ms")).otherwise(0).alias("time_to_min_ms"),
    )
    return out.withColumn("return_pct", F.coalesce(ratio(F.col("exit_price") - price, price) * 100, F.lit(0.0)))


def forward_returns(
    points: DataFrame, trades: DataFrame, horizons: Mapping[str, int], ts: str = "ts_ms", price: str = "price", bucket_ms: int = HOUR
) -> DataFrame:
    """fwd_<label> = percent return to the last trade in (t, t + h]; null when that span has no trade.

    Points are distinct rows; all horizons share one as-of lookup.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(h).cast("long").alias("off")) for n, h in horizons.items()])
    at = points.withColumn("_h", F.explode(pairs)).withColumn("_t", F.col(ts) + F.col("_h.off"))
    px = trades.select("ticker", F.col("ts_ms").alias("_pt"), F.col("seq").alias("_ps"), F.col("price").alias("_px"))
    rows = asof_join(at, px, ["ticker"], "_t", "_pt", ["_px"], "_ps", bucket_ms=bucket_ms)
    fwd = F.when(F.col("_pt") > F.col(ts), ratio(F.col("_px") - F.col(price), price) * 100)
    return rows.groupBy(*points.columns).agg(*[F.max(F.when(F.col("_h.label") == n, fwd)).alias(f"fwd_{n}") for n in horizons])


def split_factors(splits: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Cumulative split ratio per (ticker, split_date), newest first; the split applies up to the day before execution.

    `ranges` (ticker, date_min, date_max) keeps only splits within a day of the ticker's own trading range.
    """
    s = splits
    if ranges is not None:
        s = s.join(ranges, "ticker").filter(
            (F.col("execution_date") >= F.date_sub("date_min", 1)) & (F.col("execution_date") <= F.date_add("date_max", 1))
        )
    s = s.select("ticker", F.date_sub("execution_date", 1).alias("split_date"), (F.col("split_from") / F.col("split_to")).alias("_r"))
    s = s.groupBy("ticker", "split_date").agg(F.product("_r").alias("_r"))
    w = Window.partitionBy("ticker").orderBy(F.desc("split_date")).rowsBetween(UNB, 0)
    return s.select("ticker", "split_date", F.product("_r").over(w).alias("factor"))


def adjust_for_splits(bars: DataFrame, splits: DataFrame, decimals: int = 4) -> DataFrame:
    """Prices times, volume divided by the factor of the next split at or after the bar's day."""
    b = bars.withColumn("_day", S.et_date("bar_start"))
    ranges = b.groupBy("ticker").agg(F.min("_day").alias("date_min"), F.max("_day").alias("date_max"))
    f = split_factors(splits, ranges).withColumn("_sd", F.datediff("split_date", F.lit("1970-01-01").cast("date")).cast("long"))
    b = b.withColumn("_bd", F.datediff("_day", F.lit("1970-01-01").cast("date")).cast("long"))
    j = asof_join(b, f, ["ticker"], "_bd", "_sd", ["factor"], direction="forward", bucket_ms=4096, prefix="_s_")
    factor = F.coalesce("_s_factor", F.lit(1.0))
    prices = {c: round_scaled(F.col(c) * factor, decimals) for c in ("open", "high", "low", "close")}
    return j.select(
        *[prices.get(c, F.col(c)).alias(c) if c != "volume" else F.round(F.col("volume") / factor, 0).cast("long").alias("volume") for c in bars.columns]
    )


def connected_groups(edges: DataFrame, node: str, link: str) -> DataFrame:
    """Connected components of a bipartite node-link table: (node, group_id), group_id = smallest node.

    Nodes and links are nodes of one graph, nodes first in order, so the smallest of a component is a node.
    """
    rows = edges.filter(F.col(node).isNotNull())
    types = {c: edges.schema[c].dataType for c in (node, link)}
    end = lambda k, n, x: F.struct(F.lit(k).alias("k"), n.cast(types[node]).alias("n"), x.cast(types[link]).alias("x"))
    of_link = rows.filter(F.col(link).isNotNull()).select(end(0, F.col(node), F.lit(None)).alias("a"), end(1, F.lit(None), F.col(link)).alias("b"))
    found = components(of_link).filter("node.k = 0").select(F.col("node.n").alias(node), F.col("comp.n").alias("_g"))
    return rows.select(node).distinct().join(found, node, "left").select(node, F.coalesce("_g", node).alias("group_id"))


def ticker_groups(identities: DataFrame) -> DataFrame:
    """Tickers sharing an identifier: one row per ticker with its group's ordered history and latest ticker.

    `identities` has ticker, figi, last_updated, delisted, one row per ticker and identifier.
    """
    groups = connected_groups(identities, "ticker", "figi")
    latest = identities.groupBy("ticker").agg(F.max("last_updated").alias("last_updated"), F.max("delisted").alias("delisted"))
    rows = latest.join(groups, "ticker")
    # An identity group is a handful of renames of one company, so the list stays short.
    hist = rows.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("last_updated", "ticker", "delisted"))).alias("_h"))
    return hist.select(
        "group_id",
        F.transform("_h", lambda x: x["ticker"]).alias("tickers"),
        F.element_at("_h", -1)["ticker"].alias("latest_ticker"),
        "_h",
    ).select("group_id", "tickers", "latest_ticker", F.posexplode("_h").alias("ordinal", "_e")).select(
        "group_id", "latest_ticker", "tickers", "ordinal", F.col("_e.ticker").alias("ticker"),
        F.col("_e.last_updated").alias("last_updated"), F.col("_e.delisted").alias("delisted"),
    )


def align_renames(bars: DataFrame, groups: DataFrame, date_col: str = "date") -> DataFrame:
    """Rename history applied to bars: each earlier ticker contributes a range after the previous one ended.

    A ticker keeps dates after the last kept date of its predecessors and up to min(last_updated,
    delisted). That last kept date is the running maximum of each predecessor's newest date within its
    own cutoff, so the rule is a window over one summary row per ticker.
    """
    g = groups.select("ticker", "group_id", "latest_ticker", "ordinal", F.least("last_updated", "delisted").alias("_cut"))
    newest = (
        bars.select("ticker", date_col).join(g, "ticker")
        .filter(F.col("_cut").isNull() | (F.col(date_col) <= F.col("_cut")))
        .groupBy("group_id", "ordinal").agg(F.max(date_col).alias("_m"))
    )
    members = g.join(newest, ["group_id", "ordinal"], "left")
    w = Window.partitionBy("group_id").orderBy("ordinal").rowsBetween(UNB, -1)
    spans = members.select("ticker", "latest_ticker", "_cut", F.max("_m").over(w).alias("_after"), F.count(F.lit(1)).over(Window.partitionBy("group_id")).alias("_n"))
    j = bars.join(spans, "ticker", "left")
    keep = (F.coalesce(F.col("_n"), F.lit(1)) == 1) | (
        (F.col("_after").isNull() | (F.col(date_col) > F.col("_after"))) & (F.col("_cut").isNull() | (F.col(date_col) <= F.col("_cut")))
    )
    return j.filter(keep).select(
        *[F.coalesce("latest_ticker", "ticker").alias("ticker") if c == "ticker" else F.col(c) for c in bars.columns], F.col("ticker").alias("source_ticker")
    )


def resolve_profiles(groups: DataFrame, profiles: DataFrame, on_date: str) -> DataFrame:
    """Profile of the group's latest ticker for every member not delisted by the date."""
    active = groups.filter(F.col("delisted").isNull() | (F.col("delisted") > F.lit(on_date).cast("date")))
    p = profiles.withColumnRenamed("ticker", "latest_ticker")
    cols = [c for c in profiles.columns if c not in ("ticker", "delisted")]
    return active.select("ticker", "latest_ticker").join(p.select("latest_ticker", *cols), "latest_ticker")


def latest_factor(long: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Newest value per (ticker, factor)."""
    return long.groupBy("ticker", "factor").agg(F.max_by("value", ts).alias("value"), F.max(ts).alias(ts))


def coverage_flags(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every key of either side: 'both', 'missing' (only expected) or 'extra' (only found)."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    f = found.select(key).distinct().withColumn("_f", F.lit(1))
    return e.join(f, key, "full").select(
        key, F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("both").alias("coverage")
    )


def factor_timeseries(factors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Merged factors of each candidate from its first entry on, with the gain at entry and the phase of day."""
    c = candidates.select("ticker", "first_entry_ms", F.col("gain_at_entry").alias("entry_gap_pct"))
    return (
        factors.join(c, "ticker")
        .filter(F.col("ts_ms") >= F.col("first_entry_ms"))
        .withColumn("session_phase", S.session_phase(S.to_et_ms("ts_ms")))
        .drop("first_entry_ms")
    )
