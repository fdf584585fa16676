"""Time-bucketed windows: the way every tick-level window and as-of lookup is distributed.

A window partitioned by ticker alone puts a whole ticker in one task, and one hot ticker may hold a
third of all ticks. Three helpers split a ticker by time instead:

* `range_windows` partitions by (keys, time bucket) and copies a row into the neighbouring buckets
  whose frames can see it (a halo no wider than the frame). Only the bucket that owns a row emits it.
* `sliding` aggregates over one time-range frame in work linear in the rows, however many a frame holds;
  a frame of `range_windows` is gone through anew for each row, which suits few rows a frame.
* `asof_join` finds the last row at or before a time. Each (key, bucket) is first reduced to its last
  row; those summaries (one per key and bucket, so bounded by the calendar) are carried forward over
  empty buckets, and the carried row is placed in front of the bucket it belongs to.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tapewright.functions.numeric import col, floor_div

UNB = Window.unboundedPreceding
_BUCKET, _OWN, _SIDE, _PAY, _CARRY = "_tw_bucket", "_tw_own", "_tw_side", "_tw_pay", "_tw_carry"


def default_bucket(span_ms: int) -> int:
    """At least an hour, and wide enough that the halo copies at most a quarter of the rows."""
    return max(3_600_000, 4 * span_ms)


def with_halo(df: DataFrame, ts: str, bucket_ms: int, before_ms: int = 0, after_ms: int = 0) -> DataFrame:
    """Copy each row to every bucket holding a row whose frame [t-before, t+after] can contain it."""
    first = floor_div(F.col(ts) - F.lit(after_ms).cast("long"), bucket_ms)
    last = floor_div(F.col(ts) + F.lit(before_ms).cast("long"), bucket_ms)
    return df.withColumn(_BUCKET, F.explode(F.sequence(first, last))).withColumn(
        _OWN, F.col(_BUCKET) == floor_div(ts, bucket_ms)
    )


def range_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    exprs: Mapping[str, Callable[[WindowSpec], Column]],
    before_ms: int,
    after_ms: int = 0,
    bucket_ms: int | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Add columns computed over time-range frames of at most [-before_ms, +after_ms].

    Each expression receives the window ordered by `ts`, to which it adds its own `rangeBetween`.
    `keep` drops rows that only served as frame content (say, ticks around a grid).
    """
    bucket = bucket_ms or default_bucket(before_ms + after_ms)
    halo = with_halo(df, ts, bucket, before_ms, after_ms)
    w = Window.partitionBy(*keys, _BUCKET).orderBy(ts)
    out = halo.select("*", *[make(w).alias(name) for name, make in exprs.items()]).filter(_OWN)
    if keep is not None:
        out = out.filter(keep)
    return out.drop(_BUCKET, _OWN)


_MERGE = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "count": (F.count, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def sliding(df: DataFrame, keys: Sequence[str], ts: str, frames: Mapping[str, tuple[str, Column]], start_ms: int, end_ms: int = 0, keep: Column | None = None) -> DataFrame:
    """Add (kind, value) aggregates over the key's rows in [t + start_ms, t + end_ms]; kind is sum, avg, count, max or min.

    Time is cut into blocks as long as the frame, so a frame is the end of one block and the beginning of the next. Either is a
    running aggregate: of the block's own rows up to t, and of the rows of the block before, moved by one length, after t. Nothing
    is subtracted. Rows without a time are left out. `keep` drops rows that only serve as frame content.
    """
    length = end_ms - start_ms + 1
    parts = {}
    for n, (kind, value) in frames.items():
        parts |= {(n, "sum"): ("sum", value), (n, "count"): ("count", value)} if kind == "avg" else {(n, kind): (kind, value)}
    # 0 is the row itself, 1 what it adds to the frames of its block, 2 to those of the next one.
    side, t = F.col("_sl.s"), F.col(ts).cast("long")
    moved = [F.struct(F.lit(0).alias("s"), t.alias("t")), F.struct(F.lit(1).alias("s"), (t - end_ms).alias("t")), F.struct(F.lit(2).alias("s"), (t - end_ms + length).alias("t"))]
    if end_ms or keep is not None:
        own = side == 1
        moved = F.array(*moved) if keep is None else F.when(keep, F.array(*moved)).otherwise(F.array(*moved[1:]))
    else:
        own = side == 0
        moved = F.array(moved[0], moved[2])
    rows = df.filter(t.isNotNull()).select(
        *[F.col(k).alias(f"_sl_{k}") for k in keys], F.struct(*df.columns).alias("_sl_row"), *[v.alias(f"_sl_v{i}") for i, (_, v) in enumerate(parts.values())], F.explode(moved).alias("_sl")
    )
    rows = rows.select(
        *[f"_sl_{k}" for k in keys], F.when(side == 0, F.col("_sl_row")).alias("_sl_row"), "_sl", floor_div("_sl.t", length).alias("_sl_block"),
        *[F.when(c, F.col(f"_sl_v{i}")).alias(f"_sl_{n}{i}") for i in range(len(parts)) for n, c in (("a", own), ("b", side == 2))],
    )
    block = Window.partitionBy(*[f"_sl_{k}" for k in keys], "_sl_block")
    until, after = block.orderBy(F.col("_sl.t")).rangeBetween(UNB, 0), block.orderBy(-F.col("_sl.t")).rangeBetween(UNB, -1)
    for part, w in (("a", until), ("b", after)):
        rows = rows.select("*", *[_MERGE[kind][0](f"_sl_{part}{i}").over(w).alias(f"_sl_{part}w{i}") for i, (kind, _) in enumerate(parts.values())])
    whole = {part: _MERGE[kind][1](F.col(f"_sl_aw{i}"), F.col(f"_sl_bw{i}")) for i, (part, (kind, _)) in enumerate(parts.items())}
    value = lambda n, kind: whole[n, "sum"] / F.when(whole[n, "count"] > 0, whole[n, "count"]) if kind == "avg" else whole[n, kind]
    return rows.filter(side == 0).select("_sl_row.*", *[value(n, kind).alias(n) for n, (kind, _) in frames.items()])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_cols: Sequence[str],
    right_seq: str | None = None,
    direction: str = "backward",
    strict: bool = False,
    tolerance_ms: int | None = None,
    bucket_ms: int = 3_600_000,
    prefix: str = "",
    keep_unmatched: bool = True,
) -> DataFrame:
    """As-of lookup of `right` rows for each `left` row, per `on` key.

    backward: the latest right row with right_ts <= left_ts (`<` if strict); forward: the earliest
    with right_ts >= left_ts (`>` if strict). Ties on right_ts go to the larger (backward) or smaller
    (forward) `right_seq`. Adds `prefix + column` for every right column and `prefix + right_ts`.
    """
    sign = 1 if direction == "backward" else -1
    seq = F.col(right_seq).cast("long") if right_seq else F.lit(0).cast("long")
    pay_cols = list(dict.fromkeys([right_ts, *right_cols]))
    left_cols = left.columns
    r = right.select(
        *on,
        (F.col(right_ts) * sign).alias("_tw_t"),
        (seq * sign).alias("_tw_s"),
        F.struct(*pay_cols).alias(_PAY),
    ).withColumn(_BUCKET, floor_div("_tw_t", bucket_ms))
    l = left.select(
        *on,
        (F.col(left_ts) * sign).alias("_tw_t"),
        F.struct(*left_cols).alias("_tw_left"),
    ).withColumn(_BUCKET, floor_div("_tw_t", bucket_ms))

    # One summary row per (key, bucket) of either side; the left side only marks buckets as present.
    marks = l.select(*on, _BUCKET).groupBy(*on, _BUCKET).agg(F.lit(None).cast("int").alias("_tw_m")).drop("_tw_m")
    last = r.groupBy(*on, _BUCKET).agg(
        F.max_by(F.struct("_tw_t", "_tw_s", _PAY), F.struct("_tw_t", "_tw_s")).alias(_CARRY)
    )
    carry = (
        marks.unionByName(last, allowMissingColumns=True)
        .groupBy(*on, _BUCKET)
        .agg(F.first(_CARRY, ignorenulls=True).alias(_CARRY))
        .withColumn(
            _CARRY,
            F.last(_CARRY, ignorenulls=True).over(Window.partitionBy(*on).orderBy(_BUCKET).rowsBetween(UNB, -1)),
        )
        .filter(F.col(_CARRY).isNotNull())
        .select(*on, _BUCKET, f"{_CARRY}.*")
    )
    # At equal times a right row must sort before a left row, unless the match is strict.
    right_side, left_side = (2, 1) if strict else (1, 2)
    rows = (
        r.unionByName(carry)
        .withColumn(_SIDE, F.lit(right_side))
        .unionByName(
            l.withColumn(_SIDE, F.lit(left_side)).withColumn("_tw_s", F.lit(0).cast("long")), allowMissingColumns=True
        )
    )
    w = Window.partitionBy(*on, _BUCKET).orderBy("_tw_t", _SIDE, "_tw_s").rowsBetween(UNB, 0)
    out = rows.withColumn(_PAY, F.last(_PAY, ignorenulls=True).over(w)).filter(F.col(_SIDE) == left_side)
    pay = {c: F.col(f"{_PAY}.{c}") for c in pay_cols}
    if tolerance_ms is not None:
        near = F.abs(F.col(f"{_PAY}.{right_ts}") - F.col(f"_tw_left.{left_ts}")) <= tolerance_ms
        pay = {c: F.when(near, v) for c, v in pay.items()}
    out = out.select("_tw_left.*", *[v.alias(prefix + c) for c, v in pay.items()])
    return out if keep_unmatched else out.filter(F.col(prefix + right_ts).isNotNull())


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    start: str | Column,
    end: str | Column,
    right_ts: str,
    include_start: bool = False,
    include_end: bool = True,
    bucket_ms: int = 3_600_000,
    how: str = "left",
) -> DataFrame:
    """Rows of `right` falling in each left interval, matched on (keys, time bucket).

    Left rows are copied to the buckets their interval touches, so a hot key is spread over its time
    buckets. With how='left', a bucket without rows leaves one row with nulls on the right; callers
    aggregate per interval, where such rows add nothing.
    """
    s, e = col(start), col(end)
    l = left.withColumn("_ij_s", s).withColumn("_ij_e", e)
    l = l.withColumn(
        _BUCKET, F.explode(F.sequence(floor_div("_ij_s", bucket_ms), F.greatest(floor_div("_ij_s", bucket_ms), floor_div("_ij_e", bucket_ms))))
    )
    r = right.withColumn(_BUCKET, floor_div(right_ts, bucket_ms))
    lo = F.col(right_ts) >= F.col("_ij_s") if include_start else F.col(right_ts) > F.col("_ij_s")
    hi = F.col(right_ts) <= F.col("_ij_e") if include_end else F.col(right_ts) < F.col("_ij_e")
    cond = lo & hi
    for k in (*on, _BUCKET):
        r = r.withColumnRenamed(k, f"_r_{k}")
        cond = (F.col(k) == F.col(f"_r_{k}")) & cond
    out = l.join(r, cond, how)
    return out.drop("_ij_s", "_ij_e", _BUCKET, *[f"_r_{k}" for k in (*on, _BUCKET)])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last version per key: keeps the row with the greatest `order` columns.

    Written as an aggregation (max_by), so every map task already reduces to one row per key and a
    key with very many versions is not gathered anywhere.
    """
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_v")).select(*keys, "_v.*").select(*df.columns)


def window_sum_carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str | Column], block: str | Column
) -> DataFrame:
    """Running sums per key without gathering a key in one task.

    `block` splits a key into ordered pieces (a date, an hour number). Each piece is summed with
    map-side combining, the piece totals are accumulated, and the row-level running sum only spans
    one piece.
    """
    b = df.withColumn("_blk", col(block))
    for name, expr in sums.items():
        b = b.withColumn(f"_v_{name}", col(expr))
    totals = b.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(UNB, -1)
    base = totals.select(*keys, "_blk", *[F.coalesce(F.sum(f"_t_{n}").over(wb), F.lit(0)).alias(f"_b_{n}") for n in sums])
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(UNB, 0)
    return (
        b.join(base, [*keys, "_blk"])
        .select(*df.columns, *[(F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(w)).alias(n) for n in sums])
    )


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], running: Mapping[str, Column], merge: Mapping[str, Callable[..., Column]], block: str = "_b") -> DataFrame:
    """Running aggregates per key over blocks of rows: `running` inside a block, merged with what the blocks before give.

    `merge` names, per column, how aggregates of blocks are put together (a sum of counts, a maximum of maxima). The last
    row of a block holds its aggregate, so only one row a block is ordered by key.
    """
    names, put = list(running), {F.max: F.greatest, F.min: F.least}
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    rows = df.select("*", *[c.over(inside.rowsBetween(UNB, 0)).alias(f"_c_{n}") for n, c in running.items()], F.lead(F.lit(1)).over(inside).alias("_more"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(UNB, -1)
    ends = rows.filter(F.col("_more").isNull()).select(*keys, block, *[merge[n](f"_c_{n}").over(before).alias(f"_p_{n}") for n in names])
    total = lambda n: put[merge[n]](f"_c_{n}", f"_p_{n}") if merge[n] in put else F.col(f"_c_{n}") + F.coalesce(F.col(f"_p_{n}"), F.lit(0))
    return rows.join(ends, [*keys, block]).select(*df.columns, *[total(n).alias(n) for n in names])


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str], block: str = "_b") -> DataFrame:
    """`df` with, per new name, a column of the key's row before; across blocks it is carried by the last row of each block."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    rows = df.withColumns({"_here": row}).select("*", F.lag("_here").over(inside).alias("_l"), F.lead(F.lit(1)).over(inside).alias("_more"))
    ends = rows.filter(F.col("_more").isNull()).select(*keys, block, F.lag("_here").over(Window.partitionBy(*keys).orderBy(block)).alias("_p"))
    return rows.join(ends, [*keys, block]).withColumn("_l", F.coalesce("_l", "_p")).select(*df.columns, *[F.col(f"_l.{n}").alias(n) for n in columns])
