"""Best-two-fit packing of tokenised documents into sequences of a fixed size."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from tapewright.functions.durable import checkpoint
from tapewright.llm.common import documents

SIZE, END = 1024, 2

#: Shares into which the pieces of one length are dealt for ranking.
RANK_SHARES = 256


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, mark, piece, start, length, ids): the ids of every document and then `end`, in pieces of at most `size`.

    Only longer documents are cut; their first piece takes the remainder. ids are little-endian 32-bit
    bytes. A null or empty text is `end` alone.
    """
    path = path or vocabulary_path()

    def cut(batches: Iterable) -> Iterable:
        import numpy as np
        import pandas as pd

        from tapewright.llm.tokens import ChunkEncoder

        encode = ChunkEncoder(path)
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            held = 0
            for i, mark, ids in zip(b["id"], b["mark"], encode(b["text"])):
                ids += tail
                n = len(ids) // 4
                first = n if n <= size else n % size or size
                starts = [0, *range(first, n, size)]
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], n])):
                    out.append((i, mark, k, a, z - a, ids[4 * a : 4 * z]))
                held += len(ids)
                if held > 16_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "mark", "piece", "start", "length", "ids"]
    kind = dict(docs.dtypes)["doc_id"]
    return documents(docs).mapInPandas(cut, f"doc_id {kind}, mark long, piece int, start long, length long, ids binary")


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[Counter, int]]:
    """Bins for `counts` pieces of each length, as (lengths of a bin, number of such bins).

    A bin is filled greedily, largest piece first. If a gap is left, its smallest piece gives way to the two
    unpacked pieces that fill the widened gap best, if they fill more. Equal bins are planned once: a
    bin is repeated while the pieces last, so the work depends on the lengths that occur, not on the pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan: list[tuple[Counter, int]] = []
    while lengths:
        used: Counter = Counter()
        gap, top = size, len(lengths)
        while (top := bisect_right(lengths, gap, 0, top)) > 0:
            n = lengths[top - 1]
            k = min(gap // n, left[n] - used[n])
            if k == 0:
                top -= 1
                continue
            used[n] += k
            gap -= k * n
        if gap:
            small = min(used)
            room, best = gap + small, (small, None)
            used[small] -= 1
            free = [n for n in lengths[: bisect_right(lengths, room)] if left[n] > used[n]]
            i, j = 0, len(free) - 1
            while i <= j:
                both = free[i] + free[j]
                if both > room:
                    j -= 1
                    continue
                if both > best[0] and (i < j or left[free[i]] - used[free[i]] >= 2):
                    best = (both, (free[i], free[j]))
                i += 1
            for n in best[1] or (small,):
                used[n] += 1
            used = +used
        times = min(left[n] // k for n, k in used.items())
        plan.append((used, times))
        for n, k in used.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return plan


def pack(pieces: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """`pieces` (with `length`, and `keys` that tell them apart) with sequence_id and offset.

    The plan needs only how many pieces have each length, at most `size` numbers; it names, for each
    length, ranges of ranks and their bins. Pieces are ranked within shares of their length, so that one
    frequent length is not ranked in one task. The broadcast plan has at most some `size` bins of at most
    sqrt(2 size) different lengths.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, taken, bins = [], Counter(), 0
    for used, times in best_two_fit(counts, size):
        at = 0
        for n, k in sorted(used.items(), reverse=True):
            slots.append((n, taken[n], taken[n] + k * times, k, bins, at))
            taken[n] += k * times
            at += k * n
        bins += times
    plan = spark.createDataFrame(slots, "length long, lo long, hi long, each long, first_bin long, at long")
    shares = pieces.withColumn("_share", F.pmod(F.xxhash64(*keys), F.lit(RANK_SHARES)))
    sizes = shares.groupBy("length", "_share").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("length", "_share", before.alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_share").orderBy(*keys)) - 1
    ranked = shares.withColumn("_own", own).join(F.broadcast(base), ["length", "_share"]).withColumn("_rank", F.col("_base") + F.col("_own"))
    placed = ranked.join(F.broadcast(plan), "length").filter((F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    rank = F.col("_rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(rank / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("at") + rank % F.col("each") * F.col("length")).alias("offset"),
    )


def digest(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Repeated rows are packed each; an empty table has no sequences. The small table of pieces is written
    once, so that texts are tokenised once for both the counts and the placing.
    """
    cut = tokenize(docs, path, size, end).select("doc_id", "mark", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    packed = pack(checkpoint(cut), ["mark", "piece", "doc_id"], size)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of placed pieces that kept their `ids`: at most one sequence of ids in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
