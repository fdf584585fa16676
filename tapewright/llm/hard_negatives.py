"""Hard negatives by an inverted multi-index: two half-space codebooks whose pairs are cells.

A query takes the cells in falling order of a bound on the scores inside: the sum of two half bounds, each the
score of the half's centroid and the query's norm times the half's radius. It stops when what it holds is certain
against the bound of the next cell, so the answers are exact and the index only saves work.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tapewright.functions.durable import shared_folder
from tapewright.functions.numeric import floor_div
from tapewright.llm.vectors import longest, matrix, padded, scaled, usable

#: Rows that the codebooks are fitted on; all rows are indexed.
SAMPLE = 8192
#: Rows of a cell aimed at, most centroids of a half (so that the directory has at most 65,536 cells), and rows of a page.
CELL_ROWS, MOST_CENTROIDS, PAGE_ROWS = 1024, 256, 4096
#: Queries scored together; rows a query looks at in its first round, and how much further it looks in each next one.
BLOCK, FIRST_LOOK, LOOK_GROWTH = 512, 2048, 8

QUERY = "q long, id long, label long, v binary, lo array<long>, hi array<long>, least array<long>, seen int, bound double"
HIT = "q long, w int, score long, id long, label long"


@dataclass(frozen=True)
class Index:
    """The codebooks and the directory (both bounded) and the path of the pages."""

    path: str
    size: int
    kind: str  # numpy type of a stored entry
    exact: bool  # scores fit a double exactly
    halves: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # rows of each cell


def rows_of(df: DataFrame, scale: int, relabel_every: int, classes: int) -> DataFrame:
    """(id, label, x): the rows that take part, each once, with whole-number vectors."""
    label = F.col("label").cast("long")
    new = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % classes).otherwise(label) if relabel_every else label
    rows = df.filter(F.col("label").isNotNull() & usable(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("id"), new.alias("label"), scaled(F.col("embedding"), scale).alias("x")).distinct()


def without_spare_copies(rows: DataFrame, keep: int) -> DataFrame:
    """The `keep` smallest ids of each (label, vector).

    Copies have one score with every query and are taken by their ids, so no answer of fewer rows ever
    holds another one. Ranks are cut before the shuffle: a vector that many rows share sends `keep` of them a task.
    """
    by = Window.partitionBy("label", "_h1", "_h2").orderBy(F.asc_nulls_last("id"))
    hashed = rows.withColumns({"_h1": F.xxhash64("x"), "_h2": F.xxhash64(F.lit(7), "x")})
    return hashed.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= keep).drop("_n", "_h1", "_h2")


def codebook(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the sample by Lloyd's iterations from evenly spread rows; empty ones stay where they are."""
    centers = sample[np.linspace(0, len(sample) - 1, k).astype(int)].astype(float)
    for _ in range(rounds):
        near = nearest(sample, centers)[0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and the distance to it."""
    near = ((centers**2).sum(1) - 2 * (x @ centers.T)).argmin(1) if len(centers) > 1 else np.zeros(len(x), int)
    return near, np.sqrt(((x - centers[near]) ** 2).sum(1))


def build(rows: DataFrame, cell_rows: int = CELL_ROWS) -> Index:
    """Index all `rows` (id, label, x); x has one length. Codebooks are fitted on SAMPLE rows in the order of a hash."""
    spark = rows.sparkSession
    size = longest(rows, "x")
    n, most = rows.agg(F.count("*"), F.max(F.greatest(F.lit(0), F.array_max("x"), -F.array_min("x")))).first()
    kind = "<i4" if (most or 0) < 2**31 else "<i8"
    sample = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).toArrow()["x"]
    sample = matrix(sample, size).astype(float)
    k = int(min(MOST_CENTROIDS, max(1, round((n / cell_rows) ** 0.5)), max(1, len(sample))))
    cut = size // 2
    first, second = (codebook(half, k) if len(half) else np.zeros((1, half.shape[1])) for half in (sample[:, :cut], sample[:, cut:]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["x"], size)
            c1, r1 = nearest(x[:, :cut].astype(float), first)
            c2, r2 = nearest(x[:, cut:].astype(float), second)
            stored = np.ascontiguousarray(x.astype(kind))
            v = [row.tobytes() for row in stored]
            cell = (c1 * k + c2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b["id"], b["label"], pa.array(v, pa.binary()), pa.array(r1), pa.array(r2)], ["cell", "id", "label", "v", "r1", "r2"])

    folder = shared_folder(spark, "multi-index")
    rows.mapInArrow(assign, "cell int, id long, label long, v binary, r1 double, r2 double").write.parquet(f"{folder}/rows")
    placed = spark.read.parquet(f"{folder}/rows")
    counts, radii = np.zeros(k * k, np.int64), (np.zeros(k), np.zeros(k))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    for r in cells.collect():  # at most MOST_CENTROIDS squared rows
        counts[r.cell] = r.n
        radii[0][r.cell // k] = max(radii[0][r.cell // k], r.r1)
        radii[1][r.cell % k] = max(radii[1][r.cell % k], r.r2)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "label", "v"], na_position="last")
        has = group["id"].notna()
        ids = np.where(has, group["id"].fillna(0), 0).astype("<i8")
        out = {"cell": group["cell"].iloc[0], "page": group["page"].iloc[0], "ids": ids.tobytes(), "named": has.to_numpy().tobytes()}
        return pd.DataFrame([out | {"labels": group["label"].to_numpy("<i8").tobytes(), "v": b"".join(group["v"])}])

    n_pages = F.ceil(F.col("n") / PAGE_ROWS)
    sizes = spark.createDataFrame([(int(c), int(counts[c])) for c in np.flatnonzero(counts)], "cell int, n long")
    paged = placed.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id", "label", "v"), n_pages).alias("page"), "id", "label", "v")
    pages = paged.groupBy("cell", "page").applyInPandas(pack, "cell int, page long, ids binary, named binary, labels binary, v binary")
    pages.write.parquet(f"{folder}/pages")
    return Index(f"{folder}/pages", size, kind, size * float(most or 0) ** 2 < 2**53, (first, second), radii, counts)


def cells_in_order(u1: np.ndarray, u2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) in falling order of u1[i] + u2[j]: the multi-sequence walk over two sorted lists with a heap."""
    o1, o2 = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
    s1, s2 = u1[o1].tolist(), u2[o2].tolist()
    heap = [(-(s1[0] + s2[0]), 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield -bound, int(o1[a]), int(o2[b])
        if b + 1 < len(s2):
            heapq.heappush(heap, (-(s1[a] + s2[b + 1]), a, b + 1))
        if b == 0 and a + 1 < len(s1):
            heapq.heappush(heap, (-(s1[a + 1] + s2[0]), a + 1, 0))


def look(index: Index, rows: int):
    """A function for mapInPandas: the cells that each query looks at next, and the bound of the first one after them."""
    cut, k = index.size // 2, len(index.halves[0])
    counts = index.counts.tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells, seen, bounds = [], [], []
            for q in batch.itertuples():
                v = np.frombuffer(q.v, index.kind).astype(float)
                mid, span = [], []
                for half, centers, radii in ((v[:cut], index.halves[0], index.radii[0]), (v[cut:], index.halves[1], index.radii[1])):
                    mid.append(centers @ half)
                    # Rounding in the centroids' scores and the radii must not cut off a row: the bound is widened.
                    slack = 1e-9 * (np.abs(centers) @ np.abs(half) + np.linalg.norm(half) * radii) + 1e-6
                    span.append(np.linalg.norm(half) * radii + slack)
                u1, u2 = mid[0] + span[0], mid[1] + span[1]
                lows = (mid[0] - span[0], mid[1] - span[1])
                # A window is still open from its lower end, or from the last row it holds when it is full.
                open_ = [(max(lo, least), hi) for lo, hi, least in zip(q.lo, q.hi, q.least, strict=True) if lo <= hi]
                chosen, looked, n, bound = [], 0, 0, -np.inf
                for bound, i, j in itertools.islice(cells_in_order(u1, u2), int(q.seen), None):
                    if looked >= rows:
                        break
                    n += 1
                    cell = i * k + j
                    if counts[cell] and any(lo <= bound and lows[0][i] + lows[1][j] <= hi for lo, hi in open_):
                        chosen.append(cell)
                        looked += counts[cell]
                else:
                    bound = -np.inf
                cells.append(chosen)
                seen.append(int(q.seen) + n)
                bounds.append(bound)
            yield batch.assign(cells=cells, seen=seen, bound=bounds)

    return run


def pack_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each cell and block of queries that look at it."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            block = batch.iloc[at : at + BLOCK]
            pairs = pd.DataFrame({"cell": block["cells"]}).explode("cell").dropna()
            for cell, members in pairs.groupby("cell").groups.items():
                m = block.loc[members]
                yield pd.DataFrame(
                    [{
                        "cell": int(cell), "qs": m["q"].tolist(), "ids": m["id"].tolist(), "labels": m["label"].tolist(), "v": b"".join(m["v"]),
                        "windows": len(m["lo"].iloc[0]), "lo": list(itertools.chain(*m["lo"])), "hi": list(itertools.chain(*m["hi"])), "least": list(itertools.chain(*m["least"])),
                    }]
                )


def score(index: Index, same_label: bool, keep: int):
    """A function for mapInPandas: the first `keep` rows of a page in each window of each query of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact = float if index.exact else np.int64
        for batch in batches:
            for r in batch.itertuples():
                raw, asked = (np.frombuffer(b, index.kind).reshape(-1, index.size) for b in (r.pv, r.v))
                x, a = raw.astype(exact), asked.astype(exact)
                ids, named, labels = np.frombuffer(r.pids, "<i8"), np.frombuffer(r.pnamed, bool), np.frombuffer(r.plabels, "<i8")
                scores = (a @ x.T).astype(np.int64)
                out = []
                for m, (q, qid, label) in enumerate(zip(r.qs, r.ids, r.labels, strict=True)):
                    fit = labels == label if same_label else labels != label
                    if same_label:  # the query itself is no answer
                        for own in np.flatnonzero(fit & named & (ids == qid)):
                            fit[own] = not np.array_equal(raw[own], asked[m])
                    for w in range(r.windows):
                        at = m * r.windows + w
                        inside = np.flatnonzero(fit & (scores[m] >= max(r.lo[at], r.least[at])) & (scores[m] <= r.hi[at]))
                        if len(inside) > keep:
                            s = scores[m][inside]
                            inside = inside[s >= np.partition(s, len(s) - keep)[len(s) - keep]]
                        # Rows of a page stand in the order of ids, unnamed ones last, so ties fall as they should.
                        for i in inside[np.argsort(-scores[m][inside], kind="stable")][:keep]:
                            out.append((q, w, scores[m][i], ids[i] if named[i] else None, labels[i]))
                if out:
                    yield pd.DataFrame(out, columns=["q", "w", "score", "id", "label"]).astype({"id": "Int64"})

    return run


LOWEST = -(2**63)


def search(queries: DataFrame, index: Index, same_label: bool, keep: int) -> DataFrame:
    """(q, w, place, score, id, label): the first `keep` rows for each window of each query, by score, then id.

    `queries` has (q, id, label, v, lo, hi): a window takes scores from lo[w] to hi[w]. Each round looks at the next cells of every query
    that is not certain yet, about LOOK_GROWTH times as many rows as the round before, and keeps the first rows
    of each window. A window is certain when it is full and its last row beats the bound of the next cell,
    when its lower end lies above that bound, or when no cell is left. Rounds are written to shared storage.
    """
    spark = queries.sparkSession
    folder = shared_folder(spark, "search")
    pages = spark.read.parquet(index.path).withColumnsRenamed({"ids": "pids", "named": "pnamed", "labels": "plabels", "v": "pv"})
    n_pages = spark.createDataFrame([(int(c), -(-int(index.counts[c]) // PAGE_ROWS)) for c in np.flatnonzero(index.counts)], "cell int, n long")
    state = queries.withColumns({"least": F.transform("lo", lambda _: F.lit(LOWEST)), "seen": F.lit(0), "bound": F.lit(float("inf"))})
    hits = spark.createDataFrame([], HIT)
    first = Window.partitionBy("q", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "label")
    done = []
    for turn in itertools.count():
        state.mapInPandas(look(index, FIRST_LOOK * LOOK_GROWTH**turn), f"{QUERY}, cells array<int>").write.parquet(f"{folder}/looked-{turn}")
        looked = spark.read.parquet(f"{folder}/looked-{turn}")
        probes = looked.mapInPandas(pack_probes, "cell int, qs array<long>, ids array<long>, labels array<long>, v binary, windows int, lo array<long>, hi array<long>, least array<long>")
        probes = probes.join(F.broadcast(n_pages), "cell").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
        found = probes.join(pages, ["cell", "page"]).mapInPandas(score(index, same_label, keep), HIT)
        best = hits.unionByName(found).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= keep)
        best.write.parquet(f"{folder}/hits-{turn}")
        best = spark.read.parquet(f"{folder}/hits-{turn}")
        # A full window holds its last score; at most `keep` rows for each of the few windows of a query.
        last = best.filter(F.col("place") == keep).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))
        least = F.transform("lo", lambda _, w: F.coalesce(F.try_element_at("last", w.cast("int")), F.lit(LOWEST)))
        state = looked.drop("cells").join(last, "q", "left").withColumn("least", F.coalesce(F.when(F.col("last").isNotNull(), least), F.col("least"))).drop("last")
        sure = F.forall(F.arrays_zip("lo", "hi", "least"), lambda z: (z["lo"] > z["hi"]) | (z["lo"] > F.col("bound")) | (z["least"] > F.col("bound")))
        state.withColumn("sure", sure | (F.col("bound") == float("-inf"))).write.parquet(f"{folder}/state-{turn}")
        state = spark.read.parquet(f"{folder}/state-{turn}")
        done.append(best.join(state.filter("sure").select("q"), "q", "left_semi"))
        state = state.filter("NOT sure").drop("sure")
        hits = best.join(state.select("q"), "q", "left_semi").drop("place")
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mine(
    df: DataFrame, anchor_every: int = 100, relabel_every: int = 7, classes: int = 10, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    `df` has (vec_id, embedding, label); other columns are left behind. Anchors are the rows whose id is divisible by
    `anchor_every`, their positives the first `positives` other rows of their label by inner product, and for each positive the first
    `negatives` rows of other labels with low * positive_score <= 100 * score <= high * positive_score. Ties go to the smaller
    id, a null id last. Rows with a null label, vector or entry, or an entry that is not finite, take no part; a shorter vector is
    filled up with zeros. Rows equal in all three columns count once; rows of one id with other content are rows of their own,
    and each of them is an anchor. A hundred times an inner product must stay below 2^53. An anchor without positives or negatives has no rows.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "hard-negatives")
    rows_of(df, scale, relabel_every, classes).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    size = max(1, longest(rows, "x"))
    rows = rows.withColumn("x", padded(F.col("x"), size, 0))
    if rows.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")
    without_spare_copies(rows, max(positives + 1, negatives)).write.parquet(f"{folder}/apart")
    index = build(spark.read.parquet(f"{folder}/apart"), cell_rows)

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [row.tobytes() for row in np.ascontiguousarray(matrix(b["x"], size).astype(index.kind))]
            yield pa.RecordBatch.from_arrays([b["q"], b["id"], b["label"], pa.array(v, pa.binary())], ["q", "id", "label", "v"])

    anchors = rows.filter(F.col("id") % anchor_every == 0).repartition("id").withColumn("q", F.monotonically_increasing_id())
    anchors.mapInArrow(binary, "q long, id long, label long, v binary").write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    everything = anchors.withColumns({"lo": F.array(F.lit(LOWEST)), "hi": F.array(F.lit(2**63 - 1))})
    pos = search(everything, index, True, positives).select("q", F.col("place").alias("positive_rank"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    pos.write.parquet(f"{folder}/positives")
    pos = spark.read.parquet(f"{folder}/positives")
    # At most `positives` windows for each query, in the order of the positives.
    scores = pos.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("p"))
    # Every query has `positives` windows, so that the blocks of queries are even; those behind its positives are empty.
    bounds = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.get("p", i)["positive_score"])
    lo = F.transform(bounds, lambda s: F.coalesce(-floor_div(-s * low, 100), F.lit(1).cast("long")))
    hi = F.transform(bounds, lambda s: F.coalesce(floor_div(s * high, 100), F.lit(0).cast("long")))
    windows = anchors.join(scores, "q").select("q", "id", "label", "v", lo.alias("lo"), hi.alias("hi"))
    neg = search(windows, index, False, negatives)
    out = neg.join(pos, (neg["q"] == pos["q"]) & (neg["w"] + 1 == pos["positive_rank"])).join(anchors.select(F.col("q").alias("_q"), F.col("id").alias("anchor_id")), neg["q"] == F.col("_q"))
    return out.select("anchor_id", "positive_id", "positive_rank", F.col("place").alias("rank"), neg["id"].alias("negative_id"), "positive_score", neg["score"].alias("negative_score"))


MINE_SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.id % 100 = 0 AND a.id <> r.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS positive_rank
  FROM pairs WHERE same QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, positive_id, CAST(positive_rank AS INTEGER) AS positive_rank, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= 5
"""
