"""Hard negatives, whitening and shards against brute force, and their edge cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import hard_negatives, queries, sharding, spectra, whitening
from tapewright.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, x long, q int, v string, n int, page int, cell int"
EXTRA = ("i", 1, 2, "v", 3, 4, 5)


def clean(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def brute_negatives(rows, positives=5, negatives=5):
    size = max((len(e) for _, e, _ in rows if e is not None), default=0)
    use = []
    for i, e, label in rows:
        if label is not None and clean(e):
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            x = tuple(math.floor(256 * c) for c in e)
            use.append((i, label, x + (0,) * (size - len(x))))
    use = list(dict.fromkeys(use))
    key = lambda p: (-p[0], p[1][0] is None, p[1][0] or 0, p[1][1])
    out = []
    for a in use:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(sum(p * q for p, q in zip(a[2], r[2], strict=True)), r) for r in use if r != a]
        for k, (p, pos) in enumerate(sorted((s for s in scored if s[1][1] == a[1]), key=key)[:positives], 1):
            fit = sorted((s for s in scored if s[1][1] != a[1] and 80 * p <= 100 * s[0] <= 100 * p), key=key)[:negatives]
            out += [(a[0], pos[0], k, rank, neg[0], p, s) for rank, (s, neg) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(df, **kw):
    return sorted((tuple(r) for r in hard_negatives.mine(df, **kw).collect()), key=str)


def vectors(n, size, seed, hot=0):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        rows.append((i, [x + rng.gauss(0, 0.2) for x in c], rng.randrange(10)))
    return rows + [(n + i, list(centers[0]), 1) for i in range(hot)]


def frame(spark, rows):
    as_float = [(i, None if e is None else [None if c is None else float(np.float32(c)) for c in e], label) for i, e, label in rows]
    return as_float, spark.createDataFrame([(*r, *EXTRA) for r in as_float], SCHEMA).repartition(3)


@pytest.mark.parametrize("cell_rows", [1, 40, 100_000])
def test_hard_negatives_equal_brute_force_for_any_cells(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIRST_LOOK", 30)
    rows, df = frame(spark, vectors(700, 9, 3, hot=350))
    want = brute_negatives(rows)
    assert want and mined(df, cell_rows=cell_rows) == want


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(220, 4, 9) + [
        (300, None, 1), (300, [nan, 1, 1, 1], 1), (300, [1, None, 1, 1], 1), (300, [1, inf, 1, 1], 1), (300, [1, 1, 1, 1], None), (300, [0.5, 0.5], 1), (300, [], 2),
        (300, [0.5, 0.5], 1), (400, [0, 0, 0, 0], 3), (400, [0, 0, 0, 0], 4), (None, [0.5, 0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5, 0.5], 2), (-100, [-0.5, 0.25, 0.5, 1], 0),
    ]
    rows, df = frame(spark, rows)
    assert mined(df, cell_rows=16) == brute_negatives(rows)
    assert mined(df.limit(0)) == []
    assert mined(df.filter("vec_id % 100 <> 0")) == []
    without = [(i, None if e is None else [], label) for i, e, label in rows]
    assert mined(df.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.array().cast("array<float>")))) == brute_negatives(without) != []


def test_cells_come_in_falling_order_each_once():
    rng = np.random.default_rng(2)
    u1, u2 = rng.normal(size=13), rng.normal(size=13)
    got = list(hard_negatives.cells_in_order(u1, u2))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(13) for j in range(13)]
    assert [b for b, _, _ in got] == sorted((b for b, _, _ in got), reverse=True)
    assert all(b == u1[i] + u2[j] for b, i, j in got)


def test_few_cells_are_looked_at_where_rows_lie_in_groups(spark):
    """The bounds save work: of well-separated groups a query looks at a part only."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16)) * 200
    x = np.round(centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(int)
    index = hard_negatives.build(spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, label long, x array<long>"), cell_rows=10)
    q = next(hard_negatives.look(index, 1)(iter([hard_negatives.pd.DataFrame([{"q": 0, "id": 0, "label": 0, "v": x[0].astype(index.kind).tobytes(), "lo": [-(2**63)], "hi": [2**63 - 1], "least": [int(x[0] @ x[0]) - 2000], "seen": 0, "bound": np.inf}])])))
    order = list(hard_negatives.cells_in_order(*(np.asarray(c) for c in [[0.0], [0.0]])))
    assert order == [(0.0, 0, 0)] and len(q["cells"][0]) >= 1
    rest = next(hard_negatives.look(index, 10**9)(iter([q])))
    assert sum(index.counts[c] for c in [*q["cells"][0], *rest["cells"][0]]) < 2000


def spectrum_of(rows, block):
    s = spectra.Spectrum.empty(rows.shape[1])
    for at in range(0, len(rows), block):
        s.add(rows[at : at + block])
    return s


@pytest.mark.parametrize("shape", ["random", "equal values", "zero columns", "one row", "few rows", "repeated rows"])
@pytest.mark.parametrize("block", [1, 17])
def test_rank_one_updates_keep_the_spectrum(shape, block):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(120, 12)) * 40)
    if shape == "equal values":
        x = np.tile(np.vstack([np.eye(12), -np.eye(12)]) * 8, (5, 1))
    elif shape == "zero columns":
        x[:, 3:] = 0
    elif shape == "one row":
        x = x[:1]
    elif shape == "few rows":
        x = x[:5]
    elif shape == "repeated rows":
        x = np.vstack([x[:1]] * 100 + [x[1:4]])
    scatter = np.cov(x.T, bias=True) * len(x) if len(x) > 1 else np.zeros((12, 12))
    size = max(np.abs(scatter).max(), 1)
    half = len(x) // 2
    both = spectrum_of(x[:half], block)
    both.merge(spectrum_of(x[half:], block))
    for s in (spectrum_of(x, block), both):
        assert s.n == len(x) and s.mean == pytest.approx(x.mean(0))
        assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() < 1e-12 * size
        assert np.abs(s.vectors.T @ s.vectors - np.eye(12)).max() < 1e-12


def brute_whitening(rows, k=16):
    size = max((len(e) for _, e in rows if e is not None), default=0)
    use = [(i, [math.floor(64 * c) + 1_000_000 for c in [*e, *[0] * (size - len(e))]]) for i, e in rows if clean(e)]
    u = np.array(sorted({tuple(x) for _, x in use}))
    n, total = len(u), u.sum(0)
    centred = (n * u - total) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    return n, [(i, int(((n * np.array(x) - total) ** 2).sum()), (n * np.array(x) - total) / n @ q[:, :k]) for i, x in use], e


def test_whitening_equals_a_dense_eigendecomposition(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    n, want, e = brute_whitening(rows)
    got = {}
    for r in queries.QUERIES["op12_incremental_whitening"](spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(want)
    sign = np.sign(sum(np.array([got[i][c].whitened for c in range(1, 17)]) * y for i, _, y in want))
    for i, deviation, y in want:
        r = got[i]
        assert sorted(r) == list(range(1, 17)) and {(x.n, x.deviation) for x in r.values()} == {(n, deviation)}
        assert [r[c].whitened for c in range(1, 17)] == pytest.approx(sign * y / np.sqrt(e[:16]), abs=1e-9)
        assert [r[c].explained for c in range(1, 17)] == pytest.approx(e[:16] / e.sum())
        assert 0 <= r[1].identity_error < 1e-10


def test_whitening_edges(spark):
    nan = float("nan")
    rows = [(1, [1, 0, 0]), (1, [1, 0, 0]), (2, [0, 2]), (None, [0, 2, 0]), (3, None), (4, [nan, 1, 1]), (5, [1, None, 1]), (6, [1, 1, 0]), (7, [])]
    _, df = frame(spark, [(i, e, 0) for i, e in rows])
    got = [tuple(r) for r in whitening.digest(df).orderBy("vec_id", "component").collect()]
    n, want, e = brute_whitening(rows)
    assert n == 4 and len(got) == 3 * len(want) and sorted({(r[0], r[3]) for r in got}, key=str) == sorted({w[:2] for w in want}, key=str)
    # The third entry never varies, so the last component is 0 everywhere.
    assert all((r[4], r[5]) == (0.0, 0.0) for r in got if r[1] == 3) and all(r[6] < 1e-10 for r in got)
    assert sum(r[4] ** 2 for r in set(got) if r[1] == 1) > 0
    assert whitening.digest(df.limit(0)).collect() == []
    one = whitening.digest(df.filter("vec_id = 1")).collect()
    assert len(one) == 6 and all((r.whitened, r.explained, r.deviation, r.n) == (0.0, 0.0, 0, 1) for r in one)
    far = whitening.digest(spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation is None for r in sorted(far)] == [True, True, False]


def jump(key, shards):
    at, after, key = -1, 0, key & (2**64 - 1)
    while after < shards:
        at, key = after, (key * 2862933555777941757 + 1) & (2**64 - 1)
        after = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 90])
def test_jump_hash(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(400))]
    got = sharding.assign(spark.createDataFrame([(k,) for k in keys], "k long"), "k", shards).collect()
    assert [r.shard for r in got] == [jump(r.k, shards) for r in got]


def test_shards_of_documents(spark):
    rows = [(i, None if i == 5 else "" if i == 6 else f"text ü {i % 40}", f"s{i}", 1, 2, 3) for i in range(900)]
    rows += [(77, "hot", "s", 1, 2, 3)] * 600 + [(None, "no id", "s", 1, 2, 3)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, size int, _row int").repartition(5)
    got = sharding.digest(df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    for r in got:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 16), jump(r.doc_id or 0, 17))
        assert r.grown_shard in (r.shard, 16)
    texts = {i: t or "" for i, t, *_ in rows[:900] if i != 77}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in got if r.doc_id in texts)
    for s in range(16):
        mine = sorted((r.slot, r.doc_id if r.doc_id is not None else -1) for r in got if r.shard == s)
        assert [slot for slot, _ in mine] == list(range(len(mine)))
        assert [i for _, i in mine] == sorted(i for _, i in mine)
    assert sharding.digest(df.limit(0)).collect() == []
    named = sharding.assign(df.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", 16)
    assert named.columns == df.columns and named.filter("doc_id = '77'").select("shard").distinct().count() == 1


def test_few_keys_move_when_a_shard_is_added(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    sizes = [r["count"] for r in sharding.assign(keys, "k", 16).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.15 * 20_000 / 16
    moved = sharding.moves(keys, "k", 16, 17).collect()
    assert {r.grown_shard for r in moved} == {16} and abs(len(moved) - 20_000 / 17) < 150


def test_sharded_files_hold_all_rows(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "k")
    sharding.write_sharded(df, "k", 8, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.k for r in back.collect()) == list(range(500))
    assert all(r.shard == jump(r.k, 8) for r in back.collect())
