"""The registered queries over whole tables, against brute force."""

import os
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tapewright.llm import bloom_lm, importance, queries, spotsigs
from tapewright.llm.common import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert sum(bool(re.match(r"op\d+_|pipeline$", n)) for n in queries.QUERIES) == 14


def test_line_dedup(spark, texts):
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows(spark, "op3_line_dedup")} == brute.line_dedup(texts)


def test_decontamination(spark, texts):
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in rows(spark, "op5_decontaminate")} == brute.contamination(texts, items)


def test_near_duplicates(spark, texts):
    want = {i: (n, c, c == i) for i, (n, c) in brute.near_groups(texts, 4).items()}
    assert {r.doc_id: tuple(r)[1:] for r in rows(spark, "op9_minmax")} == want


def test_personal_data(spark, texts):
    got = rows(spark, "op6_pii")
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got} == {i: brute.spans(t, brute.PII, True) for i, t in texts.items()}


def test_secrets(spark, texts):
    got = rows(spark, "op10_secret_scan")
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == {i: brute.spans(t, brute.SECRETS, False) for i, t in texts.items()}


def test_language_model(spark, texts):
    got, want = rows(spark, "op7_bloom_lm"), brute.unigram_scores(texts)
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("filter_bytes", [0, 1 << 20])
def test_language_model_is_the_same_for_any_number_of_blocks(spark, texts, filter_bytes):
    want = brute.bigram_scores(texts)
    got = bloom_lm.score(table(spark, SF, "documents"), max_filter_bytes=filter_bytes).collect()
    off = [abs(r.score - want[r.doc_id]) / r.n_tokens for r in got]
    assert len(got) == len(want) and 1e-4 < np.mean(off) < 0.03 and np.max(off) < 1  # false positives only


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    from tapewright.llm.packing import vocabulary_path

    tk = Tokenizer.from_file(vocabulary_path())
    tk.encode_special_tokens = True
    want, total = {}, 0
    for i, t in texts.items():
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        at = [0, *range(first, len(ids), 1024), len(ids)]
        want |= {(i, k): (a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(at, at[1:]))}
        total += len(ids)
    got = rows(spark, "op2_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 1024
    assert len(bins) <= 1.1 * -(-total // 1024)


def test_fingerprints(spark, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in rows(spark, "op4_spotsigs")}
    for k, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(a) // 4
        edited = a[: len(a) - n] + b[:n]
        sa, se, sb = map(spotsigs.signatures, (a, edited, b))
        assert tuple(got[i])[1:] == (len(a), brute.sha(edited), spotsigs.as_string(sa), spotsigs.as_string(se), spotsigs.likeness(sa, se), spotsigs.likeness(sa, sb))
    near = [r.near_edited - r.near_next for r in got.values() if r.n_chars > 300]
    assert np.mean(np.array(near) > 0.05) > 0.95


def test_near_fingerprints(spark, texts):
    members, pairs = spotsigs.near_pairs(table(spark, SF, "documents"), 0.8)
    sets = {}
    for i in sorted(texts):
        if len(s := frozenset(spotsigs.signatures(texts[i] or "").tolist())):
            sets.setdefault(s, i)
    some = list(sets.items())
    want = {(min(i, j), max(i, j)) for k, (s, i) in enumerate(some) for t, j in some[:k] if len(s & t) >= 0.8 * len(s | t)}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert {r.id: r.rep for r in members.collect()} == {i: sets[s] for i in texts if (s := frozenset(spotsigs.signatures(texts[i] or "").tolist()))}


def test_quality(spark):
    got = {r.doc_id: r.kept for r in rows(spark, "op8_importance_resampling")}
    labels = table(spark, SF, "labels").collect()
    assert np.mean([got[r.doc_id] == bool(r.quality) for r in labels]) > 0.95


def test_quality_drops_toxic_documents(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r.kept for r in importance.digest(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    labels = table(spark, sf, "labels").filter("quality = 1").collect()
    toxic, clean = ([got[r.doc_id] for r in labels if bool(r.toxic) == t] for t in (True, False))
    print(f"toxic kept {sum(toxic)} of {len(toxic)}, clean kept {sum(clean)} of {len(clean)}")
    assert np.mean(toxic) < 0.3 and np.mean(clean) > 0.9


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.95), ("sf0.1", 0.97)])
def test_quality_agrees_with_clean_labels(spark, sf, least):
    """Clean means good and not toxic; the tables have about 400 and 4,000 labels."""
    d = SF.replace("sf0.001", sf)
    got = {r.doc_id: r.kept for r in importance.digest(table(spark, d, "documents"), table(spark, d, "labels")).collect()}
    labels = table(spark, d, "labels").collect()
    assert np.mean([got[r.doc_id] == (r.quality == 1 and r.toxic == 0) for r in labels]) > least
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]) > 0.98


def test_sampling_follows_the_weights(spark):
    """Over 400 draws of 30 of 60 documents, inclusion is that of Gumbel top-k; no weight but the extreme ones decides alone."""
    from pyspark.sql import functions as F

    weights = [(i - 30) / 4 for i in range(60)]
    d = spark.createDataFrame(list(enumerate(weights)), "id long, w double").crossJoin(spark.range(400).withColumnRenamed("id", "seed"))
    keys = d.withColumn("key", importance.sampling_key(F.col("w"), F.struct("id"), F.col("seed"))).toPandas()
    kept = keys["key"] >= keys.groupby("seed")["key"].transform(lambda k: k.nlargest(30).iloc[-1])
    assert (kept.groupby(keys["seed"]).sum() == 30).all()
    share = kept.groupby(keys["id"]).mean().to_numpy()
    noise = np.random.default_rng(1).gumbel(size=(40_000, 60)) + weights
    want = (noise >= np.sort(noise, axis=1)[:, [30]]).mean(0)
    assert np.abs(share - want).max() < 4.5 * 0.5 / np.sqrt(400)
    assert share[:5].max() < 0.05 and share[-5:].min() > 0.95 and ((share > 0.05) & (share < 0.95)).sum() > 10


def test_the_draw_differs_from_the_likeliest(spark):
    d = SF.replace("0.001", "0.01")
    got = importance.digest(table(spark, d, "documents"), table(spark, d, "labels")).toPandas()
    k = int((got["log_weight"] >= 0).sum())
    assert got["kept"].sum() == k
    likeliest = set(got.nlargest(k, "log_weight")["doc_id"])
    other = importance.digest(table(spark, d, "documents"), table(spark, d, "labels"), seed=12).toPandas()
    a, b = (set(x.loc[x["kept"], "doc_id"]) for x in (got, other))
    assert a != likeliest and a != b and len(a & likeliest) > 0.97 * k


def test_pages(spark):
    import html

    def article(page):
        m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
        blocks = re.split(r"<(?:/?p|/?h1)>", m[1].replace("<br>", " "))
        return "\n\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))

    src = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    got = rows(spark, "op1_html_template")
    assert {r.page_id: r.text for r in got} == {i: article(h) for i, h in src.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else docs.collect()
        assert k == 4 or docs.columns == columns
    q, lines, near, clean, packed = seen.values()
    assert lines.keys() == q.keys()
    assert {i: brute.sha(t) for i, t in lines.items()} == {i: v[2] for i, v in brute.line_dedup(q).items()}
    assert set(near) == {i for i, (_, c) in brute.near_groups(lines, 5).items() if c == i}
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    assert set(clean) == {i for i, v in brute.contamination(near, items).items() if not v[4]}
    assert {r.doc_id for r in packed} == set(clean)
    assert entry.queries()["pipeline"](spark, SF).count() == len(packed)


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    from tapewright.llm.packing import vocabulary_path
    from tapewright.llm.tokens import ChunkEncoder

    tk = Tokenizer.from_file(vocabulary_path())
    tk.encode_special_tokens = True
    random.seed(3)
    some = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", chr(0x3000), chr(0x2003), "1", chr(0xFF12), "é", "ß", "<|endoftext|>", "!", "’", chr(0x200B), "\r\n", "日本", "🙂", "\x0b", "\x00"]
    made = ["".join(random.choice(some) for _ in range(random.randint(0, 40))) for _ in range(5000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tk.encode_batch(made, add_special_tokens=False)]
    assert list(ChunkEncoder(vocabulary_path())(made)) == want
