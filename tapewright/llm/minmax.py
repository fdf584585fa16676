"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.components import components
from tapewright.functions.durable import checkpoint
from tapewright.llm.common import documents, salted_join, same_document, whole_rows

PERMUTATIONS, BANDS, ROWS = 56, 28, 4

#: 64-bit words of the bit sets that tell what a text has besides, and lacks of, the text it was compared with.
SET_WORDS = 8

#: Pairs of one center that are compared in one task, about.
PAIRS_A_SHARE = 500


def signatures(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, mark, n, key, bands) of every document.

    Under each of 56 permutations the smallest and the largest value are kept, so 56 evaluations give 112
    signature entries. `bands` hashes 28 groups of 4 entries: a pair at likeness 0.8 shares none with
    probability 4e-7. `key` is a 128-bit hash of the word sequence. A document without words has n = 0 and no
    bands.
    """

    def sign(batches: Iterable) -> Iterable:
        import numpy as np
        import pandas as pd
        from xxhash import xxh3_128_digest

        from tapewright.llm.shingles import mix, shingle_set

        odd = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
        band = mix(np.arange(101, 101 + BANDS, dtype=np.uint64))[None, :]

        def of(some: list) -> pd.DataFrame:
            sets = [x[3] for x in some]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = np.zeros((len(some), BANDS), np.int64)
            if full:
                flat, starts = np.concatenate([sets[i] for i in full]), np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
                entries = np.empty((len(full), 2 * PERMUTATIONS), np.uint64)
                for p in range(PERMUTATIONS):
                    v = flat * odd[p]
                    entries[:, p] = np.minimum.reduceat(v, starts)
                    entries[:, PERMUTATIONS + p] = np.maximum.reduceat(v, starts)
                h = np.broadcast_to(band, (len(full), BANDS))
                for r in range(ROWS):
                    h = mix(h + entries[:, r :: ROWS])
                bands[full] = h.view(np.int64)
            has = set(full)
            return pd.DataFrame({
                "id": [x[0] for x in some], "mark": [x[1] for x in some], "n": [len(s) for s in sets], "key": [x[2] for x in some],
                "bands": [bands[i] if i in has else None for i in range(len(some))],
            })

        for b in batches:
            some, held = [], 0
            for i, mark, text in zip(b["id"], b["mark"], b["text"]):
                s = shingle_set(text, shingle)
                some.append((i, mark, xxh3_128_digest(b" ".join(text.lower().split())), s))
                held += len(s)
                if held > 100_000:
                    yield of(some)
                    some, held = [], 0
            if some:
                yield of(some)

    kind = dict(docs.dtypes)["doc_id"]
    d = documents(docs).select("id", "mark", F.col("text").cast("binary").alias("text"))
    return d.mapInPandas(sign, f"id {kind}, mark long, n long, key binary, bands array<long>")


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(a, b, common, na, nb, more, less) of the pairs (a, b), from the full shingle sets of their texts.

    `more` and `less` are bit sets of the shingles that only b and only a has.
    """

    def compare(batches: Iterable) -> Iterable:
        import numpy as np
        import pandas as pd

        from tapewright.llm.shingles import shingle_set

        def bits(only):
            out = np.zeros(64 * SET_WORDS, bool)
            out[only % np.uint64(64 * SET_WORDS)] = True
            return np.packbits(out, bitorder="little").view("<i8")

        last, held = None, None
        for p in batches:
            out = []
            for a, b, ta, tb in zip(p["a"], p["b"], p["ta"], p["tb"]):
                if ta != last:
                    last, held = ta, shingle_set(ta, shingle)
                other = shingle_set(tb, shingle)
                common = np.intersect1d(held, other, assume_unique=True)
                more, less = (bits(np.setdiff1d(s, common, assume_unique=True)) for s in (other, held))
                out.append((a, b, len(common), len(held), len(other), more, less))
            yield pd.DataFrame(out, columns=["a", "b", "common", "na", "nb", "more", "less"])

    ends = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    wanted = nodes.join(ends, "nid").select(F.col("nid").alias("id"), "mark")
    d = documents(docs)
    text = d.join(wanted, same_document(d, wanted)).select(d["id"].alias("nid"), d["text"].cast("binary").alias("text")).dropDuplicates(["nid"])
    # A center with many pairs is dealt out in shares of some PAIRS_A_SHARE pairs, each with the center's text.
    shares = pairs.groupBy("a").agg((1 + F.floor(F.count("*") / PAIRS_A_SHARE)).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    with_b = dealt.join(text.select(F.col("nid").alias("b"), F.col("text").alias("tb")), "b")
    of_a = text.select(F.col("nid").alias("a"), F.col("text").alias("ta")).join(shares, "a").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    both = with_b.join(of_a, ["a", "share"]).select("a", "b", "ta", "tb")
    kind = dict(pairs.dtypes)["a"]
    return both.mapInPandas(compare, f"a {kind}, b {kind}, common long, na long, nb long, more array<long>, less array<long>")


def _linked(similarity: int) -> Column:
    return 100 * F.col("common") >= similarity * (F.col("na") + F.col("nb") - F.col("common"))


def _may_link(similarity: int) -> Column:
    """False for x and y that cannot be linked, from what each has of, besides and not of the same center.

    They share at most what the center has less what either lacks (but for what both lack), and besides
    that what both have more. Two sets share at most the bits that both bit sets have, and the elements
    that fell on a bit of their own set already taken.
    """

    def at_most(name: str, nx: Column, ny: Column) -> Column:
        both = sum((F.bit_count(F.get(f"x_{name}", F.lit(i)).bitwiseAND(F.get(f"y_{name}", F.lit(i)))) for i in range(SET_WORDS)), F.lit(0))
        return F.least(nx, ny, both + nx - F.col(f"x_{name}_bits"), both + ny - F.col(f"y_{name}_bits"))

    less_x, less_y = F.col("x_size") - F.col("x_common"), F.col("y_size") - F.col("y_common")
    more_x, more_y = F.col("x_n") - F.col("x_common"), F.col("y_n") - F.col("y_common")
    most = F.least("x_common", "y_common")
    of_center = F.least(most, F.col("x_size") - less_x - less_y + at_most("less", less_x, less_y))
    enough = lambda shared: (100 + similarity) * shared >= similarity * (F.col("x_n") + F.col("y_n"))
    return enough(most + F.least(more_x, more_y)) & enough(of_center + at_most("more", more_x, more_y))


def groups(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """(id, mark, n, component_id) of every document: the smallest id reachable over links.

    Documents are linked if their shingle sets have at least `similarity` percent in common, exactly; the
    bands only propose pairs. Documents of equal words are one node. In a band bucket every node is
    compared with the bucket's center, the node that shares most buckets with others, which is linear and
    joins most groups. Buckets whose nodes are then still of several groups are gone through for pairs
    across groups. What both have of the center, and what they have besides, bounds what they can share,
    so only pairs that may be linked are compared on the full sets; none that is linked is left out.

    Documents without words or without an id are linked with nothing; their component is their own id.
    Repeated rows share one answer. Rows that repeat an id with another text are linked by their own text.
    """
    signed = checkpoint(signatures(docs, shingle))
    nodes = checkpoint(
        signed.filter(F.col("id").isNotNull() & (F.col("n") > 0))
        .groupBy("key")
        .agg(F.min(F.struct("id", "mark")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
        .select("key", F.col("first.id").alias("nid"), F.col("first.mark").alias("mark"), "n", "bands", "copies")
    )
    buckets = nodes.select(F.explode("bands").alias("bucket"), "nid", "n")
    several = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    held = checkpoint(salted_join(buckets, several, ["bucket"], F.col("nid")))
    weight = held.groupBy("nid").agg(F.sum("members").alias("weight"))
    centers = held.join(weight, "nid").groupBy("bucket").agg(F.max(F.struct("weight", "nid")).alias("c")).select("bucket", F.col("c.nid").alias("center"))
    members = checkpoint(salted_join(held.drop("members"), centers, ["bucket"], F.col("nid")))
    stars = members.filter(F.col("nid") != F.col("center")).select(F.col("center").alias("a"), F.col("nid").alias("b")).distinct()
    first = checkpoint(_confirm(stars, nodes, docs, shingle))
    links = first.filter(_linked(similarity)).select("a", "b")
    labels = components(links)

    # Pairs across groups, in the buckets that hold several.
    comp = members.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    open_buckets = comp.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(F.col("lo") < F.col("hi")).select("bucket")
    bits = lambda name: sum((F.bit_count(F.get(name, F.lit(i))) for i in range(SET_WORDS)), F.lit(0)).alias(f"{name}_bits")
    compared = first.select(F.col("a").alias("center"), F.col("b").alias("nid"), F.col("na").alias("size"), "common", "more", "less", bits("more"), bits("less"))
    side = checkpoint(salted_join(comp, open_buckets, ["bucket"], F.col("nid"), "left_semi").join(compared, ["center", "nid"]).drop("center"))
    x, y = (side.select("bucket", *[F.col(c).alias(f"{p}_{c}") for c in side.columns if c != "bucket"]) for p in "xy")
    across = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("x_comp") < F.col("y_comp")) & _may_link(similarity))
    pairs = across.select(F.least("x_nid", "y_nid").alias("a"), F.greatest("x_nid", "y_nid").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = checkpoint(pairs.join(done, ["a", "b"], "left_anti"))
    more = checkpoint(_confirm(pairs, nodes, docs, shingle).filter(_linked(similarity)).select("a", "b"))
    if not more.isEmpty():
        labels = components(links.union(more))

    joined = nodes.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("key", "nid", "copies", F.coalesce("comp", "nid").alias("comp"))
    shared = joined.filter((F.col("copies") > 1) | (F.col("comp") != F.col("nid"))).select("key", "comp")
    return salted_join(signed.select("id", "mark", "n", "key"), shared, ["key"], F.struct("id", "mark"), "left").select(
        "id", "mark", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("comp", "id")).otherwise(F.col("id")).alias("component_id")
    )


def digest(docs: DataFrame, shingle: int = 4, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept names the one that stays of a group."""
    return groups(docs, shingle, similarity).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def dedup(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """`docs` with one document of each group, the one with the smallest id; documents without id or words stay."""
    gone = groups(docs, shingle, similarity).filter(F.col("id") != F.col("component_id")).select("id", "mark").distinct()
    rows = whole_rows(docs)
    return rows.join(gone, same_document(rows, gone), "left_anti").select("row.*")


#: The definition itself: all pairs of documents that share a shingle, and a walk over their links.
DIGEST_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words
), shingles AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM sets d JOIN least USING (doc_id)
"""
