"""SpotSigs: documents as sets of short chains of content words behind common words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from tapewright.functions.durable import checkpoint
from tapewright.llm.common import documents

#: Common words of four languages that anchor chains (fixed values).
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which with would you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur ne pas par pour que qui sa se son sur un une "
    "als auch auf aus bei das dem den der des die ein eine einem einen einer er es für ich ist mit nach nicht sich sie sind und von werden wie wird zu zum zur "
    "al como con del el ella en entre es esta este la las lo los más no o para pero por se sin su sus un una y"
).split()
CHAIN = 2
#: Of texts without such words, one word of so many is an anchor.
HASHED = 4
#: Ids that cut the ranges where ids are no whole numbers, at most.
SAMPLED_IDS = 20_000
WORD = re.compile(r"[^\W\d_]+")


def signatures(text: str):
    """Sorted distinct 32-bit signatures of a text.

    Each anchor gives one: the anchor and the next CHAIN words that are no anchors, fewer at the end. A text whose common words
    give none (keyword lists, other languages) has anchors that do not depend on any list: the words whose hash is 0 modulo
    HASHED, or every word where there are none, each with the next CHAIN words. Without words it has one of its
    characters; an empty text has none.
    """
    import numpy as np
    from xxhash import xxh3_64_intdigest

    from tapewright.llm.shingles import mix

    words = WORD.findall(text.lower())
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    anchor = np.isin(h, np.fromiter(map(xxh3_64_intdigest, set(ANCHORS)), np.uint64))
    at, content = np.nonzero(anchor)[0], np.nonzero(~anchor)[0]
    nxt = np.searchsorted(content, at)
    held = nxt < len(content)
    at, nxt = at[held], nxt[held]
    if not len(at):
        if not len(h):
            return np.array([xxh3_64_intdigest(text) & 0xFFFFFFFF] if text else [], np.uint32)
        at = np.nonzero(mix(h) % np.uint64(HASHED) == 0)[0]
        at = at if len(at) else np.arange(len(h))
        content, nxt = np.arange(len(h)), at + 1
    sig = mix(h[at])
    chain = np.concatenate([h[content], np.zeros(CHAIN + 1, np.uint64)])
    for j in range(CHAIN):
        sig = mix(sig + chain[nxt + j])
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def likeness(a, b) -> float:
    """Jaccard likeness of two signature sets; 1 for two empty ones."""
    import numpy as np

    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def as_string(sig) -> str:
    return sig.astype(">u4").tobytes().hex()


def _in_order(docs: DataFrame) -> DataFrame:
    """(id, text, bucket, look): documents dealt into ranges of ids, each with a copy of the next one's first as `look`.

    Cuts between ranges are quantiles of the ids, at most one a shuffle partition; the last range looks at
    the first document. Within a task rows are in the order (bucket, look, id, text), null ids first.
    """
    spark = docs.sparkSession
    d = documents(docs).select("id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = d.schema["id"].dataType
    if parts < 2:
        cuts = []
    elif isinstance(kind, IntegralType):
        cuts = [int(c) for c in sorted(set(d.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts)))]
    else:  # of other types, quantiles of a bounded sample, in the order of a hash
        sample = sorted(r[0] for r in d.filter("id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id")).limit(SAMPLED_IDS).collect())
        cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    ids = f"array<{kind.simpleString()}>"
    width = max(1, math.isqrt(len(cuts)))
    coarse = cuts[::width]
    fine = [[]] + [cuts[i + 1 : i + width] for i in range(0, len(cuts), width)]

    def below(edges: Column) -> Column:
        return F.size(F.filter(edges, lambda e: e <= F.col("id")))

    if cuts:
        c = below(F.lit(coarse).cast(ids))
        rows = F.array(*[F.lit(x).cast(ids) if x else F.array().cast(ids) for x in fine])
        bucket = F.when(F.col("id").isNull() | (c == 0), 0).otherwise((c - 1) * width + below(F.get(rows, c)) + 1)
    else:
        bucket = F.lit(0)
    dealt = d.withColumn("bucket", bucket.cast("int"))
    firsts = {r["bucket"]: r for r in dealt.groupBy("bucket").agg(F.min("id").alias("id"), F.bool_or(F.col("id").isNull()).alias("null")).collect()}  # one row a range
    if not firsts:
        return dealt.withColumn("look", F.lit(0))
    order, n = sorted(firsts), max(firsts) + 1
    before = {b: order[i - 1] for i, b in enumerate(order)}
    first_id = F.lit([None if b not in firsts or firsts[b]["null"] else firsts[b]["id"] for b in range(n)]).cast(ids)
    previous = F.lit([before.get(b, 0) for b in range(n)]).cast("array<int>")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("look"))
    copy = F.struct(F.get(previous, F.col("bucket")).alias("bucket"), F.lit(1).alias("look"))
    to = F.when(F.col("id").eqNullSafe(F.get(first_id, F.col("bucket"))), F.array(own, copy)).otherwise(F.array(own))
    return (
        dealt.withColumn("to", F.explode(to)).select("id", "text", "to.bucket", "to.look")
        .repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "look", F.col("id").asc_nulls_first(), "text")
    )


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Documents are in the order of ids, repeated ids in the order of their texts, null ids first; the last is
    followed by the first, a single one by itself. Null text is empty; its fingerprint is the empty
    string. Texts are shuffled once, by ranges of ids; a task holds two documents at a time.
    """

    def compare(batches: Iterable) -> Iterable:
        from hashlib import sha256

        import pandas as pd

        held = None  # id, text, signatures, bucket
        for b in batches:
            out = []
            for i, text, bucket, look in zip(b["id"], b["text"], b["bucket"], b["look"]):
                sig = signatures(text)
                if held is not None and held[3] == bucket:
                    k = len(held[1]) // 4
                    edited = held[1][: len(held[1]) - k] + text[:k]
                    esig = signatures(edited)
                    out.append((held[0], len(held[1]), sha256(edited.encode("utf-8", "replace")).hexdigest(), as_string(held[2]), as_string(esig), likeness(held[2], esig), likeness(held[2], sig)))
                held = None if look else (i, text, sig, bucket)
            if out:
                yield pd.DataFrame(out, columns=[c for c, _ in kinds])

    kinds = [("doc_id", dict(docs.dtypes)["doc_id"]), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    return _in_order(docs).mapInPandas(compare, ", ".join(f"{c} {k}" for c, k in kinds))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, mark, sigs): the signature set of every document."""

    def sign(batches: Iterable) -> Iterable:
        import numpy as np
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"id": b["id"], "mark": b["mark"], "sigs": [signatures(t).astype(np.int64) for t in b["text"]]})

    return documents(docs).mapInPandas(sign, f"id {dict(docs.dtypes)['doc_id']}, mark long, sigs array<long>")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, rep) of every document with signatures, and (a, b, likeness) of representatives.

    Documents of equal sets share the smallest id as representative. Sets are partitioned by length so that
    a partition's longest is 1 / threshold of its shortest; a set meets its own partition and the next.
    Only its rarest signatures are indexed, as many as two sets of that likeness must share one of; a pair
    comes from the rarest shared one only, and is compared in full if its lengths allow the likeness.
    Null ids and empty sets have no partners.
    """
    f = fingerprints(docs).filter(F.col("id").isNotNull() & (F.size("sigs") > 0)).withColumn("h", F.md5(F.array_join("sigs", ",")))
    reps = checkpoint(f.groupBy("h").agg(F.min("id").alias("rep"), F.first("sigs").alias("sigs")))
    members = f.select("id", "h").join(reps.select("h", "rep"), "h").select("id", "rep")
    df = reps.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    ranked = (
        reps.select("rep", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")).join(df, "sig")
        .groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    )
    prefix = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9)
    index = ranked.select("rep", "n", part.alias("part"), F.explode(F.slice("s", F.lit(1), prefix.cast("int"))).alias("x")).select("rep", "n", "part", F.col("x.sig").alias("sig"))
    probe = index.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig", F.col("part").alias("own"))
    hit = probe.join(index.select(F.col("rep").alias("b"), F.col("n").alias("bn"), "part", "sig"), ["part", "sig"])
    one_way = (F.col("own") < F.col("part")) | (F.col("a") < F.col("b"))
    pairs = hit.filter((F.col("a") != F.col("b")) & one_way & (F.least("an", "bn") >= threshold * F.greatest("an", "bn"))).select("a", "b").distinct()
    sets = reps.select("rep", "sigs")
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "sigs": "sa"}), "a").join(sets.withColumnsRenamed({"rep": "b", "sigs": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    like = (common / (F.size("sa") + F.size("sb") - common)).alias("likeness")
    return members, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), like).filter(F.col("likeness") >= threshold)
