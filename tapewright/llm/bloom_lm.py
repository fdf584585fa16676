"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.durable import shared_folder
from tapewright.llm.common import documents

#: Base of the count levels, hash functions and bits of each key in the filter.
LEVEL_BASE, HASHES, BITS_PER_KEY = 1.5, 6, 10

#: Text bytes of a chunk of documents.
CHUNK_TEXT = 2 << 20

#: Bytes of a block of the filter, about, and text bytes that give a byte of filter; no block is made for less text than the last.
MAX_FILTER_BYTES, TEXT_OF_FILTER, LEAST_BLOCK_TEXT = 1 << 20, 6, 16 << 10

ANSWERS = "chunk long, block long, counts binary, levels binary, total long, distinct long, again long"


def training(doc_id: Column) -> Column:
    """True for documents to learn from: crc32 of the id as text, mod 7, is not 2; ids that are null are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(True))


def _keys(text: bytes):
    """(unigrams, bigrams) of a text as 64-bit keys; the end is the last token and stands before the first."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    from tapewright.llm.shingles import mix

    words = text.lower().split()
    h = np.empty(len(words) + 1, np.uint64)
    h[:-1] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    h[-1] = xxh3_64_intdigest(b"")
    uni = h & ~np.uint64(1)
    before = np.concatenate([uni[-1:], uni[:-1]])
    return uni, mix(before * np.uint64(0x9E3779B97F4A7C15) + uni) | np.uint64(1)


def _block(keys, blocks: int):
    """The block of each key, from its lower bits."""
    import numpy as np

    return (keys >> np.uint64(1)) % np.uint64(blocks)


def _probes(keys, level: int, bits: int | object):
    """Bit positions, HASHES for each key at a level, within blocks of `bits`."""
    import numpy as np

    from tapewright.llm.shingles import mix

    a = mix(keys + np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    b = mix(a) | np.uint64(1)
    return [(a + np.uint64(i) * b) % bits for i in range(HASHES)]


def level_of(counts):
    """Quantised log of counts: 1 for one, one more for each factor of LEVEL_BASE."""
    import numpy as np

    return 1 + np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_values(top: int = 80):
    """Count that each level stands for: the middle of its whole numbers; 0 for level 0."""
    import numpy as np

    out = [0.0]
    for j in range(1, top + 1):
        lo, hi = math.ceil(LEVEL_BASE ** (j - 1) - 1e-9), math.ceil(LEVEL_BASE**j - 1e-9) - 1
        out.append((lo + max(lo, hi)) / 2)
    return np.array(out)


class LogFrequencyFilter:
    """Blocks of bits; a key is in its block once for each level up to that of its count."""

    def __init__(self, blocks: list[bytes]):
        import numpy as np

        sizes = [len(b) for b in blocks]
        self.bytes = np.frombuffer(b"".join(blocks), np.uint8)
        self.start = np.cumsum([0, *sizes])[:-1].astype(np.uint64) * np.uint64(8)
        self.bits = np.array(sizes, np.uint64) * np.uint64(8)

    @staticmethod
    def block(keys, levels) -> bytes:
        """The bits of one block for the keys that are told apart in it."""
        import numpy as np

        total = int(levels.sum())
        size = max(8, -(-total * BITS_PER_KEY // 8))
        bits = np.zeros(size * 8, bool)
        for j in range(1, int(levels.max(initial=0)) + 1):
            for at in _probes(keys[levels >= j], j, np.uint64(size * 8)):
                bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, keys):
        """Level of each key: probes go up until one misses."""
        import numpy as np

        out = np.zeros(len(keys), np.int64)
        block = _block(keys, len(self.bits))
        start, bits, alive, j = self.start[block], self.bits[block], np.arange(len(keys)), 1
        while len(alive):
            here = np.ones(len(alive), bool)
            for p in _probes(keys[alive], j, bits[alive]):
                at = start[alive] + p
                here &= (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            alive = alive[here]
            out[alive] = j
            j += 1
        return out


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, train, sizes, packed, bytes): the documents in chunks of about CHUNK_TEXT bytes, texts joined and compressed."""

    def pack(batches: Iterable) -> Iterable:
        import zlib

        import pandas as pd
        from pyspark import TaskContext

        def out(held: list) -> pd.DataFrame:
            texts = [x[2] for x in held]
            row = (chunk, [x[0] for x in held], [x[1] for x in held], [len(t) for t in texts], zlib.compress(b"".join(texts), 1), sum(map(len, texts)))
            return pd.DataFrame([row], columns=["chunk", "ids", "train", "sizes", "packed", "bytes"])

        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for x in zip(b["id"], b["train"], b["text"]):
                held.append(x)
                size += len(x[2]) + 8
                if size > CHUNK_TEXT:
                    yield out(held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield out(held)

    d = documents(docs).select(F.col("id").cast("string").alias("id"), training(F.col("id")).alias("train"), F.col("text").cast("binary").alias("text"))
    return d.mapInPandas(pack, "chunk long, ids array<string>, train array<boolean>, sizes array<int>, packed binary, bytes long")


def _ngrams(sizes, packed: bytes, blocks: int):
    """(n, keys, cuts, at) of a chunk: tokens of each document, distinct keys by block and where blocks start, and the place in
    `keys` of every unigram and then of every bigram of the chunk."""
    import zlib

    import numpy as np

    text, end = zlib.decompress(packed), np.cumsum(sizes)
    both = [_keys(text[z - n : z]) for n, z in zip(sizes, end)]
    n = np.array([len(u) for u, _ in both])
    keys, at = np.unique(np.concatenate([u for u, _ in both] + [b for _, b in both]), return_inverse=True)
    block = _block(keys, blocks)
    order = np.argsort(block, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return n, keys[order], np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64)), place[at]


def answers(held: DataFrame, blocks: int) -> DataFrame:
    """(chunk, block, counts, levels, total, distinct, again): what each block knows of the n-grams of each chunk.

    A chunk sends its distinct n-grams with their counts in training documents, 0 included, to the blocks that
    their hashes name. A block sums them, fills its bits and probes them for every chunk: `counts` are exact
    for the chunk's unigrams, `levels` come from the filter for its bigrams, both in the order of keys. One row
    of each block has no chunk but the sums of its unigrams and those of its bigrams that occur again.
    """

    def send(batches: Iterable) -> Iterable:
        import numpy as np
        import pandas as pd

        for b in batches:
            for chunk, train, sizes, packed in zip(b["chunk"], b["train"], b["sizes"], b["packed"]):
                n, keys, cuts, at = _ngrams(sizes, packed, blocks)
                learned = np.tile(np.repeat(np.array(train, bool), n), 2)
                count = np.bincount(at[learned], minlength=len(keys)).astype(np.uint32)
                full = np.nonzero(np.diff(cuts))[0]
                parts = [(k, chunk, keys[cuts[k] : cuts[k + 1]].tobytes(), count[cuts[k] : cuts[k + 1]].tobytes()) for k in full]
                yield pd.DataFrame(parts, columns=["block", "chunk", "keys", "counts"])

    def probe(part):
        import numpy as np
        import pandas as pd

        sent = [np.frombuffer(k, np.uint64) for k in part["keys"]]
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([np.frombuffer(n, np.uint32) for n in part["counts"]])).astype(np.int64)
        uni = (keys & np.uint64(1)) == 0
        seen = ~uni & (c > 0)
        lm = LogFrequencyFilter([LogFrequencyFilter.block(keys[seen], level_of(c[seen]))])
        level = np.zeros(len(keys), np.uint8)
        level[~uni] = lm.levels(keys[~uni])
        rows, start = [], 0
        for chunk, own in zip(part["chunk"], sent):
            k = at[start : start + len(own)]
            start += len(own)
            rows.append((chunk, c[k[uni[k]]].tobytes(), level[k[~uni[k]]].tobytes(), 0, 0, 0))
        again = ~uni & (c >= 2)
        rows.append((-1, b"", b"", int(c[uni].sum()), int((c[uni] > 0).sum()), int(c[again].sum())))
        out = pd.DataFrame(rows, columns=["chunk", "counts", "levels", "total", "distinct", "again"])
        out.insert(1, "block", part["block"].iloc[0])
        return out

    sent = held.select("chunk", "train", "sizes", "packed").mapInPandas(send, "block long, chunk long, keys binary, counts binary")
    return sent.groupBy("block").applyInPandas(probe, ANSWERS)


def score(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    base_score adds up the add-one unigram model. `score` mixes a bigram model, with the bigrams' counts from
    the filter, with that unigram model; unigram counts are exact in both. The bigrams' weight is half the
    share of the training tokens whose bigram occurs again. The filter is never gathered: each of its
    blocks, of about `max_filter_bytes`, is filled and probed in one task, and the answers are joined with the
    chunks of documents that asked. So there is one way for every size, and no answer depends on the number of
    blocks but for false positives.

    Null or empty text is the end alone. Repeated rows are learned from and scored each. With nothing to learn
    from all counts are 0.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "lm")
    made = chunks(docs)
    made.write.parquet(f"{folder}/chunks")
    held = spark.read.schema(made.schema).parquet(f"{folder}/chunks")
    size = held.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    blocks = 1 + size // max(LEAST_BLOCK_TEXT, max_filter_bytes * TEXT_OF_FILTER)
    answers(held, blocks).write.parquet(f"{folder}/answers")
    answered = spark.read.schema(ANSWERS).parquet(f"{folder}/answers")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "again")]
    total, distinct, again = answered.filter("chunk < 0").agg(*sums).first()
    weight = again / max(1, 2 * total)
    norm = total + distinct + 1

    def add_up(asked, got):
        import numpy as np
        import pandas as pd

        values = level_values()
        ids, train = asked["ids"].iloc[0], asked["train"].iloc[0]
        n, keys, cuts, at = _ngrams(asked["sizes"].iloc[0], asked["packed"].iloc[0], blocks)
        uni = (keys & np.uint64(1)) == 0
        count = np.zeros(len(keys))
        for k, counts, levels in zip(got["block"], got["counts"], got["levels"]):
            here, is_uni = count[cuts[k] : cuts[k + 1]], uni[cuts[k] : cuts[k + 1]]
            here[is_uni] = np.frombuffer(counts, np.int64)
            here[~is_uni] = values[np.frombuffer(levels, np.uint8)]
        cw, cb = np.split(count[at], 2)
        starts = np.cumsum(n) - n
        cu = np.concatenate([[0.0], cw[:-1]])
        cu[starts] = cw[starts + n - 1]  # the end stands before the first token
        p1 = (cw + 1) / norm
        p = weight * np.minimum(cb, cu) / np.maximum(cu, 1) + (1 - weight) * p1
        known, base, mixed = (np.add.reduceat(x, starts) for x in ((cw > 0).astype(np.int64), np.log10(p1), np.log10(p)))
        return pd.DataFrame({"id": ids, "held_out": ~np.array(train, bool), "n_tokens": n, "n_known": known, "base_score": base, "score": mixed})

    rows = held.select("chunk", "ids", "train", "sizes", "packed").groupBy("chunk").cogroup(answered.filter("chunk >= 0").select("chunk", "block", "counts", "levels").groupBy("chunk"))
    out = rows.applyInPandas(add_up, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
