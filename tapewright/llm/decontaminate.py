"""Benchmark decontamination by word windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.llm.common import ascii_lower, documents, salted_join, same_document, whole_rows, with_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Distinct windows that are broadcast at most; with more, windows are matched by a shuffle.
MAX_BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(words: str, at: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(at) + 1 if isinstance(at, int) else at + 1, length), " ")


def _gram_hash(hashes: str, at: Column, length: int) -> Column:
    """Hash of `length` word hashes from `at` on; plain columns, so it stays in generated code."""
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(length)])


def _positions(items: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """One row per window start and length: keep ..., words, pos, len, h."""
    hashed = items.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hs")).filter(F.size("hs") >= min(lengths))
    starts = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("hs") - min(lengths))).alias("pos"))
    if len(lengths) == 1:
        sized = starts.withColumn("len", F.lit(lengths[0]))
    else:
        sized = starts.withColumn("len", F.explode(F.array(*map(F.lit, lengths)))).filter(F.col("pos") + F.col("len") <= F.size("hs"))
    h = F.coalesce(*[F.when(F.col("len") == n, _gram_hash("hs", F.col("pos"), n)) for n in lengths])
    return sized.select(*keep, "words", "pos", "len", h.alias("h"))


def windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(h, len, gram, items): every distinct window of the items; an item of fewer than n words is one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    long = _positions(items.filter(F.size("words") >= n), [n], ["item_id"]).select("item_id", "h", "len", _gram("words", F.col("pos"), F.col("len")).alias("gram"))
    hs = items.filter(F.size("words") < n).withColumn("hs", F.transform("words", lambda w: F.xxhash64(w)))
    size = F.size("words")
    h = F.coalesce(*[F.when(size == k, _gram_hash("hs", F.lit(0), k)) for k in range(1, n)])
    short = hs.select("item_id", h.alias("h"), size.alias("len"), F.array_join("words", " ").alias("gram"))
    return long.unionByName(short).groupBy("h", "len", "gram").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """(id, mark, spans, items) of documents with hits: word spans [start, stop) and the items found there.

    The windows are broadcast if they are at most `max_broadcast`, which one count over the benchmark
    tells; more are matched by a salted shuffle. Equal hashes are verified on the words themselves.
    """
    w = windows(benchmark, n)
    sizes = {r["len"]: r["count"] for r in w.groupBy("len").count().collect()}  # at most n rows
    if not sizes:
        return documents(docs).filter(F.lit(False)).select("id", "mark", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"), F.lit(None).cast(f"array<{dict(benchmark.dtypes)['item_id']}>").alias("items"))
    d = documents(docs).select("id", "mark", words_of(F.col("text")).alias("words"))
    at = _positions(d, sorted(sizes), ["id", "mark"])
    if sum(sizes.values()) <= max_broadcast:
        found = at.join(F.broadcast(w), ["h", "len"]).filter(_gram("words", F.col("pos"), F.col("len")) == F.col("gram"))
    else:
        grams = at.select("id", "mark", "pos", "len", "h", _gram("words", F.col("pos"), F.col("len")).alias("gram"))
        found = salted_join(grams, w, ["h", "len", "gram"], F.col("mark"))
    return (
        found.select("id", "mark", F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop")).alias("span"), "items")
        .groupBy("id", "mark")
        .agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )


def _covered(spans: str) -> Column:
    """Words inside the union of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc, s):
        more = F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], s["stop"]).alias("end"), (acc["total"] + more).alias("total"))

    return F.aggregate(spans, start, add, lambda acc: acc["total"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    Null or empty text has no words and is never contaminated. A document is contaminated if at least
    one in `share` of its words is hit. Items without id hit but are not listed. Repeated rows get the
    same answer; an empty benchmark hits nothing. Text is not shuffled.
    """
    found = hits(docs, benchmark, n)
    d = documents(docs).select("id", "mark", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    hit = F.coalesce(_covered("spans"), F.lit(0)).cast("long")
    names = F.coalesce(F.array_sort(F.transform("items", lambda i: i.cast("string"))), F.array().cast("array<string>"))
    out = d.join(found, same_document(d, found), "left").select(
        d["id"].alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, mode: str = "documents") -> DataFrame:
    """`docs` without contaminated documents, or with mode "spans" without the hit words of any document.

    Documents without hits come back unchanged, null texts included.
    """
    found = hits(docs, benchmark, n)
    rows = whole_rows(docs)
    joined = rows.join(found, same_document(rows, found), "left")
    if mode == "documents":
        n_hit = F.coalesce(_covered("spans"), F.lit(0))
        bad = F.when(n_hit > 0, share * n_hit >= F.size(words_of(F.col("text")))).otherwise(F.lit(False))
        return joined.filter(~bad).select("row.*")
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    words = F.regexp_extract_all("text", F.lit(CASED_WORD), F.lit(0))
    gaps = F.split("text", CASED_WORD, -1)
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1))))
    stay = joined.withColumn("words", words).withColumn("gaps", gaps).withColumn("keep", F.array_except(F.sequence(F.lit(0), F.size("words") - 1), gone))
    text = F.concat(F.get("gaps", F.lit(0)), F.array_join(F.transform("keep", lambda i: F.concat(F.get("words", i), F.get("gaps", i + 1))), ""))
    new = F.when(F.col("spans").isNull(), F.col("row")["text"]).otherwise(text)
    return stay.select(*with_text(docs, "row", new))


REPORT_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i + 1 : i + least(len(ws), 13)], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 12, 1))) AS i FROM items WHERE len(ws) > 0)
), lens AS (
  SELECT DISTINCT n FROM win
), spots AS (
  SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM words, lens WHERE len(ws) >= n)
), hit AS (
  SELECT a.doc_id, a.i, a.n, w.item_id FROM spots a JOIN win w ON a.gram = w.gram AND a.n = w.n
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words LEFT JOIN cover USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
