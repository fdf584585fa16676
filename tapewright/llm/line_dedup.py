"""Line deduplication: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapewright.llm.common import SPACES, ascii_lower, documents, salted_join, same_document, whole_rows, with_text


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lines, shared): every long line as (id, mark, pos, k1, k2), and (k1, k2, last) of those in `min_docs` documents.

    A key is the line without white space at its ends, A-Z in lower case, kept as 128 bits of hash. A key is counted once per document before its documents are counted, and
    both counts start on the map side.
    """
    stripped = F.transform(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)))
    keys = F.transform(stripped, ascii_lower)
    lines = (
        documents(docs)
        .filter(F.length("text") >= min_chars)
        .select("id", "mark", F.posexplode(keys).alias("pos", "key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "mark", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), "key").alias("k2"))
    )
    shared = (
        lines.groupBy("k1", "k2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= min_docs).select("k1", "k2", "last")
    )
    return lines, shared


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(row, id, n_lines, n_dropped, kept): `row` holds the columns of `docs`, `kept` the lines that stay.

    Keys of at least `min_chars` code points found under at least `min_docs` distinct ids lose their lines
    everywhere but in the largest id. Null or empty text is one empty line. A null id is no document for
    the count and never keeps a shared line. Repeated rows lose the same lines. Lines of one key are
    spread over several tasks; text is shuffled once, by document, to put the lines together again.
    """
    lines, shared = shared_lines(docs, min_chars, min_docs)
    dropped = (
        salted_join(lines, shared, ["k1", "k2"], F.col("mark"))
        .filter(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("id", "mark")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    rows = whole_rows(docs)
    all_lines = F.split("text", "\n", -1)
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    return (
        rows.join(dropped, same_document(rows, dropped), "left")
        .select(rows["id"], "row", "text", "dropped", all_lines.alias("lines"))
        .select(
            "row",
            "id",
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform(kept_at, lambda i: F.get("lines", i)), "\n"))
            .alias("kept"),
        )
    )


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    return drop_shared_lines(docs).select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def clean(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with the shared lines gone from their texts (a null text comes back empty)."""
    return drop_shared_lines(docs, min_chars, min_docs).select(*with_text(docs, "row", F.col("kept")))


DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
  )
), shared AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.last AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
