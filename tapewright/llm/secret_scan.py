"""Secrets in texts, judged by who else has them, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.llm.common import documents, salted_join, same_document

#: (kind, pattern, group of the secret, least length of that group). Fixed values for the first three; the rest are
#: public token formats that are kept only if their owners make them look live. Their runs are possessive and start at a
#: boundary, so that a text is gone through once, whatever it repeats.
BASE_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}+", 0, 32),
]
ADDED_KINDS = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", 0, 15),
    ("live_key", r"[sr]k_live_[A-Za-z0-9]{16,}+", 0, 24),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30),
    ("url_login", r"://[A-Za-z0-9._-]++:([^\s:@/]{6,}+)@", 1, 6),
    ("pem", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}+-----END", 0, 32),
]
KINDS = BASE_KINDS + ADDED_KINDS

#: A value in at least this many owners' texts, or in this many different texts, is an example that was copied.
EXAMPLE_OWNERS, EXAMPLE_DOCUMENTS = 3, 10

#: Values with fewer different characters are placeholders.
LEAST_DISTINCT_CHARS = 6


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(id, mark, owner, kind, rank, start, stop, value): all matches, leftmost and non-overlapping in each kind.

    A text is cut at its matches, so each start is the length of what comes before: a running sum over the
    matches of one kind in one document. Offsets are code points, `stop` is exclusive.
    """
    d = documents(docs, F.col(owner).alias("owner"))
    found = []
    for rank, (kind, pattern, group, _) in enumerate(KINDS):
        all_of = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        values = all_of if group == 0 else F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        parts = F.arrays_zip(F.transform(F.split("text", pattern, -1), F.length).alias("gap"), all_of.alias("match"), values.alias("value"))
        here = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), parts.alias("parts"))
        found.append(F.when(F.col("text").rlike(pattern), here))
    cut = d.select("id", "mark", "owner", F.explode(F.array_compact(F.array(*found))).alias("k"))
    rows = cut.select("id", "mark", "owner", "k.kind", "k.rank", F.posexplode("k.parts").alias("pos", "p")).filter(F.col("p.match").isNotNull())
    # Repeated rows give each match once.
    rows = rows.select("id", "mark", "owner", "kind", "rank", "pos", F.col("p.gap").alias("gap"), F.length("p.match").alias("size"), F.col("p.value").alias("value")).distinct()
    before = Window.partitionBy("id", "mark", "owner", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("size")).over(before)
    least = F.coalesce(*[F.when(F.col("rank") == i, k[3]) for i, k in enumerate(KINDS)])
    return rows.withColumn("stop", stop).filter(F.length("value") >= least).select("id", "mark", "owner", "kind", "rank", (F.col("stop") - F.col("size")).alias("start"), "stop", "value")


def ownership(found: DataFrame) -> DataFrame:
    """(h1, h2, n_repositories, n_owners) of every candidate value; a document counts as a repository, exact copies as one.

    A document without an owner is its own. Pairs are made distinct before they are counted, so a value that is
    everywhere is counted in parts.
    """
    owner = F.struct("owner", F.when(F.col("owner").isNull(), F.col("mark")))
    return found.groupBy("h1", "h2").agg(F.count_distinct("mark").alias("n_repositories"), F.count_distinct(owner).alias("n_owners"))


def judged(docs: DataFrame, owner: str = "source") -> DataFrame:
    """The candidates with n_repositories, n_owners and `verdict`: example, placeholder or live."""
    found = candidates(docs, owner).withColumn("h1", F.xxhash64("value")).withColumn("h2", F.xxhash64(F.lit(7), "value"))
    variety = F.size(F.array_distinct(F.split("value", "")))
    verdict = (
        F.when((F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_DOCUMENTS), "example").when((variety < LEAST_DISTINCT_CHARS) | F.lower("value").rlike("example|changeme|dummy|x{4}"), "placeholder").otherwise("live")
    )
    return salted_join(found, ownership(found), ["h1", "h2"], F.struct("id", "mark")).withColumn("verdict", verdict).drop("h1", "h2")


def digest(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of every document.

    Base spans are all reported; the added kinds only where ownership makes them live. Null or empty text
    has no spans. A document of null owner is its own owner. Repeated rows share one answer.
    """
    names = [k for k, *_ in BASE_KINDS]
    base = F.col("rank") < len(BASE_KINDS)
    shown = judged(docs, owner).filter(base | (F.col("verdict") == "live")).select("id", "mark", "kind", "rank", "start", "stop", "verdict").distinct()
    span = F.struct("start", "rank", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string")).alias("name"))

    def joined(which: Column | None) -> Column:
        spans = F.array_sort(F.collect_set(span if which is None else F.when(which, span)))
        return F.array_join(F.transform(spans, lambda s: s["name"]), ",")

    per = shown.groupBy("id", "mark").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in names],
        joined(base).alias("base"), joined(None).alias("all"),
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"),
    )
    d = documents(docs).select("id", "mark")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return d.join(per, same_document(d, per), "left").select(
        d["id"].alias("doc_id"), *[zero(f"n_{k}") for k in names],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("all", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"),
    )
