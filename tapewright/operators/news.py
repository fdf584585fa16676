"""News articles: unified layouts, title filters, deduplication, archive, classifier output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.functions import session as S
from tapewright.functions.durable import checkpoint
from tapewright.functions.text import is_roundup, strip_html, title_fingerprint, url_id

COLUMNS = ["symbol", "published_ms", "title", "text", "url", "sources", "source_from"]


def from_eastern_layout(raw: DataFrame) -> DataFrame:
    """symbol, publishedDate ('yyyy-MM-dd HH:mm:ss' US/Eastern), title, text, url, publisher."""
    et = F.unix_millis(F.to_timestamp("publishedDate", "yyyy-MM-dd HH:mm:ss"))
    return raw.select("symbol", S.et_to_utc_ms(et).alias("published_ms"), "title", "text", "url", F.coalesce("publisher", F.lit("FMP")).alias("sources"), F.lit("fmp").alias("source_from"))


def from_epoch_layout(raw: DataFrame) -> DataFrame:
    """symbol, time (epoch seconds), title, text, url, sources."""
    return raw.select("symbol", (F.col("time") * 1000).alias("published_ms"), "title", "text", "url", F.coalesce("sources", F.lit("Moomoo")).alias("sources"), F.lit("momo").alias("source_from"))


def from_mail_date_layout(raw: DataFrame) -> DataFrame:
    """symbol, created ('Wed, 03 Dec 2025 08:34:03 -0400'), title, HTML body, url, author."""
    ts = F.to_timestamp(F.regexp_replace("created", r"^\w+,\s*", ""), "dd MMM yyyy HH:mm:ss Z")
    return raw.select("symbol", F.unix_millis(ts).alias("published_ms"), "title", strip_html("body").alias("text"), "url", F.coalesce("author", F.lit("Benzinga")).alias("sources"), F.lit("benzinga").alias("source_from"))


def first_wins(articles: DataFrame, order: str = "order", url: str = "url_id", title: str = "title_fp") -> DataFrame:
    """Keep an article unless a kept earlier one has its URL or its title.

    Sequential by definition, computed in rounds: an open article that is the earliest of both its URL
    and its title is kept; everything sharing a key with it is settled. Equal (URL, title) pairs are
    reduced to their first article beforehand, so mass copies never meet, and keys are combined by min()
    on the map side.
    """
    rest = articles.groupBy(url, title).agg(F.min(order).alias("_o"))
    kept = None
    while True:
        rest = checkpoint(rest)
        u = rest.groupBy(url).agg(F.min("_o").alias("_u"))
        t = rest.groupBy(title).agg(F.min("_o").alias("_t"))
        marked = rest.join(u, url).join(t, title)
        won = marked.filter((F.col("_o") == F.col("_u")) & (F.col("_o") == F.col("_t"))).select(url, title, "_o")
        won = checkpoint(won)
        if won.isEmpty():
            break
        kept = won if kept is None else kept.unionByName(won)
        rest = rest.join(won.select(url).distinct(), url, "left_anti").join(won.select(title).distinct(), title, "left_anti")
    if kept is None:
        return articles.limit(0)
    return articles.join(kept.select(F.col("_o").alias(order)), order, "left_semi")


def dedup_gates(articles: DataFrame, order: str = "order") -> DataFrame:
    """Roundup filter, then URL and title gates."""
    a = articles.filter(~is_roundup("title")).withColumn("url_id", url_id("url")).withColumn("title_fp", title_fingerprint("title"))
    return first_wins(a, order)


def newest_per_symbol(articles: DataFrame, n: int = 50, ts: str = "published_ms", tie: str = "url") -> DataFrame:
    """The archive's own retention: the newest n per symbol (also limited before the shuffle)."""
    w = Window.partitionBy("symbol").orderBy(F.desc(ts), tie)
    return articles.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def insert_absent(archive: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Archive plus the incoming rows whose key it lacks, first row per key."""
    others = [c for c in incoming.columns if c != key]
    one = incoming.groupBy(key).agg(F.min(F.struct(*others)).alias("_v")).select(key, "_v.*").select(*incoming.columns)
    return archive.unionByName(one.join(archive.select(key), key, "left_anti"))


def latest_articles(archive: DataFrame, symbol: str, n: int) -> DataFrame:
    return archive.filter(F.col("symbol") == symbol).orderBy(F.desc("published_ms"), "url").limit(n)


def articles_in_window(archive: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return archive.filter((F.col("published_ms") >= start_ms) & (F.col("published_ms") <= end_ms))


def parse_classification(text: str = "response") -> Column:
    """Classifier JSON to (classification, score, explanation) with defaults; null for malformed text."""
    p = F.from_json(text, "Classification string, Score string, Explanation string", {"mode": "PERMISSIVE"})
    ok = F.get_json_object(text, "$").isNotNull()
    return F.when(
        ok,
        F.struct(
            F.upper(F.coalesce(p["Classification"], F.lit("NO"))).alias("classification"),
            F.coalesce(p["Score"], F.lit("0/10")).alias("score"),
            F.coalesce(p["Explanation"], F.lit("")).alias("explanation"),
        ),
    )


def score_number(score: str) -> Column:
    """'7/10' to 7; 0 when it is no number."""
    return F.coalesce(F.split(F.col(score), "/")[0].try_cast("int"), F.lit(0)) if hasattr(Column, "try_cast") else F.coalesce(F.expr(f"try_cast(split({score}, '/')[0] AS INT)"), F.lit(0))
