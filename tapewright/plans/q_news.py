"""News operators over titles, texts and pages of the given tables."""

from pyspark.sql import functions as F

from tapewright.functions import session as S, text as X
from tapewright.operators import news as N
from tapewright.plans.ctes import fragment
from tapewright.plans.registry import query

# The title is a document's first line, with the prefixes and summary titles aggregators produce.
_TITLE = """CASE source WHEN 'src1' THEN 'UPDATE: ' || line WHEN 'src2' THEN 'Breaking | ' || line WHEN 'src3' THEN 'UPDATE ' || line
  WHEN 'src4' THEN CAST(doc_id AS VARCHAR) || ' Energy Stocks Moving In ' || line WHEN 'src5' THEN 'Top Gainers ' || line WHEN 'src6' THEN 'Pre-Market movers: ' || line ELSE line END"""
fragment(
    "news",
    f"""SELECT doc_id, 'T' || CAST(doc_id % 150 AS VARCHAR) AS symbol, 1704067200000 + (doc_id * 7919 * 60000) % 2592000000 AS published_ms, {_TITLE} AS title,
      'https://' || source || '/' || CAST(n_chars AS VARCHAR) AS url, source, text, lang FROM (SELECT *, string_split(text, chr(10))[1] AS line FROM documents)""",
)


def news(t):
    d = t.read("documents")
    line = F.split("text", "\n", 2)[0]
    src = F.col("source")
    title = (
        F.when(src == "src1", F.concat(F.lit("UPDATE: "), line)).when(src == "src2", F.concat(F.lit("Breaking | "), line)).when(src == "src3", F.concat(F.lit("UPDATE "), line))
        .when(src == "src4", F.concat(F.col("doc_id").cast("string"), F.lit(" Energy Stocks Moving In "), line)).when(src == "src5", F.concat(F.lit("Top Gainers "), line))
        .when(src == "src6", F.concat(F.lit("Pre-Market movers: "), line)).otherwise(line)
    )
    return d.select(
        "doc_id", F.concat(F.lit("T"), (F.col("doc_id") % 150).cast("string")).alias("symbol"), (F.lit(1_704_067_200_000) + (F.col("doc_id") * 7919 * 60_000) % 2_592_000_000).alias("published_ms"),
        title.alias("title"), F.concat(F.lit("https://"), src, F.lit("/"), F.col("n_chars").cast("string")).alias("url"), "source", "text", "lang",
    )


@query("N1_tag_strip", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS body FROM pages")
def _(t):
    return t.read("pages").select("page_id", X.strip_tags("html").alias("body"))


@query(
    "N1_html_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'),
      '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS body FROM pages""",
)
def _(t):
    return t.read("pages").select("page_id", X.strip_html("html").alias("body"))


@query(
    "N2_unified_articles",
    """SELECT doc_id, symbol, published_ms // 1000 * 1000 AS published_ms, title, url, CASE lang WHEN 'en' THEN 'fmp' WHEN 'de' THEN 'momo' ELSE 'benzinga' END AS source_from,
      md5(CASE WHEN lang IN ('en', 'de') THEN text ELSE trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) END) AS text_md5 FROM news""",
)
def _(t):
    n = news(t).withColumn("title", F.concat_ws("|", F.col("doc_id").cast("string"), "title"))
    ts = F.timestamp_millis("published_ms")
    a = n.filter("lang = 'en'").select("symbol", F.date_format(F.from_utc_timestamp(ts, S.MARKET_ZONE), "yyyy-MM-dd HH:mm:ss").alias("publishedDate"), "title", "text", "url", F.col("source").alias("publisher"))
    b = n.filter("lang = 'de'").select("symbol", F.floor(F.col("published_ms") / 1000).alias("time"), "title", "text", "url", F.col("source").alias("sources"))
    c = n.filter("lang NOT IN ('en', 'de')").select("symbol", F.concat(F.date_format(ts, "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("created"), "title", F.col("text").alias("body"), "url", F.col("source").alias("author"))
    u = N.from_eastern_layout(a).unionByName(N.from_epoch_layout(b)).unionByName(N.from_mail_date_layout(c))
    return u.select(F.split("title", "\\|", 2)[0].cast("long").alias("doc_id"), "symbol", "published_ms", F.split("title", "\\|", 2)[1].alias("title"), "url", "source_from", F.md5("text").alias("text_md5"))


_BARE = "CASE " + " ".join(f"WHEN starts_with(title, '{p}') THEN substr(title, {len(p) + 1})" for p in X.TITLE_PREFIXES) + " ELSE title END"
_NORM = f"trim(regexp_replace(regexp_replace(lower({_BARE}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"
_ROUND = " OR ".join(f"regexp_matches(title, '(?i){p}')" for p in X.ROUNDUP_PATTERNS)
fragment("finger", f"SELECT *, {_NORM} AS normalized, substr(md5({_NORM}), 1, 16) AS title_fp, substr(md5(url), 1, 16) AS url_id, ({_ROUND}) AS roundup FROM news")


@query("N3_title_fingerprint", "SELECT doc_id, normalized, title_fp FROM finger")
def _(t):
    return news(t).select("doc_id", X.normalize_title().alias("normalized"), X.title_fingerprint().alias("title_fp"))


@query("N4_roundup_titles", "SELECT doc_id, title, roundup FROM finger")
def _(t):
    return news(t).select("doc_id", "title", X.is_roundup().alias("roundup"))


DEDUP_SQL = """SELECT doc_id, url_id, title_fp FROM (
      WITH RECURSIVE o AS (SELECT doc_id, url_id, title_fp, row_number() OVER (ORDER BY doc_id) AS i FROM finger WHERE NOT roundup),
        s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS titles, CAST(NULL AS BIGINT) AS kept
          UNION ALL
          SELECT o.i, CASE WHEN list_contains(urls, url_id) OR list_contains(titles, title_fp) THEN urls ELSE list_append(urls, url_id) END,
            CASE WHEN list_contains(urls, url_id) OR list_contains(titles, title_fp) THEN titles ELSE list_append(titles, title_fp) END,
            CASE WHEN list_contains(urls, url_id) OR list_contains(titles, title_fp) THEN NULL ELSE doc_id END FROM s JOIN o ON o.i = s.i + 1)
      SELECT o.doc_id, url_id, title_fp FROM s JOIN o ON o.doc_id = s.kept)"""


@query("N5_dedup_gates", DEDUP_SQL)
def _(t):
    return N.dedup_gates(news(t).withColumn("order", F.col("doc_id"))).select("doc_id", "url_id", "title_fp")


@query("N6_newest_per_symbol", "SELECT doc_id, symbol, published_ms FROM news QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published_ms DESC, doc_id) <= 50")
def _(t):
    return N.newest_per_symbol(news(t), 50, tie="doc_id").select("doc_id", "symbol", "published_ms")


@query(
    "N7_insert_if_absent",
    """WITH inc AS (SELECT url, min(doc_id) AS doc_id FROM news WHERE lang <> 'en' GROUP BY 1) SELECT url, doc_id FROM news WHERE lang = 'en' UNION ALL SELECT url, doc_id FROM inc WHERE url NOT IN (SELECT url FROM news WHERE lang = 'en')""".replace(
        "WITH inc AS (", "SELECT * FROM (WITH inc AS ("
    )
    + ")",
)
def _(t):
    n = news(t).select("url", "doc_id", "lang")
    return N.insert_absent(n.filter("lang = 'en'").drop("lang"), n.filter("lang <> 'en'").drop("lang"), "url")


@query("N7_latest_articles", "SELECT doc_id, published_ms, title FROM news WHERE symbol = 'T7' ORDER BY published_ms DESC, url LIMIT 5")
def _(t):
    return N.latest_articles(news(t), "T7", 5).select("doc_id", "published_ms", "title")


@query("N7_articles_in_window", "SELECT doc_id, symbol FROM news WHERE published_ms BETWEEN 1704700000000 AND 1705300000000")
def _(t):
    return N.articles_in_window(news(t), 1_704_700_000_000, 1_705_300_000_000).select("doc_id", "symbol")


@query(
    "N8_parse_classification",
    "SELECT obs_id, verdict AS classification, CAST(score AS VARCHAR) || '/10' AS score, 'from ' || source AS explanation FROM observations",
)
def _(t):
    o = t.observations()
    js = F.to_json(F.struct(F.lower("verdict").alias("Classification"), F.concat(F.col("score").cast("string"), F.lit("/10")).alias("Score"), F.concat(F.lit("from "), F.col("source")).alias("Explanation")))
    return o.select("obs_id", js.alias("response")).withColumn("p", N.parse_classification()).select("obs_id", "p.classification", "p.score", "p.explanation")


@query("N9_score_number", "SELECT obs_id, CASE WHEN lang = 'en' THEN CAST(score AS INTEGER) ELSE 0 END AS score_num FROM observations")
def _(t):
    o = t.observations().withColumn("s", F.when(F.col("lang") == "en", F.concat(F.col("score").cast("string"), F.lit("/10"))).otherwise("n/a"))
    return o.select("obs_id", N.score_number("s").alias("score_num"))
