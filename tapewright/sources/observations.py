"""Observation sources: functions (spark, path or table, date range) -> observations with a metadata map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapewright.operators.news import score_number

# The field labels of a classifier log record.
RECORD_START = "model: "
FIELDS = {"title": r"Title:(.*)", "published_time": r"Published Time: (.*)", "current_time": r"Current Time: (.*)", "url": r"Url: (.*)", "source_from": r"Source From: (.*)", "content": r"Content: (.*)", "explanation": r"Explanation: (.*)"}
RESULT = r"(\S+) (✅|❌) (.+)"


def _line(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract("value", r"(?m)^" + pattern + r"$", group)


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line classifier log records to observations.

    The record marker is the reader's line separator, so the splits of any file size are parsed in
    parallel and no running record number over the lines is needed.
    """
    raw = spark.read.option("lineSep", "\n" + RECORD_START).text(path)
    r = raw.withColumn("value", F.regexp_replace("value", "^" + RECORD_START, ""))
    meta = {k: F.trim(_line(p)) for k, p in FIELDS.items()}
    meta["source_from"] = F.when(meta["source_from"] == "", "unknown").otherwise(meta["source_from"])
    meta["explanation"] = F.coalesce(F.get_json_object(meta["explanation"], "$.Explanation"), meta["explanation"])
    score = F.trim(_line(RESULT, 3))
    out = r.select(
        F.upper(_line(RESULT, 1)).alias("symbol"),
        F.to_timestamp(F.when(meta["current_time"] != "", meta["current_time"])).alias("trigger_time"),
        (_line(RESULT, 2) == "✅").alias("is_catalyst"),
        score.alias("score"),
        F.regexp_extract("value", r"^(\S+)", 1).alias("model"),
        *[v.alias(k) for k, v in meta.items() if k != "current_time"],
    ).filter((F.col("symbol") != "") & F.col("trigger_time").isNotNull())
    return out.withColumn("score_num", score_number("score")).withColumn("source", F.lit("classifier"))


def classifier_table(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Classification rows of a date range as observations with their metadata as a map."""
    on = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    meta = F.create_map(
        F.lit("score_num"), F.col("score").cast("string"), F.lit("is_catalyst"), (F.col("verdict") == "YES").cast("string"), F.lit("source_from"), F.col("source")
    )
    return rows.filter(on).select("obs_id", "symbol", "trigger_ms", F.lit("classifier").alias("source"), meta.alias("metadata"))


def where_metadata(obs: DataFrame, **equals: object) -> DataFrame:
    """Equality filter on the metadata map."""
    out = obs
    for key, value in equals.items():
        out = out.filter(F.col("metadata")[key] == str(value))
    return out
