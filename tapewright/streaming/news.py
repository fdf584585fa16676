"""Streaming news: the batch rule of the gates, batch by batch, against what was kept before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewright.functions.durable import checkpoint
from tapewright.functions.text import is_roundup, title_fingerprint, url_id
from tapewright.operators.news import first_wins
from tapewright.streaming.run import each_batch


def dedup_stream(spark: SparkSession, articles: DataFrame, path: str, ttl_ms: int | None = None, order: str = "order") -> None:
    """Append to `path`/kept the articles whose URL and title no kept earlier article has.

    Only kept articles leave their keys behind, so one that loses by its title does not block its URL.
    Within a micro-batch the earliest in `order` wins, as in the batch operator. Kept keys older than
    `ttl_ms` before the batch's newest article are forgotten, if that is given. A replayed batch
    replaces its own rows.
    """

    def run(batch_df: DataFrame, batch: int) -> None:
        a = batch_df.filter(~is_roundup("title")).withColumn("url_id", url_id("url")).withColumn("title_fp", title_fingerprint("title"))
        a = checkpoint(a)
        try:
            kept = spark.read.parquet(f"{path}/kept").filter(F.col("batch_id") < batch)
            if ttl_ms is not None:
                newest = a.agg(F.max("published_ms")).first()[0]
                kept = kept.filter(F.col("published_ms") >= (newest or 0) - ttl_ms)
            a = a.join(kept.select("url_id").distinct(), "url_id", "left_anti").join(kept.select("title_fp").distinct(), "title_fp", "left_anti")
        except Exception as e:  # noqa: BLE001 - the first batch finds no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        first_wins(a, order).write.mode("overwrite").parquet(f"{path}/kept/batch_id={batch}")

    each_batch(articles, path, run)
