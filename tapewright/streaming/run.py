"""Small runners for bounded streaming jobs and for batch-wise upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tapewright.functions.timewin import latest_by


def stream_parquet(spark: SparkSession, path: str, like: DataFrame, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(like.schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def _to_files(stream: DataFrame, path: str):
    return stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def append_files(stream: DataFrame, path: str) -> None:
    """Process what is available, appending to Parquet files with an exactly-once file sink."""
    _to_files(stream, path).awaitTermination()


def drain_files(stream: DataFrame, path: str) -> None:
    """`append_files` for a query with clock timers, which without new input would have empty batches forever.

    Only batches with input are run; what the timers would emit later stays in the state. A query takes a copy of the
    session when it starts, so the setting is back before the first batch runs and no other query is started under it.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        query = _to_files(stream, path)
    finally:
        conf.set(key, before)
    query.awaitTermination()


def each_batch(stream: DataFrame, path: str, fn: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def in_stages(spark: SparkSession, parts: Sequence[DataFrame], path: str, run: Callable[[DataFrame], None]) -> None:
    """Feed row sets one after the other: each is written in parallel, then `run` processes what is new and ends.

    `run` keeps one checkpoint, so every stage resumes where the one before stopped.
    """
    for p in parts:
        p.write.mode("append").parquet(f"{path}/in")
        run(stream_parquet(spark, f"{path}/in", p))


def upsert_files(stream: DataFrame, path: str) -> None:
    """Update mode: each batch's changed rows under its own batch number; a replayed batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch}")

    each_batch(stream, path, write, "update")


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version per key of an upsert folder."""
    return latest_by(spark.read.parquet(f"{path}/data"), keys, ["batch_id"]).drop("batch_id")
