"""Live snapshots: carry-forward, ranks and the insert-only subscription set, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewright.functions.ranks import attach_scalars
from tapewright.operators.snapshots import TOP_N, carry_forward, rank_cross_section, top_ranked
from tapewright.streaming.run import each_batch


def _latest_rows(rows: DataFrame) -> DataFrame:
    cols = [c for c in rows.columns if c not in ("date", "ticker")]
    g = rows.groupBy("date", "ticker").agg(F.max_by(F.struct(*cols), "window_ms").alias("_v"))
    return g.select("date", "ticker", "_v.*").select(*rows.columns)


def process_stream(spark: SparkSession, stream: DataFrame, path: str, top_n: int = TOP_N) -> None:
    """Rank every arriving window over all tickers seen before on its date, and record first entries.

    The state between batches is one row per ticker of the newest date: its newest row and whether its first entry is
    recorded. A batch reads what the batch before it wrote and writes the other of two folders, so the state does not grow
    with the batches, a restart resumes from it, and a replayed batch finds its input unchanged and replaces its own output.
    Ranks and entries are written per batch under `path`; what arrived stays there until the next batch.
    """

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}")

    def run(batch_df: DataFrame, batch: int) -> None:
        write(batch_df, "arrived")  # read from the source once, used by every table below
        batch_df = spark.read.schema(batch_df.schema).parquet(f"{path}/arrived")
        cols = batch_df.columns
        fresh = batch_df.withColumn("entered", F.lit(False))
        state = spark.read.schema(fresh.schema).parquet(f"{path}/state/{(batch - 1) % 2}") if batch else fresh.limit(0)
        rows = state.select(*cols).unionByName(batch_df)
        # Carried rows are needed at the arrived windows only; the prior rows seed them.
        filled = carry_forward(rows, batch_df)
        ranked, entries = rank_cross_section(filled), f"entries/batch_id={batch}"
        write(ranked, f"ranked/batch_id={batch}")
        # What is written is read again, so a batch is carried forward and ranked once.
        ranked = spark.read.schema(ranked.schema).parquet(f"{path}/ranked/batch_id={batch}")
        first = top_ranked(ranked, top_n).groupBy("date", "ticker").agg(F.min("window_ms").alias("first_entry_ms"))
        known = state.filter("entered").select("date", "ticker")
        write(first.join(known, ["date", "ticker"], "left_anti"), entries)
        entered = spark.read.schema(first.schema).parquet(f"{path}/{entries}")
        newest = attach_scalars(rows, rows.agg(F.max("date").alias("_d"))).filter(F.col("date") == F.col("_d")).drop("_d")
        marks = known.unionByName(entered.select("date", "ticker")).distinct().withColumn("_e", F.lit(True))
        write(_latest_rows(newest).join(marks, ["date", "ticker"], "left").select(*cols, F.coalesce("_e", F.lit(False)).alias("entered")), f"state/{batch % 2}")

    each_batch(stream, path, run)
