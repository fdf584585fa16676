"""From raw documents to packed training sequences: stages that each take the table the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewright.functions.durable import shared_folder
from tapewright.llm import decontaminate, importance, line_dedup, minmax, packing
from tapewright.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.select(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax.dedup(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]

#: The quality model, the min-max components and the packing plan have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is written to shared storage as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
