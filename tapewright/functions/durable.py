"""Cutting lineage in storage that every executor sees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, as in tests, one below the warehouse, in local mode only.

    On a cluster the warehouse may be a folder of the driver's machine, which executors do not see, so the setting must be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_root(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name for `what` below the shared folder."""
    return f"{_shared_root(spark)}/{what}-{uuid.uuid4().hex}"
