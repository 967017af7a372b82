"""Cutting the lineage of loops."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for sessions that name none, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is named, a temporary one where driver and executors are one process,
    while a cluster fails."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return _own[app]


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged, never sent whole through the driver.

    Spark tells the size of a table that explode has made, checkpoints of it too, from the few rows that were exploded, and broadcasts it if they are small.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str, rows: int = 64) -> DataFrame:
    """df dealt by its keys to tasks of about `rows` rows each, before each row becomes very many: few rows lie in one file, and one task would make them all."""
    return df.repartition(max(1, math.ceil(df.count() / rows)), *keys)


#: With it, a query's shuffle files go when the query has ended, and not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: smaller than a checkpoint, and what the write shuffled is deleted after it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
