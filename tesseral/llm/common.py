"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders made for sessions that name none, by application.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode, and a failure on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own_dirs[app]


#: Rows and bytes in an Arrow batch of whole documents, or one document, if it is longer. A batch lies in memory in the JVM and in the
#: Python worker at once.
TEXTS_PER_BATCH = 250
BYTES_PER_BATCH = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, set to send documents to Python workers in batches of TEXTS_PER_BATCH and BYTES_PER_BATCH."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With it, a query's shuffle files go when the query has ended, and not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again.

    Cuts the lineage and keeps a lost executor from changing what later steps see. What the write shuffled is deleted after it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded(sample: DataFrame, size: Column, most: int) -> DataFrame:
    """Rows of a small table, told apart by the column rank, whose sizes sum up to no more than `most`: in the order of rank, rows of more
    than a 64th of `most` behind all others. A row that is larger than `most` is passed over; of the others the first is always there."""
    sizes = sample.select("rank", size.cast("long").alias("_size")).where(F.col("_size") <= most)
    upto = F.sum("_size").over(Window.orderBy(F.col("_size") > most // 64, "rank").rowsBetween(Window.unboundedPreceding, 0))
    # Two numbers a row go through the window, and the ranks, of a sample bounded by its number of rows, to all tasks.
    fitting = sizes.withColumn("_upto", upto).where(F.col("_upto") <= most).select("rank")
    return sample.join(F.broadcast(fitting), "rank", "left_semi")


def salt(n: int, *cols: Column | str) -> Column:
    """A number from 0 to n - 1 that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def pieces_of(rows: int, size: int) -> int:
    """How many parts of about `size` rows hold `rows` rows; at least 1."""
    return max(1, math.ceil(rows / size))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
