"""Global shuffle into shards as a two-pass external shuffle.

Pass one scatters the records uniformly into buckets of a bounded number of bytes by a
seeded hash. Pass two gives each bucket a Fisher-Yates permutation, drawn by Spark's
shuffle() over the bucket's positions (never over its texts), and records take their
permuted places. Buckets laid end to end are then one random order of all records, which
is cut into shards whose row counts differ by at most one.

Records cross the network once, by bucket: the permutations are joined on the same key
and the rank inside a bucket is a spilling sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.llm.common import pieces_of, stored


def shuffle_into_shards(docs: DataFrame, shards: int, *, seed: int = 17, bucket_bytes: int = 32 << 20, task_bytes: int = 64 << 20, text_col: str = "text", is_stored: bool = False) -> DataFrame:
    """docs with two more columns: shard (0 to shards - 1) and slot (its place there, gapless from 0).

    Any columns are kept; shard and slot replace columns of those names. Records are scattered by their numbers in a stored table, so
    nulls, ties, very long texts and rows repeated ever so often are dealt as evenly as any. `is_stored` says that docs are the plain rows of a table: else
    they are written to one first, as numbers must be the same if a task is run again. No
    records give no rows; fewer records than shards leave the last shards empty.
    The order depends on the seed, the table and how its files are split for reading: written once, it is kept. One row a bucket, two numbers, is summed up in one task.
    """
    docs = docs.drop("shard", "slot")
    if not is_stored:
        docs = stored(docs, "records")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    size = total["bytes"] + 64 * total["rows"]
    buckets = pieces_of(size, bucket_bytes)
    # Several buckets to a task, but no fewer tasks than any shuffle has.
    tasks = max(pieces_of(size, task_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = docs.withColumn("_number", F.monotonically_increasing_id())
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_number"), F.lit(buckets))
    keyed = numbered.withColumn("_bucket", bucket).withColumn("_mix", F.xxhash64(F.lit(seed + 1), "_number"))

    # One row a bucket: how many records lie in it and before it.
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n"))
    sizes = stored(sizes, "buckets")
    # The permutations: as shuffle() draws numbers row by row, its rows are put in order first.
    orders = sizes.repartition(tasks, "_bucket").sortWithinPartitions("_bucket")
    orders = orders.select("_bucket", "_before", F.shuffle(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), seed).alias("_order"))

    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_mix", "_number")) - 1
    placed = keyed.repartition(tasks, "_bucket").withColumn("_rank", rank).join(orders.hint("merge"), "_bucket")
    place = F.col("_before") + F.element_at("_order", F.col("_rank") + 1)
    # The first `extra` shards hold one record more than the others.
    base, extra = divmod(total["rows"], shards)
    head = extra * (base + 1)
    shard = F.when(F.col("_place") < head, F.expr(f"_place div {base + 1}")).otherwise(F.expr(f"{extra} + (_place - {head}) div {max(base, 1)}"))
    slot = F.when(F.col("_place") < head, F.col("_place") % (base + 1)).otherwise((F.col("_place") - head) % max(base, 1))
    return placed.withColumn("_place", place).select(*docs.columns, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, *, files: int | None = None) -> None:
    """Write the records, in the order of their slots, under path/shard=N: `files` ranges in all (by default as many as shuffles have
    partitions), so a large shard is several files whose names follow its slots, written by as many tasks."""
    files = files or int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
