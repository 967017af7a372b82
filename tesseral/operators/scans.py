"""Running values along an order within keys, where one key may hold most rows of a table.

A window over a key is one task. Here rows are dealt to ranges of (key, order) instead, so a key with very many rows lies in many ranges; each range is
scanned for itself, and what the ranges of a key before it end with, one row a key and range, is carried into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.operators.lineage import cut

#: Keys with more rows than this are worth ranges of their own.
HOT_ROWS = 1_000_000


def has_hot_key(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> bool:
    """Whether a key has more than so many rows."""
    return not df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).isEmpty()


class Ranges:
    """df dealt to ranges by keys and order, ready to be scanned.

    Ranges are checkpointed, as rows need not come to the same ones when they are dealt out again. Rows equal in keys and order
    are in one range.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]):
        self.keys = list(keys)
        names = [c for c in order if isinstance(c, str)]
        self.order = list(order)
        dealt = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*self.keys, *names]]) if self.keys or names else df
        self.rows = cut(dealt.withColumn("_range", F.spark_partition_id()))
        self._in_range = Window.partitionBy(*self.keys, "_range").orderBy(*self.order)

    def before(self) -> Window:
        """The rows of the range before a row."""
        return self._in_range.rowsBetween(Window.unboundedPreceding, -1)

    def upto(self) -> Window:
        """The rows of the range up to a row."""
        return self._in_range.rowsBetween(Window.unboundedPreceding, 0)

    def carried(self, rows: DataFrame, ends: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        """rows with the columns of `carry`: of what ranges end with (`ends`, aggregates of a range), over the ranges of the key before.

        carry: functions of the columns of `ends` to be taken over a window, such as F.max("_end"); they are null in a key's first range.
        """
        ranges = rows.groupBy(*self.keys, "_range").agg(*[c.alias(n) for n, c in ends.items()])
        before = Window.partitionBy(*self.keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(*self.keys, "_range", *[c.over(before).alias(n) for n, c in carry.items()])
        same = F.col("r._range") == F.col("c._range")
        for k in self.keys:
            same = same & F.equal_null(F.col("r." + k), F.col("c." + k))
        return rows.alias("r").join(ranges.alias("c"), same, "left").select("r.*", *[F.col("c." + n) for n in carry])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """df with each row's place, from 1, among those of its key. Rows equal in `order` are placed in any order."""
    r = Ranges(df, keys, order)
    rows = r.rows.withColumn("_place", F.row_number().over(r._in_range))
    rows = r.carried(rows, {"_n": F.count("*")}, {"_before": F.sum("_n")})
    return rows.withColumn(name, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_range", "_place", "_before")


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """intervals.merge_intervals for keys with very many rows: intervals of a key that overlap or touch, as one. Empty ones are left out."""
    r = Ranges(df.where(F.col(end) > F.col(start)).select(*keys, start, end), keys, [start, end])
    rows = r.rows.withColumn("_far", F.max(end).over(r.before()))
    rows = r.carried(rows, {"_end": F.max(end)}, {"_carried": F.max("_end")})
    # greatest() passes over nulls: there is nothing before a key's first interval.
    far = F.greatest("_far", "_carried")
    rows = rows.withColumn("_first", F.when(far.isNull() | (F.col(start) > far), F.col(start)))
    rows = rows.drop("_carried").withColumn("_island", F.last("_first", ignorenulls=True).over(r.upto()))
    rows = r.carried(rows, {"_last": F.max("_first")}, {"_carried": F.last("_last", ignorenulls=True)})
    rows = rows.withColumn("_island", F.coalesce("_island", "_carried"))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def asof(queries: DataFrame, samples: DataFrame, on: Sequence[str], time: str, sample_time: str) -> DataFrame:
    """joins.asof_join without `within`, for keys with very many rows: queries with the latest sample (columns prefixed with s_) of their key
    that is not later; of samples at one time the greatest row wins."""
    sample = F.struct(*[F.col(c).alias("s_" + c) for c in samples.columns])
    s = samples.select(*on, F.col(sample_time).alias("_t"), F.lit(0).alias("_kind"), sample.alias("_sample"))
    q = queries.select(*on, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*queries.columns).alias("_query"))
    r = Ranges(s.unionByName(q, allowMissingColumns=True), on, ["_t", "_kind", "_sample"])
    rows = r.rows.withColumn("_found", F.last("_sample", ignorenulls=True).over(r.upto()))
    latest = F.max(F.when(F.col("_kind") == 0, F.struct("_t", "_sample")))
    rows = r.carried(rows, {"_latest": latest}, {"_carried": F.last("_latest", ignorenulls=True)})
    found = rows.where("_kind = 1").withColumn("_found", F.coalesce("_found", "_carried._sample"))
    return found.select("_query.*", *[F.col("_found").getField("s_" + c).alias("s_" + c) for c in samples.columns])
