"""Half-open intervals of whole seconds: merging, sweeping, covering by dyadic prefixes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.cells import shr
from tesseral.operators.lineage import kept, spread


def merge_intervals(df: DataFrame, by: Sequence[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Rows of `by`, start, end: overlapping or touching intervals of each key joined; empty ones are dropped."""
    rows = df.where(F.col(end) > F.col(start)).select(*by, start, end)
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def active_sets(df: DataFrame, by: Sequence[str], member: str, start: str = "start_s", end: str = "end_s", *, least: int = 1, merged: bool = False) -> DataFrame:
    """Rows of `by`, start, end, members (sorted), coverage: the elementary segments between a key's
    boundaries, with the set of members active there, if there are `least` or more.

    Members' own intervals are merged first, so each boundary changes the set; with `merged` they are so already, and df is a stored table. Segments
    meet the intervals of their key within buckets of time only, as long as the mean interval, so a key with very many intervals
    is dealt over many groups, and an interval is repeated twice on average. A bucket's intervals are one row that each of its segments
    picks its members from, so pairs of a segment and a member are neither rows nor sorted.
    """
    rows = df.select(*by, member, start, end) if merged else kept(merge_intervals(df, [*by, member], start, end), "intervals")
    width = max(1, math.ceil(rows.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1))
    edges = rows.select(*by, F.col(start).alias("_a")).union(rows.select(*by, end)).distinct()
    segments = edges.withColumn("_b", F.lead("_a").over(Window.partitionBy(*by).orderBy("_a"))).where("_b is not null")
    own = rows.select(*[F.col(c).alias("_k_" + c) for c in by], F.col(member).alias("_member"), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_member is not null")
    own = own.withColumn("_bucket", F.explode(F.sequence(F.expr(f"_s div {width}"), F.expr(f"(_e - 1) div {width}"))))
    own = own.groupBy(*["_k_" + c for c in by], "_bucket").agg(F.sort_array(F.collect_list(F.struct("_member", "_s", "_e"))).alias("_own"))
    test = F.expr(f"_a div {width}") == F.col("_bucket")
    for c in by:
        test = test & F.equal_null(c, "_k_" + c)
    holds = F.filter("_own", lambda i: (i["_s"] <= F.col("_a")) & (F.col("_b") <= i["_e"]))
    found = segments.join(spread(own), test).select(*by, F.col("_a").alias(start), F.col("_b").alias(end), F.transform(holds, lambda i: i["_member"]).alias("members"))
    return found.withColumn("coverage", F.size("members")).where(F.col("coverage") >= least)


def overlap_segments(df: DataFrame, by: Sequence[str], member: str, start: str = "start_s", end: str = "end_s", *, merged: bool = False) -> DataFrame:
    """Elementary segments with two members or more."""
    return active_sets(df, by, member, start, end, least=2, merged=merged)


def attribute_segments(df: DataFrame, by: Sequence[str], member: str, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Longest segments over which a key's set of members stays the same, with one member or more."""
    rows = active_sets(df, by, member, start, end)
    order = Window.partitionBy(*by).orderBy(start)
    new = F.lag(end).over(order).isNull() | (F.lag(end).over(order) != F.col(start)) | (F.lag("members").over(order) != F.col("members"))
    rows = rows.withColumn("_new", new.cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_island", "members", "coverage").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def max_concurrency(df: DataFrame, start: str = "start_s", end: str = "end_s", *, width: int = 3600) -> DataFrame:
    """One row, max_active: the most intervals that are active at once; ends come before starts at the same time.

    The timeline is cut into buckets of `width` seconds. Their sums give what is active when each begins, and
    only then is each bucket swept by itself, so no task holds the whole timeline.
    """
    steps = df.select(F.col(start).alias("t"), F.lit(1).cast("long").alias("d")).union(df.select(F.col(end), F.lit(-1).cast("long")))
    steps = steps.groupBy("t", "d").agg(F.sum("d").alias("change")).withColumn("bucket", F.floor(F.col("t") / width))
    sums = steps.groupBy("bucket").agg(F.sum("change").alias("total"))
    sums = sums.withColumn("before", F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total"))
    swept = steps.join(sums, "bucket")
    order = Window.partitionBy("bucket").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    active = F.sum("change").over(order) + F.col("before")
    return swept.select(active.alias("active")).agg(F.greatest(F.coalesce(F.max("active"), F.lit(0)), F.lit(0)).cast("long").alias("max_active"))


def dyadic_cover(df: DataFrame, start: str = "start_s", end: str = "end_s", *, zoom: int = 32, out: tuple[str, str] = ("zt", "vt")) -> DataFrame:
    """df with a row (zoom, value) for each prefix of the exact cover of [start, end) in a domain of 2 ** zoom units. Empty intervals give no rows;
    intervals outside the domain fail."""
    inside = (F.col(start) >= 0) & (F.col(end) <= F.lit(1 << zoom))
    checked = df.where(F.col(end) > F.col(start)).withColumn(start, F.when(inside, F.col(start)).otherwise(F.raise_error(F.lit("interval outside the domain")).cast("long")))
    k = F.col("_k")
    # For blocks of 2 ** k let l and r bound the whole blocks inside: if there are any, the first belongs to the
    # cover if l is odd and the last if r is odd; of the largest blocks all do.
    rows = checked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(zoom - 1))))
    left = shr(F.col(start) + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    right = shr(F.col(end), k)
    rows = rows.withColumn("_l", left).withColumn("_r", right).where("_l < _r")
    top = k == zoom - 1
    first = F.when((F.col("_l") % 2 == 1) | (top & (F.col("_l") == 0)), F.col("_l"))
    last = F.when((F.col("_r") % 2 == 1) | (top & (F.col("_r") == 2)), F.col("_r") - 1)
    # In the top layer one block can be both the first and the last.
    rows = rows.withColumn(out[1], F.explode(F.array_distinct(F.array_compact(F.array(first, last)))))
    return rows.withColumn(out[0], (F.lit(zoom) - k).cast("int")).drop("_k", "_l", "_r").select(*df.columns, *out)
