"""Joins of cells by prefix, of instants by interval, and as-of.

A predicate like "a's prefixes begin b's" alone would be a nested-loop join. The zoom
vectors that occur in a set of cells are few, though, so the other side is truncated to each of
them and the join becomes an equality of keys. Whether the zoom vectors are few enough to be sent to all
tasks is checked; if not, they are joined like any other table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.cells import AXES, CELL, VALUES, ZOOMS, compatible, meet, truncate
from tesseral.operators.lineage import spread

#: Up to so many zoom vectors are broadcast.
BROADCAST_VECTORS = 10_000
#: Above so many zoom vectors of a side, an overlap join rounds zooms down to steps of one of these sizes.
STEP_VECTORS = 20
STEPS = (1, 2, 3, 4, 6, 8, 16, 32)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def _vectors(df: DataFrame, prefix: str) -> DataFrame:
    """The distinct flags and zooms of df's cells, broadcast if there are few."""
    found = df.select(F.col("flags").alias(prefix + "flags"), *[F.col(z).alias(prefix + z) for z in ZOOMS]).distinct()
    few = found.limit(BROADCAST_VECTORS + 1).count() <= BROADCAST_VECTORS
    return F.broadcast(found) if few else found


def _all(tests: Sequence[Column]) -> Column:
    return reduce(Column.__and__, tests)


def _keyed_below(contained: DataFrame, vectors: DataFrame, strict: bool) -> DataFrame:
    """contained with _k columns: its cells truncated to each container zoom vector that is no finer."""
    fits = [F.col("flags") == F.col("_v_flags"), *[F.col("_v_" + z) <= F.col(z) for z in ZOOMS]]
    if strict:
        fits.append(reduce(Column.__or__, (F.col("_v_" + z) != F.col(z) for z in ZOOMS)))
    keyed = contained.join(vectors, _all(fits))
    return keyed.withColumns({f"_k_v{a}": truncate(F.col(f"v{a}"), F.col(f"z{a}"), F.col(f"_v_z{a}")) for a in AXES})


def _same_key(prefix: str, by: Sequence[str]) -> Column:
    return _all([
        F.col(prefix + "flags") == F.col("_v_flags"),
        *[F.col(prefix + z) == F.col("_v_" + z) for z in ZOOMS],
        *[F.col(prefix + v) == F.col("_k_" + v) for v in VALUES],
        *[F.equal_null(prefix + c, c) for c in by],
    ])


def containment_join(containers: DataFrame, contained: DataFrame, *, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Pairs of a container (columns prefixed with c_) and a cell that it subsumes. With `strict`, cells don't contain themselves.

    `by` names columns, such as a region, that must be equal too.
    """
    keyed = _keyed_below(contained, _vectors(containers, "_v_"), strict)
    pairs = keyed.join(prefixed(containers, "c_"), _same_key("c_", by))
    return pairs.select(*["c_" + c for c in containers.columns], *contained.columns)


def covered(containers: DataFrame, cells: DataFrame, *, by: Sequence[str] = (), strict: bool = False, how: str = "left_semi") -> DataFrame:
    """The rows of `cells` that some container subsumes (left_semi) or none does (left_anti)."""
    keys = [*by, *CELL]
    held = containers.select(*keys).distinct()
    hits = _keyed_below(cells.select(*keys).distinct(), _vectors(held, "_v_"), strict)
    hits = hits.join(prefixed(held, "c_"), _same_key("c_", by), "left_semi").select(*keys).distinct()
    h = prefixed(hits, "_h_")
    return cells.join(h, _all([F.equal_null("_h_" + k, k) for k in keys]), how)


def _step_zoom(zoom: Column, step: int) -> Column:
    """The greatest of the zooms 1, 1 + step, 1 + 2 * step, ... that is no finer; 0 for an absent axis."""
    return F.when(zoom > 0, zoom - (zoom - 1) % step).otherwise(0).cast("int")


def _zoom_step(sides: Sequence[DataFrame], most: int) -> int:
    """The least step of zooms at which both sides have at most `most` zoom vectors; the coarsest step, if none does."""
    steps = list(STEPS)
    for df in sides:
        vectors = df.select("flags", *ZOOMS).distinct()
        if vectors.limit(most + 1).count() <= most:
            continue
        counts = vectors.agg(*[F.countDistinct("flags", *[_step_zoom(F.col(z), s) for z in ZOOMS]).alias(str(s)) for s in steps]).first()
        steps = [s for s in steps if counts[str(s)] <= most] or steps[-1:]
    return steps[0]


def overlap_join(left: DataFrame, right: DataFrame, *, by: Sequence[str] = (), most: int = STEP_VECTORS) -> DataFrame:
    """Pairs of compatible cells, the right one's columns prefixed with r_; each pair once.

    For each two zoom vectors of the sides, both cells are truncated to the coarser zoom of each axis and joined on that. A row is repeated for
    each vector of the other side, so where there are more than `most`, zooms are first rounded down to steps: cells then meet by
    somewhat shorter prefixes, in one place still, and those that are not compatible after all are left out.
    """
    step = _zoom_step((left, right), most)
    rounded = {f"_q_{z}": _step_zoom(F.col(z), step) for z in ZOOMS}
    vectors = lambda df, p: _vectors(df.select("flags", *[_step_zoom(F.col(z), step).alias(z) for z in ZOOMS]), p)
    lv, rv = vectors(left, "_l_"), vectors(right, "_v_")
    r = prefixed(right.withColumns(rounded), "r_")
    a = left.withColumns(rounded).join(rv, F.col("flags") == F.col("_v_flags"))
    b = r.join(lv, F.col("r_flags") == F.col("_l_flags"))
    for x in AXES:
        a = a.withColumn(f"_a_{x}", truncate(F.col(f"v{x}"), F.col(f"z{x}"), F.least(f"_q_z{x}", f"_v_z{x}")))
        b = b.withColumn(f"_b_{x}", truncate(F.col(f"r_v{x}"), F.col(f"r_z{x}"), F.least(f"r__q_z{x}", f"_l_z{x}")))
    same = [F.col("flags") == F.col("r_flags"), *[F.equal_null(c, "r_" + c) for c in by]]
    for x in AXES:
        same += [F.col(f"_q_z{x}") == F.col(f"_l_z{x}"), F.col(f"_v_z{x}") == F.col(f"r__q_z{x}"), F.col(f"_a_{x}") == F.col(f"_b_{x}")]
    pairs = a.join(b, _all(same))
    pairs = pairs.where(compatible("", "r_")) if step > 1 else pairs
    return pairs.select(*left.columns, *["r_" + c for c in right.columns])


def overlap_count(left: DataFrame, right: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """One row: how many pairs of cells are compatible."""
    return overlap_join(left, right, by=by).agg(F.count("*").alias("pairs"))


def meets(left: DataFrame, right: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The distinct intersections of compatible pairs, with the `by` columns."""
    return overlap_join(left, right, by=by).select(*by, *meet("", "r_")).distinct()


def interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], time: str, start: str = "start_s", end: str = "end_s", how: str = "inner") -> DataFrame:
    """Points with the intervals [start, end) of their key that hold their time.

    Long intervals share a key with few others here; where keys have many, intervals and points are first cut
    into time buckets: see bucketed_interval_join.
    """
    i = prefixed(intervals, "i_")
    test = _all([*[F.equal_null(c, "i_" + c) for c in on], F.col("i_" + start) <= F.col(time), F.col(time) < F.col("i_" + end)])
    return points.join(i, test, how)


def bucketed_interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], time: str, width: int, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """interval_join for keys with very many rows: equal keys also need equal buckets of `width` seconds."""
    i = prefixed(intervals, "i_").where(F.col("i_" + end) > F.col("i_" + start))
    first, last = F.floor(F.col("i_" + start) / width), F.floor((F.col("i_" + end) - 1) / width)
    i = i.withColumn("_bucket", F.explode(F.sequence(first, last)))
    p = points.withColumn("_p_bucket", F.floor(F.col(time) / width))
    test = _all([*[F.equal_null(c, "i_" + c) for c in on], F.col("_bucket") == F.col("_p_bucket"), F.col("i_" + start) <= F.col(time), F.col(time) < F.col("i_" + end)])
    return p.join(i, test).drop("_bucket", "_p_bucket")


def dyadic_interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], time: str, start: str = "start_s", end: str = "end_s", how: str = "inner") -> DataFrame:
    """interval_join by equal keys alone: an interval is its dyadic cover, and an instant is looked up by its ancestors.

    Times are whole numbers below 2 ** 32. An interval has at most 62 covering prefixes and an instant one ancestor for each zoom that occurs in them,
    so a key with very many instants and intervals is dealt out by time, and no condition is left to be tried on pairs.
    """
    from tesseral.operators.intervals import dyadic_cover

    cover = dyadic_cover(prefixed(intervals, "i_").withColumn("_id", F.struct(*["i_" + c for c in intervals.columns])).where(F.col("i_" + end) > F.col("i_" + start)), "i_" + start, "i_" + end, zoom=32, out=("_z", "_v"))
    zooms = cover.select("_z").distinct()  # 32 rows at most
    asked = points.join(F.broadcast(zooms.withColumnRenamed("_z", "_p_z"))).withColumn("_p_v", F.call_function("shiftright", F.col(time).cast("long"), (F.lit(32) - F.col("_p_z")).cast("int")))
    test = _all([*[F.equal_null(c, "i_" + c) for c in on], F.col("_p_z") == F.col("_z"), F.col("_p_v") == F.col("_v")])
    found = asked.join(spread(cover), test).select(*points.columns, *["i_" + c for c in intervals.columns])
    if how == "inner":
        return found
    same = _all([F.equal_null(F.col("p." + c), F.col("f." + c)) for c in points.columns])
    rest = points.alias("p").join(found.select(*points.columns).distinct().alias("f").transform(spread), same, "left_anti")
    return found.unionByName(rest, allowMissingColumns=True)


def asof_join(queries: DataFrame, samples: DataFrame, on: Sequence[str], time: str, sample_time: str, *, within: bool = True) -> DataFrame:
    """queries with the latest sample (columns prefixed with s_) of their key that is not later; nulls if there is none.

    With `within`, times after a key's last sample have none either. Samples and queries are sorted once, together,
    by key and time; no pairs are made. Of samples at one time the greatest row wins.
    """
    sample = F.struct(*[F.col(c).alias("s_" + c) for c in samples.columns])
    s = samples.select(*on, F.col(sample_time).alias("_t"), F.lit(0).alias("_kind"), sample.alias("_sample"))
    q = queries.select(*on, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*queries.columns).alias("_query"))
    both = s.unionByName(q, allowMissingColumns=True)
    key = Window.partitionBy(*on)
    both = both.withColumn("_found", F.last("_sample", ignorenulls=True).over(key.orderBy("_t", "_kind", "_sample").rowsBetween(Window.unboundedPreceding, 0)))
    if within:
        both = both.withColumn("_end", F.max(F.when(F.col("_kind") == 0, F.col("_t"))).over(key)).withColumn("_found", F.when(F.col("_t") <= F.col("_end"), F.col("_found")))
    found = both.where("_kind = 1")
    return found.select("_query.*", *[F.col("_found").getField("s_" + c).alias("s_" + c) for c in samples.columns])
