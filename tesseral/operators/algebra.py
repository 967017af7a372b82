"""Regions, as sets of cells in DataFrames, and their algebra.

A region is the rows of a DataFrame with the cell columns; `by` names columns (a region id, an
attribute) that keep many regions apart in one table. Cells of a region have the same axes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.cells import AXES, CELL, MAX_ZOOM, VALUES, ZOOMS, axis_of, common_prefix, compatible, shl, shr, subsumes
from tesseral.operators.intervals import dyadic_cover
from tesseral.operators.joins import covered, meets, overlap_join, prefixed
from tesseral.operators.lineage import cut

#: Runs of values are found within aligned chunks of 2 ** CHUNK, so no group is larger than that.
CHUNK = 14


def refine(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Each cell's 2 ** len(axes) parts after halving it on these axes in turn; an axis may come twice. Fails at zoom 32."""
    for a in map(axis_of, axes):
        deeper = F.when(F.col(f"z{a}").between(1, MAX_ZOOM - 1), F.col(f"z{a}") + 1).otherwise(F.raise_error(F.lit(f"axis {a} can't be refined")).cast("int"))
        df = df.withColumn("_bit", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({f"v{a}": shl(F.col(f"v{a}"), 1).bitwiseOR(F.col("_bit")), f"z{a}": deeper}).drop("_bit")
    return df


def coarsen(df: DataFrame, zooms: dict[str, int], by: Sequence[str] = ()) -> DataFrame:
    """The distinct cells after truncation to coarser zooms. Fails if a target is finer than a cell."""
    for a, z in zooms.items():
        a = axis_of(a)
        ok = F.when(F.col(f"z{a}") >= z, shr(F.col(f"v{a}"), F.col(f"z{a}") - z)).otherwise(F.raise_error(F.lit(f"axis {a} is coarser than its target")).cast("long"))
        df = df.withColumn(f"v{a}", ok).withColumn(f"z{a}", F.lit(z).cast("int"))
    return df.select(*by, *CELL).distinct()


def atoms(df: DataFrame, working: dict[str, int], by: Sequence[str] = (), *, most_bits: int = 24) -> DataFrame:
    """The distinct cells of the working zooms that a region covers. Fails if a cell is finer than
    them, or would be expanded into more than 2 ** most_bits cells."""
    bits = sum((F.lit(z) - F.col(f"z{a}") for a, z in working.items()), F.lit(0))
    df = df.select(*by, *CELL).withColumn("_bits", F.when(bits <= most_bits, bits).otherwise(F.raise_error(F.lit("a cell is too coarse to expand")).cast("int"))).where("_bits is not null")
    for a, z in working.items():
        a = axis_of(a)
        more = F.when(F.col(f"z{a}") <= z, F.lit(z) - F.col(f"z{a}")).otherwise(F.raise_error(F.lit(f"axis {a} is finer than the working grid")).cast("int"))
        first = shl(F.col(f"v{a}"), more)
        df = df.withColumn("_v", F.explode(F.sequence(first, first + shl(F.lit(1), more) - 1)))
        df = df.withColumns({f"v{a}": F.col("_v"), f"z{a}": F.lit(z).cast("int")}).drop("_v")
    return df.select(*by, *CELL).distinct()


def atoms_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def atoms_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def atoms_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def semantic_equal(a: DataFrame, b: DataFrame, working: dict[str, int], by: Sequence[str] = ()) -> DataFrame:
    """Rows of `by`, equal: whether two regions cover the same atoms. Without `by`, one row."""
    both = atoms(a, working, by).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
    both = both.unionByName(atoms(b, working, by).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    sides = both.groupBy(*by, *CELL).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.groupBy(*by).agg((F.count_if(F.col("_a") != F.col("_b")) == 0).alias("equal"))


def expansion_check(normal: DataFrame, fine: DataFrame, working: dict[str, int], by: Sequence[str] = ()) -> DataFrame:
    """Rows of `by`, missing, extra: fine cells that a normal form doesn't cover, and cells it covers beyond them."""
    both = atoms(normal, working, by).withColumn("_n", F.lit(1)).withColumn("_f", F.lit(0))
    both = both.unionByName(fine.select(*by, *CELL).distinct().withColumn("_n", F.lit(0)).withColumn("_f", F.lit(1)))
    sides = both.groupBy(*by, *CELL).agg(F.max("_n").alias("_n"), F.max("_f").alias("_f"))
    return sides.groupBy(*by).agg(F.count_if(F.col("_n") < F.col("_f")).alias("missing"), F.count_if(F.col("_n") > F.col("_f")).alias("extra"))


def remove_subsumed(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct cells that no other cell of their region subsumes."""
    cells = df.select(*by, *CELL).distinct()
    return covered(cells, cells, by=by, strict=True, how="left_anti")


def merge_siblings(df: DataFrame, axis: str, by: Sequence[str] = ()) -> DataFrame:
    """df (distinct cells) with all sibling pairs on one axis replaced by their parents, and a column _merged:
    1 for a new parent. Cells of zoom 1 are never merged."""
    a = axis_of(axis)
    others = [c for c in CELL if c != f"v{a}"]
    can = F.col(f"z{a}") > 1
    key = F.when(can, shr(F.col(f"v{a}"), 1)).otherwise(F.col(f"v{a}"))
    rows = df.withColumn("_key", key).groupBy(*by, *others, "_key").agg(F.count("*").alias("_n"), F.min(f"v{a}").alias("_v"))
    pair = (F.col("_n") == 2) & can
    rows = rows.withColumn(f"v{a}", F.when(pair, F.col("_key")).otherwise(F.col("_v"))).withColumn("_merged", pair.cast("int"))
    return rows.withColumn(f"z{a}", F.when(pair, F.col(f"z{a}") - 1).otherwise(F.col(f"z{a}")).cast("int")).select(*by, *CELL, "_merged")


def close_axis(df: DataFrame, axis: str, zoom: int, by: Sequence[str] = ()) -> DataFrame:
    """Merge siblings on one axis as far as they go, for disjoint cells whose zoom on it is at most `zoom`.

    Each run of adjacent cells becomes its dyadic cover, which is what sibling merges end in. Runs are found within
    aligned chunks of 2 ** CHUNK units; chunks that are full, and cells as large, go on to a coarser grid and are
    merged there in the same way. So no group is larger than a chunk, even where a region is one long row.
    """
    a = axis_of(axis)
    z, v = f"z{a}", f"v{a}"
    others = [*by, *[c for c in CELL if c not in (z, v)]]
    columns = [*by, *CELL]
    done = df.where(F.col(z) == 0).select(*columns)  # cells without the axis stay
    df = df.where(F.col(z) > 0).select(*columns)
    while True:
        last = zoom <= CHUNK + 1
        bits = zoom if last else CHUNK
        small = df if last else df.where(F.col(z) > zoom - bits)
        more = F.lit(zoom) - F.col(z)
        rows = small.select(*others, shl(F.col(v), more).alias("_a"), shl(F.col(v) + 1, more).alias("_b")).withColumn("_chunk", shr(F.col("_a"), bits))
        order = Window.partitionBy(*others, "_chunk").orderBy("_a")
        new = F.lag("_b").over(order).isNull() | (F.lag("_b").over(order) != F.col("_a"))
        rows = rows.withColumn("_new", new.cast("int"))
        rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        base = shl(F.col("_chunk"), bits)
        runs = rows.groupBy(*others, "_chunk", "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
        runs = runs.withColumns({"_a": F.col("_a") - base, "_b": F.col("_b") - base})
        # A full chunk is half of a domain that is one bit wider.
        blocks = dyadic_cover(runs, "_a", "_b", zoom=bits + (not last), out=("_z", "_v"))
        depth = F.col("_z") - (0 if last else 1)
        merged = blocks.withColumns({z: (F.lit(zoom - bits) + depth).cast("int"), v: shl(F.col("_chunk"), depth) + F.col("_v")}).select(*columns)
        if last:
            return done.unionByName(merged)
        merged = cut(merged)
        done = done.unionByName(merged.where(F.col(z) > zoom - bits))
        df = merged.where(F.col(z) == zoom - bits).unionByName(df.where(F.col(z) <= zoom - bits))
        zoom -= bits


def normalize_uniform(df: DataFrame, zooms: dict[str, int], by: Sequence[str] = ()) -> DataFrame:
    """The normal form of regions whose cells all have these zooms: each axis is closed once, in order."""
    cells = df.select(*by, *CELL).distinct()
    for a, z in zooms.items():
        cells = close_axis(cells, a, z, by)
    return cells


def normalize_mixed(df: DataFrame, by: Sequence[str] = (), *, stats: list[dict[str, int]] | None = None) -> DataFrame:
    """The normal form of any regions: drop subsumed cells, merge all siblings on the first axis that has any, start again.

    Regions of mixed zooms can have several normal forms; this order of steps, for each region, defines which one
    this is. The loop ends after at most the sum of all zooms in passes; `stats` gets a row of counts for each.
    """
    cells = df.select(*by, *CELL).distinct()
    while True:
        before = cut(cells)
        cells = cut(remove_subsumed(before, by))
        row = {"cells": before.count(), "kept": cells.count()}
        for a in AXES:
            tried = cut(merge_siblings(cells, a, by))
            row[f"merged_{a}"] = tried.agg(F.coalesce(F.sum("_merged"), F.lit(0))).first()[0]
            if row[f"merged_{a}"]:
                cells = tried.drop("_merged")
                break
        if stats is not None:
            stats.append(row)
        if not any(row.get(f"merged_{a}") for a in AXES):
            return cells


def normalize(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The normal form of each region; regions of mixed axes fail.

    Tables whose cells have one zoom vector, the common case of grids and sampled objects, are closed axis by axis. On a single
    axis cells that nothing subsumes are disjoint, so these are closed at once, too; others take the loop of normalize_mixed.
    """
    cells = df.select(*by, *CELL).distinct()
    vectors = cells.select("flags", *ZOOMS).distinct().limit(2).collect()
    if not vectors:
        return cells
    if len(vectors) == 1:
        return normalize_uniform(cells, {a: vectors[0][f"z{a}"] for a in AXES if vectors[0][f"z{a}"]}, by)
    mixed = cells.groupBy(*by).agg(F.min("flags").alias("a"), F.max("flags").alias("b")).where("a != b")
    if not mixed.isEmpty():
        raise ValueError("a region's cells have different axes")
    axes = cells.agg(*[F.max(z).alias(z) for z in ZOOMS]).first()
    used = [a for a in AXES if axes[f"z{a}"]]
    if len(used) == 1:
        return close_axis(cut(remove_subsumed(cells, by)), used[0], axes[f"z{used[0]}"], by)
    return normalize_mixed(cells, by)


def union(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return normalize(a.select(*by, *CELL).unionByName(b.select(*by, *CELL)), by)


def intersection(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return normalize(meets(a.select(*by, *CELL).distinct(), b.select(*by, *CELL).distinct(), by=by), by)


def _one_vector(df: DataFrame) -> tuple | None:
    """The flags and zooms that all cells of a table have, if they have the same."""
    found = df.select("flags", *ZOOMS).distinct().limit(2).collect()
    return tuple(found[0]) if len(found) == 1 else None


def difference(a: DataFrame, b: DataFrame, by: Sequence[str] = (), working: dict[str, int] | None = None) -> DataFrame:
    """The normal form of what is in region a and not in region b.

    Cells of one zoom vector on both sides need an anti-join only. Else cells of a that nothing of b touches pass through, and the others are halved, all at
    once, on the first axis on which a subtractor of theirs is finer: halves that are free of subtractors are done, those inside of one
    go, the rest are halved again. So it takes at most as many rounds as zooms differ by in all, however many subtractors a cell has.
    Nothing is halved beyond the working zooms, if given; what subtractors touch there goes.
    """
    if working is None and (vector := _one_vector(a)) is not None and vector == _one_vector(b):
        keys = [*by, *CELL]
        left = prefixed(b.select(*keys).distinct(), "r_")
        same = F.lit(True)
        for k in keys:
            same = same & F.equal_null(k, "r_" + k)
        return normalize(a.select(*keys).distinct().join(left, same, "left_anti"), by)
    cells = cut(normalize(a, by).withColumn("_cell", F.monotonically_increasing_id()))
    theirs = ["r_" + c for c in CELL]
    pairs = cut(overlap_join(cells, normalize(b, by), by=by).select(*by, "_cell", *CELL, *theirs))
    done = cells.join(pairs.select("_cell").distinct(), "_cell", "left_anti").select(*by, *CELL)
    while not pairs.isEmpty():
        # Bit i: a subtractor is finer on axis i. A cell that some subtractor holds has one that is finer on none.
        finer = [(F.col(f"r_z{x}") > F.col(f"z{x}")) & (F.lit(True) if working is None else F.col(f"z{x}") < working.get(x, MAX_ZOOM)) for x in AXES]
        bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(finer)), F.lit(0))
        node = ["_cell", *CELL]
        plan = pairs.groupBy(*node).agg(F.bit_or(bits).alias("_bits"), F.min(bits).alias("_least"))
        plan = plan.where("_least > 0" if working is None else "_bits > 0")
        if working is not None:  # held at full depth, and not only where the working grid ends
            held = subsumes("r_", "")
            plan = plan.join(pairs.where(held).select(*node).distinct(), node, "left_anti")
        halves = pairs.join(plan, node).withColumn("_bit", F.explode(F.array(F.lit(0), F.lit(1))))
        axis = F.when(F.col("_bits").bitwiseAND(1) > 0, 0).when(F.col("_bits").bitwiseAND(2) > 0, 1).when(F.col("_bits").bitwiseAND(4) > 0, 2).otherwise(3)
        halves = halves.withColumn("_axis", axis)
        deeper = {}
        for i, x in enumerate(AXES):
            on = F.col("_axis") == i
            deeper[f"v{x}"] = F.when(on, shl(F.col(f"v{x}"), 1).bitwiseOR(F.col("_bit").cast("long"))).otherwise(F.col(f"v{x}"))
            deeper[f"z{x}"] = F.when(on, F.col(f"z{x}") + 1).otherwise(F.col(f"z{x}")).cast("int")
        halves = halves.withColumns(deeper).select(*by, *node, *theirs).withColumn("_hit", compatible("", "r_"))
        halves = cut(halves)
        free = halves.groupBy(*by, *node).agg(F.max(F.col("_hit").cast("int")).alias("_any")).where("_any = 0")
        done = cut(done.unionByName(free.select(*by, *CELL)))
        pairs = halves.where("_hit").drop("_hit")
    return normalize(done, by)


def symmetric_difference(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return union(difference(a, b, by), difference(b, a, by), by)


def enclosing_cell(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The smallest cell that holds all cells of a region of one zoom vector: the common prefix of the least and the
    greatest value on each axis. Axes whose values differ in their first bit are dropped."""
    first = [F.min(c).alias(c) for c in ("flags", *ZOOMS, *VALUES)]
    last = [F.max(c).alias("r_" + c) for c in ("flags", *ZOOMS, *VALUES)]
    both = df.groupBy(*by).agg(*first, *last) if by else df.agg(*first, *last).where("flags is not null")
    return both.select(*by, *common_prefix("", "r_"))


def enclosing_cover(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Enclosing cells of the parts into which the first bits of the axes split a region, and how many cells each holds."""
    first = {a: F.when(F.col(f"z{a}") > 0, shr(F.col(f"v{a}"), F.greatest(F.col(f"z{a}") - 1, F.lit(0)))).otherwise(F.lit(0).cast("long")) for a in AXES}
    rows = df.withColumns({f"_first_{a}": c for a, c in first.items()})
    keys = [*by, *[f"_first_{a}" for a in AXES]]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("cells"))
    cover = enclosing_cell(rows, keys)
    same = None
    for k in keys:
        test = F.equal_null(F.col("e." + k), F.col("n." + k))
        same = test if same is None else same & test
    return cover.alias("e").join(counted.alias("n"), same).select(*[F.col("e." + c) for c in (*by, *CELL)], "n.cells")


def add_cells(index: DataFrame, cells: DataFrame) -> DataFrame:
    """A stored set of cells with more cells; those that are there stay as they are."""
    return index.unionByName(cells.select(*index.columns)).distinct()


def discard_cells(index: DataFrame, cells: DataFrame, *, must_exist: bool = False) -> DataFrame:
    """A stored set of cells without some; with must_exist, it fails if one of them isn't there."""
    keys = index.columns
    if must_exist and not cells.join(index, keys, "left_anti").isEmpty():
        raise KeyError("a cell to remove is not in the set")
    return index.join(cells.select(*keys).distinct(), keys, "left_anti")


def zoom_histogram(df: DataFrame, by: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """How many cells have each zoom vector, commonest first; ties by zooms. With `top`, only so many."""
    counts = df.groupBy(*by, "flags", *ZOOMS).agg(F.count("*").alias("cells")).orderBy(F.col("cells").desc(), *by, "flags", *ZOOMS)
    return counts.limit(top) if top else counts



def canonical_rank(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """df with rank: the place of each cell among those of its region, from 1, by axes, zooms and then values."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("flags", *ZOOMS, *VALUES)))
