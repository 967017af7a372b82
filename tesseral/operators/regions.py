"""Normal forms of many small regions, each in one task.

algebra.normalize_mixed works on all regions of a table at once, a few jobs a pass. Regions of up to LARGE cells need no job of
their own: all cells of a region go to one task, and there its cells of each zoom vector are a sorted array of keys, a key being the axes'
prefixes one after the other. Dropping what is subsumed and merging siblings are then set operations on such arrays. After the first pass only
the parents that the pass before made can subsume anything, so a pass costs what it changes, not what there is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesseral.functions.cells import AXES, CELL, VALUES, ZOOMS, shr
from tesseral.operators import algebra
from tesseral.operators.lineage import cut

#: Cells of a region that one task takes.
LARGE = 100_000
Vector = tuple[int, int, int, int]
#: The sorted keys of a region's cells by zoom vector.
Region = dict[Vector, np.ndarray]


def keys_of(vector: Vector, values: np.ndarray) -> np.ndarray:
    """Keys of cells with these zooms; whole numbers of any size where 63 bits don't suffice."""
    key = np.zeros(len(values), np.int64 if sum(vector) < 64 else object)
    for i, z in enumerate(vector):
        key = (key << z) | values[:, i]
    return key


def values_of(vector: Vector, keys: np.ndarray) -> np.ndarray:
    out = np.zeros((len(keys), 4), np.int64)
    for i in reversed(range(4)):
        out[:, i] = keys & ((1 << vector[i]) - 1)
        keys = keys >> vector[i]
    return out


def truncated(keys: np.ndarray, vector: Vector, to: Vector) -> np.ndarray:
    """Keys of the cells of coarser zooms that hold these."""
    return keys_of(to, values_of(vector, keys) >> np.array([a - b for a, b in zip(vector, to, strict=True)]))


def _add(region: Region, vector: Vector, keys: np.ndarray) -> None:
    old = region.get(vector)
    region[vector] = np.unique(keys) if old is None else np.union1d(old, keys)


def drop_subsumed(region: Region, by: Region) -> int:
    """Drop the cells of a region that a cell of `by` subsumes and is not; how many."""
    dropped = 0
    for vector in list(region):
        keys = region[vector]
        gone = np.zeros(len(keys), bool)
        for coarse, holders in by.items():
            if coarse != vector and all(a <= b for a, b in zip(coarse, vector, strict=True)):
                gone |= np.isin(truncated(keys, vector, coarse), holders)
        if gone.any():
            dropped += int(gone.sum())
            region[vector] = keys[~gone]
            if gone.all():
                del region[vector]
    return dropped


def merge_axis(region: Region, axis: int, most: int | None = None) -> Region:
    """Replace sibling pairs on an axis by their parents, which are returned; all, or the first `most` by zooms and values."""
    made: Region = {}
    for vector in sorted(region):
        if vector[axis] <= 1:
            continue
        parent = tuple(z - (i == axis) for i, z in enumerate(vector))
        keys = region[vector]
        above, inverse, times = np.unique(truncated(keys, vector, parent), return_inverse=True, return_counts=True)
        pairs = times == 2
        if not pairs.any():
            continue
        if most is not None:
            pairs &= np.cumsum(pairs) <= most
        made[parent] = above[pairs]
        region[vector] = keys[~pairs[inverse]]
        if not len(region[vector]):
            del region[vector]
        if most is not None and (most := most - int(pairs.sum())) == 0:
            break
    for parent, keys in made.items():
        _add(region, parent, keys)
    return made


def normal_form(region: Region, *, one_pair: bool = False) -> dict[str, int]:
    """Bring a region to its normal form, in place: drop what is subsumed, merge all siblings on the first axis that has any (or, with
    one_pair, the first pair of it), start again. How many passes merged, and how many cells were dropped and pairs merged."""
    stats = {"passes": 0, "dropped": drop_subsumed(region, dict(region)), "merged": 0}
    while made := next((m for a in range(4) if (m := merge_axis(region, a, 1 if one_pair else None))), None):
        stats["passes"] += 1
        stats["merged"] += sum(map(len, made.values()))
        stats["dropped"] += drop_subsumed(region, made)
    return stats


def region_of(zooms: np.ndarray, values: np.ndarray) -> Region:
    region: Region = {}
    vectors, inverse = np.unique(zooms, axis=0, return_inverse=True)
    for i, vector in enumerate(map(tuple, vectors.tolist())):
        region[vector] = np.unique(keys_of(vector, values[inverse.reshape(-1) == i]))
    return region


def _columns(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], axis=1)


def _read(table: pa.Table) -> tuple[int, Region]:
    flags = table.column("flags").unique().to_pylist()
    if len(flags) > 1:
        raise ValueError("a region's cells have different axes")
    return flags[0], region_of(_columns(table, ZOOMS).astype(np.int64), _columns(table, VALUES))


def _types(df: DataFrame, by: Sequence[str], more: str) -> StructType:
    return StructType([*[df.schema[c] for c in by], *StructType.fromDDL(more).fields])


_CELLS = "flags int, " + ", ".join(f"{z} int" for z in ZOOMS) + ", " + ", ".join(f"{v} long" for v in VALUES)
STATS = ("passes", "dropped", "merged")


def _in_tasks(df: DataFrame, by: Sequence[str], one_pair: bool) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        flags, region = _read(table)
        normal_form(region, one_pair=one_pair)
        z = np.concatenate([np.repeat([v], len(k), axis=0) for v, k in region.items()])
        v = np.concatenate([values_of(v, k) for v, k in region.items()])
        same = [pa.array([table.column(c)[0].as_py()] * len(z), table.schema.field(c).type) for c in by]
        columns = [*same, pa.array(np.full(len(z), flags, np.int32)), *[pa.array(z[:, i].astype(np.int32)) for i in range(4)], *[pa.array(v[:, i]) for i in range(4)]]
        return pa.table(columns, names=[*by, *CELL])

    return df.select(*by, *CELL).groupBy(*by).applyInArrow(run, _types(df, by, _CELLS))


def normalize_regions(df: DataFrame, by: Sequence[str], *, one_pair: bool = False, large: int = LARGE) -> DataFrame:
    """The normal form of each region, the one that algebra.normalize_mixed gives.

    Regions of up to `large` different cells are taken by a task each; larger ones, whose cells no task should hold, go through the loop together, with
    all siblings of an axis at once. A region's cells must have the same axes. With one_pair, siblings are merged pair by pair, which
    can end in another normal form; regions above `large` then fail. No cells give no rows.
    """
    cells = df.select(*by, *CELL).distinct()
    sizes = cells.groupBy(*by).agg((F.count("*") > large).alias("_large")).where("_large")
    if sizes.isEmpty():
        return _in_tasks(cells, by, one_pair)
    if one_pair:
        raise ValueError(f"regions of more than {large} cells aren't merged pair by pair")
    cells = cut(cells)
    same = None
    for c in by:
        test = F.equal_null(F.col("c." + c), F.col("s." + c))
        same = test if same is None else same & test
    if same is None:
        return algebra.normalize_mixed(cells)
    side = lambda how: cells.alias("c").join(sizes.alias("s"), same, how).select("c.*")
    return _in_tasks(side("left_anti"), by, False).unionByName(algebra.normalize_mixed(side("left_semi"), by))


def normalize_counters(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of `by`, cells, normal, passes, dropped, merged: what bringing each region to its normal form took. Regions are held by a task each."""

    def run(table: pa.Table) -> pa.Table:
        _, region = _read(table)
        before = sum(map(len, region.values()))
        stats = normal_form(region)
        same = [pa.array([table.column(c)[0].as_py()], table.schema.field(c).type) for c in by]
        return pa.table([*same, [before], [sum(map(len, region.values()))], *[[stats[s]] for s in STATS]], names=[*by, "cells", "normal", *STATS])

    kinds = "cells long, normal long, " + ", ".join(f"{s} long" for s in STATS)
    return df.select(*by, *CELL).distinct().groupBy(*by).applyInArrow(run, _types(df, by, kinds))


def merge_one_pair(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """df (distinct cells) with one sibling pair of each region replaced by its parent: the first by zooms and values on the first axis that has one.

    Pairs are found by groups of siblings; of each axis and region only the first pair, a row, goes on to be chosen from.
    """
    cells = df.select(*by, *CELL)
    first = None
    for n, a in enumerate(AXES):
        others = [c for c in CELL if c != f"v{a}"]
        grouped = cells.where(F.col(f"z{a}") > 1).groupBy(*by, *others, shr(F.col(f"v{a}"), 1).alias(f"v{a}")).agg(F.count("*").alias("_n")).where("_n = 2")
        pair = F.struct(F.lit(n).alias("axis"), *[F.col(c) for c in (*ZOOMS, *VALUES)], "flags")
        least = grouped.groupBy(*by).agg(F.min(pair).alias("_pair")) if by else grouped.agg(F.min(pair).alias("_pair")).where("_pair is not null")
        first = least if first is None else first.unionByName(least)
    chosen = first.groupBy(*by).agg(F.min("_pair").alias("_pair")) if by else first.agg(F.min("_pair").alias("_pair")).where("_pair is not null")
    chosen = cut(chosen)
    axis = F.col("_pair.axis")
    children = chosen.withColumn("_bit", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    values = [F.when(axis == i, F.col(f"_pair.{v}") * 2 + F.col("_bit")).otherwise(F.col(f"_pair.{v}")).alias(v) for i, v in enumerate(VALUES)]
    gone = children.select(*by, F.col("_pair.flags").alias("flags"), *[F.col(f"_pair.{z}").alias(z) for z in ZOOMS], *values)
    parent = [F.when(axis == i, F.col(f"_pair.{z}") - 1).otherwise(F.col(f"_pair.{z}")).cast("int").alias(z) for i, z in enumerate(ZOOMS)]
    made = chosen.select(*by, F.col("_pair.flags").alias("flags"), *parent, *[F.col(f"_pair.{v}").alias(v) for v in VALUES])
    same = None
    for c in (*by, *CELL):
        test = F.equal_null(F.col("c." + c), F.col("g." + c))
        same = test if same is None else same & test
    return cells.alias("c").join(gone.alias("g"), same, "left_anti").unionByName(made).distinct()
