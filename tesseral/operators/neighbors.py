"""Neighbours of cells and morphology on uniform grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions.cells import AXES, CELL, axis_of, neighbor_value
from tesseral.operators.algebra import normalize
from tesseral.operators.joins import covered

Offsets = Sequence[Mapping[str, int]]
#: The six faces of a cell on a grid of three axes.
FACES = ({"x": -1}, {"x": 1}, {"y": -1}, {"y": 1}, {"f": -1}, {"f": 1})


def neighbors(df: DataFrame, offsets: Offsets, boundary: str | Mapping[str, str] = "reject", *, keep_rejected: bool = False) -> DataFrame:
    """df with a row for each cell and offset: offset_id and the moved cell at the same zooms.

    An offset names steps by axis; `boundary` is one policy or one by axis ("reject" where none is named). Moves off the
    domain under "reject" are left out, or kept with null values. Duplicates are kept.
    """
    for o in offsets:
        list(map(axis_of, o))
    policy = boundary if isinstance(boundary, Mapping) else dict.fromkeys(AXES, boundary)
    # The offsets are a literal of the plan, not a table.
    steps = F.array(*[F.struct(F.lit(i).alias("id"), *[F.lit(int(o.get(a, 0))).cast("long").alias(a) for a in AXES]) for i, o in enumerate(offsets)])
    rows = df.withColumn("_o", F.explode(steps))
    moved = {f"v{a}": F.when(F.col(f"_o.{a}") == 0, F.col(f"v{a}")).otherwise(neighbor_value(F.col(f"v{a}"), F.col(f"z{a}"), F.col(f"_o.{a}"), policy.get(a, "reject"))) for a in AXES}
    out = rows.withColumn("offset_id", F.col("_o.id")).withColumns(moved).drop("_o")
    if keep_rejected:
        return out
    return out.where(" and ".join(f"v{a} is not null" for a in AXES))


def dilate(df: DataFrame, offsets: Offsets, boundary: str | Mapping[str, str] = "reject", by: Sequence[str] = (), *, include_original: bool = True) -> DataFrame:
    """Normalised regions with the same-zoom neighbours of their cells, normalised again. Coarse cells
    have coarse neighbours: this is no dilation by a distance."""
    base = normalize(df, by).select(*by, *CELL)
    around = neighbors(base, offsets, boundary).select(*by, *CELL)
    return normalize(base.unionByName(around) if include_original else around, by)


def neighbor_membership(region: DataFrame, queries: DataFrame, offsets: Offsets, boundary: str | Mapping[str, str] = "reject", by: Sequence[str] = ()) -> DataFrame:
    """queries by offset_id, with member: whether the region covers the moved cell. Rejected moves are no members."""
    moved = neighbors(queries.withColumn("_q", F.struct(*queries.columns)), offsets, boundary, keep_rejected=True)
    whole = moved.where(" and ".join(f"v{a} is not null" for a in AXES))
    hits = covered(region, whole, by=by).select("_q", "offset_id").distinct().withColumn("_hit", F.lit(True))
    joined = moved.select("_q", "offset_id").join(hits, ["_q", "offset_id"], "left")
    return joined.select("_q.*", "offset_id", F.coalesce("_hit", F.lit(False)).alias("member"))


def grid_dilate(df: DataFrame, offsets: Offsets, by: Sequence[str] = ()) -> DataFrame:
    """Uniform cells and their neighbours, once each."""
    cells = df.select(*by, *CELL)
    return cells.unionByName(neighbors(cells, offsets).drop("offset_id").select(*by, *CELL)).distinct()


def grid_erode(df: DataFrame, offsets: Offsets, by: Sequence[str] = ()) -> DataFrame:
    """Uniform cells whose neighbours at all offsets are there. Each cell votes for the cells whose neighbour it is,
    so it takes one grouping and no join."""
    cells = df.select(*by, *CELL).distinct()
    back = [{a: -s for a, s in o.items()} for o in offsets]
    votes = neighbors(cells, back).select(*by, *CELL, F.lit(0).alias("_own"), F.lit(1).alias("_n"))
    votes = votes.unionByName(cells.select(*by, *CELL, F.lit(1).alias("_own"), F.lit(0).alias("_n")))
    return votes.groupBy(*by, *CELL).agg(F.max("_own").alias("_own"), F.sum("_n").alias("_n")).where((F.col("_own") == 1) & (F.col("_n") == len(offsets))).select(*by, *CELL)


def grid_frontier(df: DataFrame, offsets: Offsets, by: Sequence[str] = ()) -> DataFrame:
    """Uniform cells that erosion removes."""
    return df.select(*by, *CELL).distinct().subtract(grid_erode(df, offsets, by))


def exposed_faces(df: DataFrame, offsets: Offsets = FACES, by: Sequence[str] = ()) -> DataFrame:
    """Cells by offset_id whose neighbour there is not in the region or off the domain."""
    cells = df.select(*by, *CELL).distinct()
    moved = neighbors(cells.withColumn("_c", F.struct(*CELL)), offsets, keep_rejected=True)
    empty = moved.join(cells, [F.equal_null(moved[c], cells[c]) for c in (*by, *CELL)], "left_anti")
    return empty.select(*by, "_c.*", "offset_id")


def route_margin(df: DataFrame, zoom: int) -> DataFrame:
    """For cells (vx, vy) of this zoom: their 4 children and the 8 cells next to these on the four sides, at zoom + 1.
    x goes round the globe, y ends at the poles."""
    steps = [(dx, dy) for dx in (0, 1) for dy in (0, 1)] + [(dx, dy) for dx in (-1, 2) for dy in (0, 1)] + [(dx, dy) for dx in (0, 1) for dy in (-1, 2)]
    n = 1 << (zoom + 1)
    rows = df.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("x"), F.lit(b).cast("long").alias("y")) for a, b in steps])))
    rows = rows.withColumns({"vx": F.pmod(F.col("vx") * 2 + F.col("_s.x"), F.lit(n).cast("long")), "vy": F.col("vy") * 2 + F.col("_s.y")}).drop("_s")
    return rows.where((F.col("vy") >= 0) & (F.col("vy") < n))
