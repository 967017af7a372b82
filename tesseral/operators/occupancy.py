"""From point clouds to solid objects of cells: quantising, closing, filling, and the largest cells inside.

Voxels are rows (ix, iy, ih) and stay sparse: whatever needs the empty ones too works on runs along an axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions import codec, geo
from tesseral.functions.cells import shr
from tesseral.operators.graph import components
from tesseral.operators.lineage import cut

GRID = ("ix", "iy", "ih")


def crop(points: DataFrame, low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """Points within inclusive bounds."""
    for c, x in low.items():
        points = points.where(F.col(c) >= x)
    for c, x in high.items():
        points = points.where(F.col(c) <= x)
    return points


def downsample(points: DataFrame, size: float, coords: Sequence[str] = ("e", "n", "u")) -> DataFrame:
    """The mean point of each occupied cube of this size."""
    keys = [F.floor(F.col(c) / size).alias("_" + c) for c in coords]
    return points.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in coords]).select(*coords)


def quantize(points: DataFrame, lat0: float, lon0: float, height_origin: float, zoom_xy: int, zoom_h: int) -> DataFrame:
    """The distinct tiles (ix, iy, ih) of points in metres east, north and up of an anchor."""
    lat, lon = geo.enu_to_wgs84(F.col("e"), F.col("n"), lat0, lon0)
    return points.select(codec.x_tile(lon, zoom_xy).alias("ix"), codec.y_tile(lat, zoom_xy).alias("iy"), codec.f_tile_linear(F.col("u") + height_origin, zoom_h).alias("ih")).distinct()


def voxelize(points: DataFrame, size: float, origin: tuple[float, float, float]) -> DataFrame:
    """The distinct voxels of points on a metric grid."""
    return points.select(*[F.floor((F.col(c) - o) / size).cast("long").alias(g) for c, o, g in zip(("e", "n", "u"), origin, GRID, strict=True)]).distinct()


def voxel_centers(voxels: DataFrame, size: float, origin: tuple[float, float, float]) -> DataFrame:
    """The middle points of voxels."""
    return voxels.select(*[((F.col(g) + 0.5) * size + o).alias(c) for c, o, g in zip(("e", "n", "u"), origin, GRID, strict=True)])


def _cube() -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(d).cast("long").alias(g) for d, g in zip(s, GRID, strict=True)]) for s in ((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))]))


def _around(voxels: DataFrame, by: Sequence[str]) -> DataFrame:
    moved = voxels.withColumn("_d", _cube())
    return moved.select(*by, *[(F.col(g) + F.col(f"_d.{g}")).alias(g) for g in GRID])


def close(voxels: DataFrame, iterations: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Morphological closing with a cube of 3 x 3 x 3: so many dilations, then as many erosions, on an unbounded grid."""
    grown = voxels.select(*by, *GRID).distinct()
    for _ in range(iterations):
        grown = _around(grown, by).distinct()
    for _ in range(iterations):
        grown = _around(grown, by).groupBy(*by, *GRID).agg(F.count("*").alias("_n")).where("_n = 27").drop("_n")
    return grown


def directional_fill(shell: DataFrame, sides: Sequence[str] = ("west", "east", "above"), by: Sequence[str] = ()) -> DataFrame:
    """The shell and the empty voxels with shell strictly on all these sides (west, east, north, south, above).

    Candidates are the gaps between neighbours along x, so nothing outside of the shell's rows is looked at.
    """
    if not {"west", "east"} <= set(sides):
        raise ValueError("filling needs shell to the west and to the east")
    shell = shell.select(*by, *GRID).distinct()
    row = Window.partitionBy(*by, "iy", "ih").orderBy("ix")
    gaps = shell.withColumn("_next", F.lead("ix").over(row)).where("_next > ix + 1")
    found = gaps.withColumn("ix", F.explode(F.sequence(F.col("ix") + 1, F.col("_next") - 1))).select(*by, *GRID)
    for side, key, c, test in (("above", "iy", "ih", "_most > ih"), ("south", "ih", "iy", "_most > iy"), ("north", "ih", "iy", "_least < iy")):
        if side in sides:
            keys = [*by, "ix", key]
            ends = shell.groupBy(*keys).agg(F.max(c).alias("_most"), F.min(c).alias("_least"))
            found = found.join(ends, keys).where(test).select(*by, *GRID)
    return shell.unionByName(found)


def flood_fill(shell: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The shell and all empty voxels that can't be reached from outside through faces.

    Only the gaps between neighbours of a row along x can be inside; they are the nodes of a graph, however far apart the shell's voxels are. A gap is
    open if a row beside it has no shell, or none before or behind the gap's ends. Two gaps of rows side by side are linked if they
    overlap, and then one of them holds the other's first voxel: for each gap the last one of each row beside it that
    begins no later is looked at, in one scan of the rows. Components with an open gap are outside.
    """
    shell = cut(shell.select(*by, *GRID).distinct())
    row = [*by, "iy", "ih"]
    gaps = shell.withColumn("_next", F.lead("ix").over(Window.partitionBy(*row).orderBy("ix"))).where("_next > ix + 1")
    gaps = cut(gaps.select(*row, (F.col("ix") + 1).alias("a"), (F.col("_next") - 1).alias("b")).withColumn("node", F.monotonically_increasing_id()))
    ends = shell.groupBy(*row).agg(F.min("ix").alias("first"), F.max("ix").alias("last"))
    around = F.explode(F.array(*[F.struct(F.lit(y).cast("long").alias("y"), F.lit(h).cast("long").alias("h")) for y, h in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    asked = gaps.withColumn("_d", around).withColumns({"iy": F.col("iy") + F.col("_d.y"), "ih": F.col("ih") + F.col("_d.h")}).drop("_d")
    same = None
    for c in row:
        test = F.equal_null(F.col("q." + c), F.col("e." + c))
        same = test if same is None else same & test
    beside = asked.alias("q").join(ends.alias("e"), same, "left")
    opened = beside.where("e.first is null or q.a < e.first or q.b > e.last").select("q.node").distinct()
    both = gaps.select(*row, "a", F.lit(0).alias("_kind"), F.struct("b", "node").alias("_gap"), F.lit(None).cast("long").alias("_from"))
    both = both.unionByName(asked.select(*row, "a", F.lit(1).alias("_kind"), F.lit(None).cast("struct<b:bigint,node:bigint>").alias("_gap"), F.col("node").alias("_from")))
    upto = Window.partitionBy(*row).orderBy("a", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    links = both.withColumn("_held", F.last("_gap", ignorenulls=True).over(upto)).where("_kind = 1 and _held.b >= a")
    links = links.select(F.col("_from").alias("u"), F.col("_held.node").alias("v"))
    alone = gaps.select(F.col("node").alias("u"), F.col("node").alias("v"))
    rooted = cut(components(links.unionByName(alone)).withColumnRenamed("node", "_node").join(gaps, F.col("_node") == F.col("node")).drop("_node"))
    outside = rooted.join(opened, "node").select("root").distinct()
    filled = rooted.join(outside, "root", "left_anti").withColumn("ix", F.explode(F.sequence("a", "b"))).select(*by, *GRID)
    return shell.unionByName(filled)


def boundary(solid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Solid voxels with an empty voxel at one of their six faces."""
    keys = [*by, *GRID]
    solid = solid.select(*keys).distinct()
    faces = F.explode(F.array(*[F.struct(*[F.lit(s if g == axis else 0).cast("long").alias(g) for g in GRID]) for axis in GRID for s in (-1, 1)]))
    votes = solid.withColumn("_d", faces).select(*by, *[(F.col(g) + F.col(f"_d.{g}")).alias(g) for g in GRID])
    full = votes.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 6")
    return solid.join(full, keys, "left_anti")


def classify_exposed(raw: DataFrame, closed: DataFrame, solid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Boundary voxels with origin: raw (scanned), closed (made by closing) or fill (made by filling)."""
    keys = [*by, *GRID]
    named = raw.select(*keys).distinct().withColumn("_o", F.lit(0)).unionByName(closed.select(*keys).distinct().withColumn("_o", F.lit(1)))
    named = named.groupBy(*keys).agg(F.min("_o").alias("_o"))
    edge = boundary(solid, by).join(named, keys, "left")
    return edge.select(*keys, F.when(F.col("_o") == 0, "raw").when(F.col("_o") == 1, "closed").otherwise("fill").alias("origin"))


def max_inscribed(voxels: DataFrame, most: tuple[int, int, int], by: Sequence[str] = ()) -> DataFrame:
    """The largest aligned dyadic blocks that are full: rows dx, dy, dh (by how many bits coarser), bx, by, bh, atoms, for all ties.

    Full blocks are found as a pyramid, axis by axis: a block is full if both its halves are. A level has at most half the blocks of the one
    below, and where it has none the axis ends, so in all at most eight times the voxels are moved, whatever `most` is.
    """
    block, depth = ["bx", "by", "bh"], ["dx", "dy", "dh"]
    full = cut(voxels.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[F.col(g).alias(b) for g, b in zip(GRID, block, strict=True)], *[F.lit(0).alias(d) for d in depth]).distinct())
    keys = [f"_k_{c}" for c in by]
    for d, b, bits in zip(depth, block, most, strict=True):
        level = full
        for _ in range(bits):
            rest = [*keys, *[c for c in (*block, *depth) if c != b]]
            level = level.groupBy(*rest, shr(F.col(b), 1).alias(b)).agg(F.count("*").alias("_n")).where("_n = 2").drop("_n")
            level = cut(level.withColumn(d, (F.col(d) + 1).cast("int")))
            if level.isEmpty():
                break
            full = full.unionByName(level)
    sized = full.withColumn("atoms", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("dx") + F.col("dy") + F.col("dh")))
    ranked = sized.groupBy(*keys).agg(F.max("atoms").alias("_most")) if by else sized.agg(F.max("atoms").alias("_most"))
    same = F.col("s.atoms") == F.col("m._most")
    for k in keys:
        same = same & F.equal_null(F.col("s." + k), F.col("m." + k))
    return sized.alias("s").join(ranked.alias("m"), same).select(*[F.col(f"s._k_{c}").alias(c) for c in by], *[F.col("s." + c) for c in (*depth, *block, "atoms")])


def set_sizes(raw: DataFrame, closed: DataFrame, solid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of diagnostics for each object: how many voxels were scanned, added by closing and by filling, and what share is fill."""
    keys = [*by, *GRID]
    named = None
    for df, name in ((raw, "r"), (closed, "c"), (solid, "s")):
        part = df.select(*keys, *[F.lit(int(k == name)).alias(k) for k in "rcs"])
        named = part if named is None else named.unionByName(part)
    one = named.groupBy(*keys).agg(*[F.max(k).alias(k) for k in "rcs"])
    counts = one.groupBy(*by).agg(F.sum("r").alias("raw"), F.count_if(F.expr("c = 1 and r = 0")).alias("closed_added"), F.count_if(F.expr("s = 1 and c = 0 and r = 0")).alias("fill_added"), F.sum("s").alias("solid"), F.count_if(F.expr("r = 1 and c = 0")).alias("raw_lost"))
    return counts.withColumn("fill_share", F.coalesce(F.col("fill_added") / F.nullif(F.col("solid"), F.lit(0)), F.lit(0.0)))


def local_bounds(cells: DataFrame, lat0: float, lon0: float, height_origin: float = 0.0) -> DataFrame:
    """cells of x, y and f with the box low_e .. high_u, in metres around an anchor, that holds their four corners and layers."""
    north, south = codec.y_north(F.col("vy"), F.col("zy")), codec.y_north(F.col("vy") + 1, F.col("zy"))
    west, east = codec.x_west(F.col("vx"), F.col("zx")), codec.x_west(F.col("vx") + 1, F.col("zx"))
    corners = [geo.wgs84_to_enu(lat, lon, lat0, lon0) for lat in (south, north) for lon in (west, east)]
    e, n = [c[0] for c in corners], [c[1] for c in corners]
    low, high = codec.f_bounds_linear(F.col("vf"), F.col("zf"), height_origin)
    return cells.withColumns({"low_e": F.least(*e), "high_e": F.greatest(*e), "low_n": F.least(*n), "high_n": F.greatest(*n), "low_u": low, "high_u": high})


def largest_by_volume(boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of boxes with local bounds the one of the greatest volume, with it; ties go to the first by its bounds."""
    volume = (F.col("high_e") - F.col("low_e")) * (F.col("high_n") - F.col("low_n")) * (F.col("high_u") - F.col("low_u"))
    order = F.struct(volume.alias("v"), (-F.col("low_e")).alias("e"), (-F.col("low_n")).alias("n"), (-F.col("low_u")).alias("u"))
    best = boxes.groupBy(*by).agg(F.max_by(F.struct(*[c for c in boxes.columns if c not in by], volume.alias("volume")), order).alias("_b"))
    return best.where("_b is not null").select(*by, "_b.*")
