"""Inputs for benchmarks and tests, made by Spark from row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions.cells import AXES, BIT, CELL


def _columns(**axes: tuple[int | Column, Column]) -> list[Column]:
    out = {"flags": F.lit(sum(BIT[a] for a in axes)).cast("int")}
    for a in AXES:
        z, v = axes.get(a, (0, F.lit(0)))
        out[f"z{a}"] = (F.lit(z) if isinstance(z, int) else z).cast("int")
        out[f"v{a}"] = v.cast("long")
    return [out[c].alias(c) for c in CELL]


def _cells(df: DataFrame, **axes: tuple[int | Column, Column]) -> DataFrame:
    return df.select(*_columns(**axes))


def antichain_1d(spark: SparkSession, n: int, zoom: int = 24) -> DataFrame:
    """n cells on one axis of which none are siblings: nothing merges."""
    return _cells(spark.range(n), x=(zoom, F.col("id") * 2))


def antichain_4d(spark: SparkSession, n: int, zoom: int = 20) -> DataFrame:
    """n cells on four axes of which none merge."""
    return _cells(spark.range(n), **{a: (zoom, F.col("id") * 2) for a in AXES})


def merge_heavy_1d(spark: SparkSession, n: int, zoom: int | None = None) -> DataFrame:
    """n neighbouring cells, the whole axis if n is a power of two: all merge into two."""
    return _cells(spark.range(n), x=(zoom or max(1, (n - 1).bit_length()), F.col("id")))


def anisotropic_merge_2d(spark: SparkSession, n: int, rows: int = 2) -> DataFrame:
    """A full block of n cells that is long on x and `rows` high on y."""
    across = max(1, n // rows)
    return _cells(spark.range(across * rows), x=(max(1, (across - 1).bit_length()), F.col("id") % across), y=(max(1, (rows - 1).bit_length()), F.floor(F.col("id") / across)))


def mixed_random_4d(spark: SparkSession, n: int, zoom: int = 4, seed: int = 1) -> DataFrame:
    """n random cells of zooms 1 to `zoom` on each axis."""
    pick = lambda k, most: F.pmod(F.xxhash64(F.lit(seed * 16 + k), "id"), most)
    zooms = {a: pick(i, F.lit(zoom)) + 1 for i, a in enumerate(AXES)}
    return _cells(spark.range(n), **{a: (z, pick(8 + i, F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int")))) for i, (a, z) in enumerate(zooms.items())})


def all_cells(spark: SparkSession, depth: int, axes: str = "x") -> DataFrame:
    """Every cell of zooms 1 to `depth` on these axes."""
    one = spark.range(1, depth + 1).select(F.col("id").cast("int").alias("z")).withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("z")) - 1)))
    out = None
    for a in axes:
        part = one.select(F.col("z").alias(f"_z{a}"), F.col("v").alias(f"_v{a}"))
        out = part if out is None else out.crossJoin(part)  # an enumeration is a product by definition
    return _cells(out, **{a: (F.col(f"_z{a}"), F.col(f"_v{a}")) for a in axes})


def refinement_costs(spark: SparkSession, axes: int = 4, depth: int = 16) -> DataFrame:
    """For differences of d bits on each of so many axes: cells of a full grid and pieces of selective refinement."""
    rows = spark.range(1, axes + 1).select(F.col("id").alias("axes")).withColumn("bits", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    return rows.select("axes", "bits", F.pow(F.lit(2.0), F.col("axes") * F.col("bits")).alias("grid_cells"), (F.col("axes") * F.col("bits") * 2).alias("pieces"))


def route_pairs(flights: DataFrame, sites: int) -> DataFrame:
    """flights (flight_id) with origin and destination, two different numbers below `sites`, spread by a congruential generator."""
    if sites < 2:
        raise ValueError("a route needs two sites")
    h = F.pmod(F.col("flight_id") * 48_271 + 11, F.lit(2_147_483_647))
    far = F.pmod(F.pmod(h * 48_271 + 11, F.lit(2_147_483_647)), F.lit(sites - 1)) + 1
    return flights.withColumn("origin", F.pmod(h, F.lit(sites))).withColumn("destination", F.pmod(F.col("origin") + far, F.lit(sites)))


def region_pairs(spark: SparkSession, regions: int, cells: int, zoom: int = 5, seed: int = 1) -> DataFrame:
    """Rows region_id, side (0 or 1) and random cells on x and y of zooms 1 to `zoom`: in every third region those of side 1 lie
    within cells of side 0, in every third they are finer on x than on y, and in the others they are independent."""
    pick = lambda k, most: F.pmod(F.xxhash64(F.lit(seed * 32 + k), "id", "side"), most)
    rows = spark.range(regions * cells).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("region_id", F.col("id") % regions)
    kind = F.col("region_id") % 3
    outer = [F.pmod(F.xxhash64(F.lit(seed * 32 + k), "id"), F.lit(zoom)) + 1 for k in (0, 1)]
    nested, thin = kind == 0, (kind == 1) & (F.col("side") == 1)
    zx = F.when(nested, outer[0] + F.col("side")).when(thin, F.lit(zoom)).otherwise(pick(2, F.lit(zoom)) + 1)
    zy = F.when(nested, outer[1] + F.col("side")).when(thin, F.lit(1)).otherwise(pick(3, F.lit(zoom)) + 1)
    power = lambda z: F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))
    at = lambda k, z, o: F.when(nested, F.pmod(F.xxhash64(F.lit(seed * 32 + k), "id"), power(o)) * (F.col("side") + 1) + F.when(F.col("side") == 1, pick(k + 8, F.lit(2))).otherwise(0)).otherwise(pick(k + 16, power(z)))
    made = {"flags": F.lit(12).cast("int"), "zx": zx.cast("int"), "zy": zy.cast("int"), "vx": at(4, zx, outer[0]), "vy": at(5, zy, outer[1])}
    return rows.select("region_id", "side", *[made.get(c, F.lit(0)).cast("int" if c[0] != "v" else "long").alias(c) for c in CELL]).distinct()


def shapes(rows: DataFrame, zoom: int = 24) -> DataFrame:
    """Rows region, shape and cells: for a region of n rows (region, i from 0, n) an antichain on one axis and on four, a run, and a block two rows high."""
    i, half = F.col("i"), F.floor(F.col("n") / 2).cast("long")
    block = F.when(i < half * 2, F.col("i") % F.greatest(half, F.lit(1)))
    made = {
        "antichain_1d": (rows, {"x": (zoom, i * 2)}), "antichain_4d": (rows, {a: (zoom, i * 2) for a in AXES}), "merge_heavy_1d": (rows, {"x": (zoom, i)}),
        "anisotropic_2d": (rows.where(i < half * 2), {"x": (zoom, block), "y": (1, F.floor(i / F.greatest(half, F.lit(1))))}),
    }
    out = None
    for name, (df, axes) in made.items():
        part = df.select("region", F.lit(name).alias("shape"), *_columns(**axes))
        out = part if out is None else out.unionByName(part)
    return out
