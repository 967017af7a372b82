"""Attribute-preserving compression of reservations: one cell table, four ways to write it down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions.cells import CELL
from tesseral.operators.algebra import close_axis
from tesseral.operators.intervals import attribute_segments, dyadic_cover
from tesseral.operators.lineage import cut

KEY = ("x21", "y21", "h12")


def segments_of(reserved: DataFrame) -> DataFrame:
    """For each cell the longest time spans over which the same flights hold it."""
    return attribute_segments(reserved, KEY, "flight_id")


def prefixes_of(segments: DataFrame, zooms: tuple[int, int, int]) -> DataFrame:
    """The segments as cells of four axes with their flights as attribute: dyadic time, fixed grid in space."""
    rows = dyadic_cover(segments)
    space = {"zx": zooms[0], "zy": zooms[1], "zf": zooms[2]}
    return rows.select(
        F.concat_ws("|", F.transform("members", lambda m: m.cast("string"))).alias("attribute"), F.size("members").alias("cardinality"), F.lit(15).alias("flags"),
        *[F.lit(z).cast("int").alias(n) for n, z in space.items()], "zt", F.col("x21").alias("vx"), F.col("y21").alias("vy"), F.col("h12").alias("vf"), "vt",
    ).select("attribute", "cardinality", *CELL)


def normalize_attributes(cells: DataFrame, zooms: dict[str, int], by: Sequence[str] = ("attribute", "cardinality")) -> tuple[DataFrame, dict[str, int]]:
    """(normal form, merges by axis) of disjoint cells, of which only those of one attribute merge.

    Every merge makes one cell of two, so an axis's merges are how many cells its closing takes away. If the time axis,
    the last, merges any, the others can merge again.
    """
    merges = dict.fromkeys(("x", "y", "f", "t"), 0)
    now = cut(cells.select(*by, *CELL).distinct())
    n = now.count()
    while True:
        again = False
        for a in merges:
            now = cut(close_axis(now, a, zooms[a], by))
            left = now.count()
            merges[a] += n - left
            again = again or (a == "t" and left < n)
            n = left
        if not again:
            return now, merges


def check_merges(before: DataFrame, after: DataFrame, merges: dict[str, int]) -> None:
    """Every merge takes one cell away; fails if counts disagree."""
    a, b = before.count(), after.count()
    if b != a - sum(merges.values()):
        raise ValueError(f"{a} cells less {sum(merges.values())} merges are not {b}")


def key_bits_3d() -> str:
    return "19 + zx + zy + zf"


def key_bits_4d() -> str:
    return "24 + zx + zy + zf + zt"


def representation_totals(segments: DataFrame, cells: DataFrame, normal: DataFrame, zooms: tuple[int, int, int], flights: int) -> DataFrame:
    """Rows representation, records, key_bits, total_bits: a record each second, exact intervals (two 32-bit ends),
    dyadic prefixes and normalised prefixes; totals add a mask of one bit a flight to each record."""
    fixed = 19 + sum(zooms)
    agg = lambda df, name, records, bits: df.agg(F.coalesce(records, F.lit(0)).cast("long").alias("records"), F.coalesce(bits, F.lit(0)).cast("long").alias("key_bits")).select(F.lit(name).alias("representation"), "records", "key_bits")
    seconds = F.sum(F.col("end_s") - F.col("start_s"))
    four = F.sum(F.expr(key_bits_4d()))
    rows = agg(segments, "seconds", seconds, seconds * (fixed + 32)).unionByName(agg(segments, "intervals", F.count("*"), F.count("*") * (fixed + 64)))
    rows = rows.unionByName(agg(cells, "dyadic", F.count("*"), four)).unionByName(agg(normal, "normalized", F.count("*"), four))
    return rows.withColumn("total_bits", F.col("key_bits") + F.col("records") * flights)


def cardinalities(segments: DataFrame, cells: DataFrame, normal: DataFrame) -> DataFrame:
    """How many segments, dyadic and normalised cells have attributes of each size."""
    one = lambda df, col, name: df.groupBy(F.col(col).cast("int").alias("cardinality")).agg(F.count("*").alias(name))
    out = one(segments, "coverage", "segments").join(one(cells, "cardinality", "dyadic"), "cardinality", "full").join(one(normal, "cardinality", "normalized"), "cardinality", "full")
    return out.na.fill(0)


def zoom_distribution(normal: DataFrame, zooms: tuple[int, int, int]) -> DataFrame:
    """Normalised cells by cardinality and zoom vector, with bits a record, the time block and how far axes were coarsened."""
    rows = normal.groupBy("cardinality", "zx", "zy", "zf", "zt").agg(F.count("*").alias("cells"))
    coarse = {f"{a}_coarsened_bits": F.lit(z) - F.col(f"z{a}") for a, z in zip("xyf", zooms, strict=True)}
    return rows.withColumns({"bits_per_record": F.expr(key_bits_4d()), "time_block_s": F.expr("shiftleft(1L, 32 - zt)"), **coarse}).withColumn("anisotropic_xy", F.col("zx") != F.col("zy"))


def coarsening_counts(normal: DataFrame, zooms: tuple[int, int, int]) -> DataFrame:
    """One row: cells coarsened on each axis, on any, and by different amounts on x and y."""
    on = [F.col(f"z{a}") < z for a, z in zip("xyf", zooms, strict=True)]
    return normal.agg(*[F.count_if(t).alias(f"{a}_coarsened") for a, t in zip("xyf", on, strict=True)], F.count_if(on[0] | on[1] | on[2]).alias("spatially_merged"), F.count_if(F.col("zx") != F.col("zy")).alias("anisotropic"))


def flight_summary(reserved: DataFrame) -> DataFrame:
    """For each flight its cells, intervals, reserved seconds and time span."""
    return reserved.groupBy("flight_id").agg(F.countDistinct(*KEY).alias("atoms"), F.count("*").alias("intervals"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def example_prefixes(cells: DataFrame, attributes: int = 3, each: int = 3) -> DataFrame:
    """The first prefixes of the first attributes, the smallest sets first."""
    from pyspark.sql import Window

    first = cells.select("cardinality", "attribute").distinct().orderBy("cardinality", "attribute").limit(attributes)
    rank = F.row_number().over(Window.partitionBy("attribute").orderBy(*CELL))
    return cells.join(first, ["cardinality", "attribute"]).withColumn("example", rank).where(F.col("example") <= each)
