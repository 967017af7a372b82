"""JSON, CSV and OBJ forms of cell tables and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import codec
from tesseral.functions.cells import AXES
from tesseral.sources.document import read_document

_ATOM = "struct<x21:bigint,y21:bigint,h12:bigint,intervals:array<array<bigint>>>"
SCENARIO = f"metadata struct<reservation:struct<xy_zoom:int,h_zoom:int>>, flights array<struct<flight_id:string,reservation:struct<agl_bottom_m:double,agl_top_m:double,dynamic_atoms:array<{_ATOM}>>>>"


def read_scenario(spark: SparkSession, path: str) -> DataFrame:
    """flight_id, agl_bottom_m, agl_top_m, xy_zoom, h_zoom, x21, y21, h12, start_s, end_s of a nested scenario document.

    Empty intervals are left out; zooms are 21 and 12 where the metadata name none; a flight without atoms fails.
    """
    about, flights = SCENARIO.split(", flights ")
    zooms = read_document(spark, path, about).agg(F.first("metadata", ignorenulls=True).alias("metadata"))
    f = read_document(spark, path, f"flights {flights}").select(F.explode("flights").alias("f")).crossJoin(F.broadcast(zooms))  # one row
    atoms = F.coalesce(F.col("f.reservation.dynamic_atoms"), F.raise_error(F.lit("a flight has no dynamic_atoms")).cast(f"array<{_ATOM}>"))
    a = f.select(
        "f.flight_id", "f.reservation.agl_bottom_m", "f.reservation.agl_top_m", F.coalesce("metadata.reservation.xy_zoom", F.lit(21)).alias("xy_zoom"),
        F.coalesce("metadata.reservation.h_zoom", F.lit(12)).alias("h_zoom"), F.explode(atoms).alias("a"),
    )
    i = a.select("flight_id", "agl_bottom_m", "agl_top_m", "xy_zoom", "h_zoom", "a.x21", "a.y21", "a.h12", F.explode("a.intervals").alias("i"))
    i = i.select("*", F.col("i")[0].alias("start_s"), F.col("i")[1].alias("end_s")).drop("i")
    return i.where("end_s > start_s")


def write_scenario(reserved: DataFrame, bands: DataFrame, path: str) -> None:
    """A flight a line, with its atoms and their intervals nested: the lines of read_scenario's `flights`."""
    atoms = reserved.groupBy("flight_id", "x21", "y21", "h12").agg(F.array_sort(F.collect_list(F.array("start_s", "end_s"))).alias("intervals"))
    flights = atoms.groupBy("flight_id").agg(F.array_sort(F.collect_list(F.struct("x21", "y21", "h12", "intervals"))).alias("dynamic_atoms"))
    flights = flights.join(bands, "flight_id")
    nested = F.struct("agl_bottom_m", "agl_top_m", "dynamic_atoms").alias("reservation")
    doc = F.struct(F.array(F.struct(F.col("flight_id").cast("string").alias("flight_id"), nested)).alias("flights"))
    flights.select(F.to_json(doc).alias("value")).write.mode("overwrite").text(path)


def read_scenario_lines(spark: SparkSession, path: str) -> DataFrame:
    """read_scenario for documents of one line each, as write_scenario makes them; large scenarios split by line."""
    text = spark.read.text(path).select(F.from_json("value", SCENARIO).alias("d"))
    atoms = text.select(F.explode("d.flights").alias("f")).select("f.flight_id", "f.reservation.agl_bottom_m", "f.reservation.agl_top_m", F.explode("f.reservation.dynamic_atoms").alias("a"))
    i = atoms.select("flight_id", "agl_bottom_m", "agl_top_m", "a.x21", "a.y21", "a.h12", F.explode("a.intervals").alias("i"))
    return i.select("*", F.col("i")[0].alias("start_s"), F.col("i")[1].alias("end_s")).drop("i").where("end_s > start_s")


def write_prefixes(df: DataFrame, path: str, *, compression: str = "none") -> None:
    """Cells as CSV with a header and the columns zx, ix, zy, iy, zh, ih; gzip for record dumps."""
    out = df.select("zx", F.col("vx").alias("ix"), "zy", F.col("vy").alias("iy"), F.col("zf").alias("zh"), F.col("vf").alias("ih"))
    out.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """Cells of three axes from CSV files with the columns zx, ix, zy, iy, zh, ih; a byte order mark is skipped."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    n = lambda c, kind: F.col(c).cast(kind)
    return rows.select(
        F.lit(14).alias("flags"), n("zx", "int").alias("zx"), n("zy", "int").alias("zy"), n("zh", "int").alias("zf"), F.lit(0).alias("zt"),
        n("ix", "long").alias("vx"), n("iy", "long").alias("vy"), n("ih", "long").alias("vf"), F.lit(0).cast("long").alias("vt"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def cell_records(df: DataFrame, kind: str) -> DataFrame:
    """One JSON document a cell with its descriptor and bounds, for map viewers."""
    active = [a for a in AXES if a != "t"]
    rows = df.withColumns(codec.bounds())
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *[F.col(c) for a in active for c in (f"z{a}", f"v{a}")], "west", "east", "south", "north", "bottom", "top")).alias("value"))


def box_mesh_lines(df: DataFrame, *, named: bool = False) -> DataFrame:
    """The OBJ lines of boxes (box, low_e, high_e, low_n, high_n, low_u, high_u): rows box, line_no, value; with `named`, each begins as an
    object of its own, called by its box.

    Faces count vertices backward from their own box, so files of different tasks can be put together in any order.
    """
    corners = [(e, n, u) for u in ("low_u", "high_u") for n in ("low_n", "high_n") for e in ("low_e", "high_e")]
    faces = [(1, 3, 4), (1, 4, 2), (5, 6, 8), (5, 8, 7), (1, 2, 6), (1, 6, 5), (3, 7, 8), (3, 8, 4), (1, 5, 7), (1, 7, 3), (2, 4, 8), (2, 8, 6)]
    lines = [F.concat_ws(" ", F.lit("v"), *c) for c in corners] + [F.lit("f " + " ".join(str(i - 9) for i in f)) for f in faces]
    lines = [F.concat(F.lit("o "), F.col("box").cast("string")), *lines] if named else lines
    return df.select("box", F.posexplode(F.array(*lines)).alias("line_no", "value"))


def sampled_surface(triangles: DataFrame, density: float, seed: int = 5) -> DataFrame:
    """Points (e, n, u) spread evenly over triangles (ax, ay, az, bx, ..., cz): about `density` a unit of area, at least one each."""
    d = lambda p, q, c: F.col(p + c) - F.col(q + c)
    u = [d("b", "a", c) for c in "xyz"]
    v = [d("c", "a", c) for c in "xyz"]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2
    rows = triangles.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(area * density).cast("int")))))
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed + salt), "_i", *triangles.columns), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.withColumn("_r", F.sqrt(unit(0))).withColumn("_s", unit(1))
    mix = lambda c: F.col("a" + c) * (1 - F.col("_r")) + F.col("b" + c) * F.col("_r") * (1 - F.col("_s")) + F.col("c" + c) * F.col("_r") * F.col("_s")
    return rows.select(mix("x").alias("e"), mix("y").alias("n"), mix("z").alias("u"))


def read_transform(spark: SparkSession, path: str) -> DataFrame:
    """One row lat, lon, height_origin_m of a point cloud's anchor document; fails without latitude and longitude."""
    doc = spark.read.schema("anchor struct<lat:double,lon:double,height_origin_m:double>").json(path, multiLine=True)
    need = lambda c: F.coalesce(F.col(f"anchor.{c}"), F.raise_error(F.lit(f"the anchor has no {c}")).cast("double")).alias(c)
    return doc.select(need("lat"), need("lon"), "anchor.height_origin_m")


def write_stats(stats: DataFrame, path: str) -> None:
    """Rows of figures as JSON lines."""
    stats.coalesce(1).write.mode("overwrite").json(path)
