import json
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesseral.functions.cells import CELL
from tesseral.operators.algebra import atoms, zoom_histogram
from tesseral.plans import airspace, fixtures
from tesseral.plans import queries as catalogue
from tesseral.sources import generators, tables
from tesseral.sources.ply import PlySource
from tesseral.streaming import monitor


def test_ply_round_trip(spark, tmp_path):
    spark.dataSource.register(PlySource)
    points = spark.range(1000).selectExpr("id / 7.0D as e", "id * 2.0D as n", "-id * 1.0D as u")
    path = f"file://{tmp_path}/cloud"
    points.repartition(3).write.format("ply").mode("append").save(path)
    back = spark.read.format("ply").option("pointsPerTask", 100).load(path)
    assert back.rdd.getNumPartitions() >= 10
    assert back.select("e", "n", "u").exceptAll(points).isEmpty() and back.count() == 1000
    assert back.where("red is not null").isEmpty()


def test_ply_kinds(spark, tmp_path):
    spark.dataSource.register(PlySource)
    head = "ply\nformat {}\ncomment x\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 0\nproperty list uchar int vertex_index\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head.format("binary_big_endian 1.0").encode() + struct.pack(">fffBBBfffBBB", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12))
    (tmp_path / "a.ply").write_text(head.format("ascii 1.0") + "1 2 3 4 5 6\n7 8 9 10 11 12\n")
    for name in "ab":
        got = spark.read.format("ply").load(f"{tmp_path}/{name}.ply").collect()
        assert sorted(map(tuple, got)) == [(1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12)]
    (tmp_path / "c.ply").write_text("nothing")
    with pytest.raises(PySparkException):
        spark.read.format("ply").load(f"{tmp_path}/c.ply").collect()


def test_scenarios(spark, tmp_path):
    reserved = catalogue._reserved(spark, "/root/testdata/sf0.001")
    bands = reserved.select("flight_id").distinct().withColumn("agl_bottom_m", F.lit(20.0)).withColumn("agl_top_m", F.lit(40.0))
    tables.write_scenario(reserved, bands, f"{tmp_path}/s")
    back = tables.read_scenario_lines(spark, f"{tmp_path}/s").withColumn("flight_id", F.col("flight_id").cast("long"))
    same = back.select(*reserved.columns)
    assert same.exceptAll(reserved).isEmpty() and reserved.exceptAll(same).isEmpty()
    doc = {"metadata": {}, "flights": [{"flight_id": "A", "reservation": {"agl_bottom_m": 1.0, "agl_top_m": 2.0, "dynamic_atoms": [{"x21": 1, "y21": 2, "h12": 3, "intervals": [[5, 9], [9, 9]]}]}}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    assert [tuple(r) for r in tables.read_scenario(spark, f"{tmp_path}/d.json").collect()] == [("A", 1.0, 2.0, 21, 12, 1, 2, 3, 5, 9)]
    del doc["flights"][0]["reservation"]["dynamic_atoms"]
    (tmp_path / "e.json").write_text(json.dumps(doc))
    with pytest.raises(PySparkException):
        tables.read_scenario(spark, f"{tmp_path}/e.json").collect()


def test_prefix_files(spark, tmp_path):
    cells = fixtures.grid_cells(spark, "/root/testdata/sf0.001").select(*CELL).distinct()
    for codec_name in ("none", "gzip"):
        tables.write_prefixes(cells, f"{tmp_path}/{codec_name}", compression=codec_name)
        back = tables.read_prefixes(spark, f"{tmp_path}/{codec_name}")
        assert back.select(*CELL).exceptAll(cells).isEmpty() and back.count() == cells.count()
    (tmp_path / "bom.csv").write_text("﻿zx,ix,zy,iy,zh,ih\n3,1,3,2,2,1\n", encoding="utf-8")
    assert tuple(tables.read_prefixes(spark, f"{tmp_path}/bom.csv").first()) == (14, 3, 3, 2, 0, 1, 2, 1, 0)
    record = json.loads(tables.cell_records(cells, "bitmap").first()[0])
    assert record["kind"] == "bitmap" and record["west"] < record["east"] and record["south"] < record["north"]


def test_meshes(spark):
    box = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0)], "box int, low_e double, high_e double, low_n double, high_n double, low_u double, high_u double")
    lines = [r["value"] for r in tables.box_mesh_lines(box).orderBy("line_no").collect()]
    assert sum(x.startswith("v ") for x in lines) == 8 and sum(x.startswith("f ") for x in lines) == 12
    corners = [tuple(map(float, x.split()[1:])) for x in lines[:8]]
    volume = 0.0
    for f in lines[8:]:
        a, b, c = (corners[8 + int(i)] for i in f.split()[1:])
        volume += sum(a[i] * (b[(i + 1) % 3] * c[(i + 2) % 3] - b[(i + 2) % 3] * c[(i + 1) % 3]) for i in range(3)) / 6
    assert abs(volume) == pytest.approx(6.0)
    triangle = spark.createDataFrame([(0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0, 0.0)], ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    got = tables.sampled_surface(triangle, 50.0).collect()
    assert len(got) == 400 and all(r["u"] == 0 and r["e"] >= 0 and r["n"] >= 0 and r["e"] + r["n"] <= 4 + 1e-9 for r in got)
    assert sum(r["e"] for r in got) / 400 == pytest.approx(4 / 3, abs=0.15)


def test_generators(spark):
    assert generators.all_cells(spark, 3).count() == 14
    assert generators.all_cells(spark, 2, "xy").distinct().count() == 36
    assert generators.antichain_4d(spark, 50).distinct().count() == 50
    mixed = generators.mixed_random_4d(spark, 300, zoom=3)
    assert mixed.where("vx >= shiftleft(1, zx) or vx < 0").isEmpty() and zoom_histogram(mixed).count() > 40
    assert atoms(generators.all_cells(spark, 2), {"x": 2}).count() == 4
    assert generators.refinement_costs(spark, 2, 3).where("axes = 2 and bits = 3 and grid_cells = 64 and pieces = 12").count() == 1


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture
def events(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    base = spark.range(400).selectExpr("id", "id % 4 as flight_id", "timestamp_seconds(1700000000 + id * 3) as at")
    for k in range(4):
        base.where(f"id div 100 = {k}").write.mode("append").parquet(path)
    return spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 4).parquet(path)


def test_window_counts(spark, events):
    got = drain(monitor.window_counts(events, "at", 60, "1 minute", ("flight_id",)), "windows").collect()
    assert got and all(r["start_s"] % 60 == 0 and r["events"] <= 5 for r in got)
    assert sum(r["events"] for r in got) > 250  # the last windows stay open


def test_stream_conformance_is_the_batch_query(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    reserved = catalogue._reserved(spark, sf).persist()
    samples = fixtures.flight_samples(spark, sf).where("phase = 'cruise' and flight_id < 20").select("flight_id", "epoch_s", "lat", "lon", "amsl_m")
    samples.repartition(3).write.parquet(f"file://{tmp_path}/samples")
    stream = spark.readStream.schema(samples.schema).parquet(f"file://{tmp_path}/samples")
    got = drain(monitor.stream_conformance(stream, reserved), "judged")
    want = airspace.conformance(samples.withColumn("phase", F.lit("cruise")), reserved).distinct()
    counts = lambda df: sorted((r["flight_id"], r["inside"], r["count"]) for r in df.select("flight_id", "epoch_s", "lat", "lon", "amsl_m", "inside").distinct().groupBy("flight_id", "inside").count().collect())
    assert counts(got) == counts(want) and got.count() == samples.count()


def test_stream_joins_and_gaps(spark, events, tmp_path):
    announced = spark.createDataFrame([(1, 1700000100, 1700000200), (2, 1700000000, 1700000050)], "flight_id long, a long, b long").selectExpr("flight_id", "timestamp_seconds(a) as from_at", "timestamp_seconds(b) as to_at")
    announced.write.parquet(f"file://{tmp_path}/announced")
    stream = spark.readStream.schema(announced.schema).parquet(f"file://{tmp_path}/announced")
    got = drain(monitor.active_reservations(events.select("flight_id", "at"), stream), "active").collect()
    want = [(i % 4, 1700000000 + 3 * i) for i in range(400) if (i % 4 == 1 and 1700000100 <= 1700000000 + 3 * i < 1700000200) or (i % 4 == 2 and 3 * i < 50)]
    assert len(got) == len(want)
    some = events.where("id < 40 or id > 60").select("flight_id", "at")
    pauses = drain(monitor.gaps(some, "at", 30), "gaps").collect()
    assert {r["flight_id"] for r in pauses} == {0, 1, 2, 3} and all(r["to_s"] - r["from_s"] > 30 for r in pauses)


def test_anchor_documents(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"anchor": {"lat": 37.5, "lon": 139.9}}))
    assert tuple(tables.read_transform(spark, f"{tmp_path}/t.json").first()) == (37.5, 139.9, None)
    (tmp_path / "u.json").write_text(json.dumps({"anchor": {"lat": 37.5}}))
    with pytest.raises(PySparkException):
        tables.read_transform(spark, f"{tmp_path}/u.json").collect()
    tables.write_stats(spark.createDataFrame([(1, 2)], "cells int, kept int"), f"{tmp_path}/stats")
    assert spark.read.json(f"{tmp_path}/stats").first()["kept"] == 2
