import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tesseral.functions import codec
from tesseral.plans import airspace, compression, extended, fixtures, oracles
from tesseral.plans import queries as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


QUERIES, SQL = {**catalogue.QUERIES, **extended.QUERIES}, {**oracles.ORACLE_SQL, **extended.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert name in SQL or rows, "a query without SQL has rows at least"
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got.columns, map(tuple, rows)) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nominal_flight(spark):
    f = catalogue.flights(spark, "/root/testdata/sf0.01").limit(3)
    samples = airspace.nominal_samples(f, fixtures.END_S)
    first = samples.where("elapsed_s = 0").collect()
    assert all(r["phase"] == "climb" and r["agl_m"] == 0 for r in first)
    steps = samples.groupBy("flight_id").agg(F.count("*").alias("n"), (F.max("epoch_s") - F.min("epoch_s")).alias("span")).collect()
    assert all(r["n"] == r["span"] + 1 for r in steps)


def test_flights_are_dealt_before_they_become_samples(spark):
    """A thousand flights lie in one file; one task made all their seconds."""
    f = catalogue.flights(spark, "/root/testdata/sf0.1")
    for samples in (airspace.nominal_samples(f, fixtures.END_S), airspace.actual_samples(f, fixtures.END_S)):
        assert samples.rdd.getNumPartitions() >= 8


def test_flights_as_flown_conform(spark):
    f = catalogue.flights(spark, "/root/testdata/sf0.01").limit(6)
    nominal = airspace.nominal_samples(f, fixtures.END_S)
    reserved = airspace.reservations(nominal, F.lit(20.0), F.lit(110.0), fixtures.START_S, fixtures.END_S)
    flown = airspace.actual_samples(f, fixtures.END_S)
    judged = airspace.conformance(flown, reserved)
    assert judged.count() == flown.count()
    counts = airspace.conformance_counts(judged, []).first()
    assert counts["applicable"] > 300 and counts["inside_ratio"] > 0.9
    again = airspace.actual_samples(f, fixtures.END_S)
    assert flown.exceptAll(again).isEmpty()
    status = airspace.status_at(judged, fixtures.START_S + 1500).first()
    assert status["inside"] + status["outside"] == status["monitored"] <= status["flying"] <= 6


def test_conformance_negatives(spark):
    """All positions off by one layer, and all times outside, of a reserved cell."""
    reserved = spark.createDataFrame([(1, 100, 200, 2048, 1000, 2000), (1, 101, 200, 2048, 1500, 1600)], "flight_id long, x21 long, y21 long, h12 long, start_s long, end_s long")
    west, north = -180 + 360 * 100.5 / 2**21, codec.y_north(F.lit(200.5), 21)
    times, heights = range(990, 2015, 16), (0.5, 9.0, -9.0, 30.0)
    rows = [(1, t, "cruise", west, h) for t in times for h in heights]
    samples = spark.createDataFrame(rows, "flight_id long, epoch_s long, phase string, lon double, amsl_m double").withColumn("lat", north)
    layer = {h: int((h + 16383) / 32767 * 4294967295) >> 20 for h in heights}
    for r in airspace.conformance(samples, reserved).collect():
        inside = 1000 <= r["epoch_s"] < 2000 and layer[r["amsl_m"]] == 2048
        assert (r["x21"], r["y21"]) == (100, 200) and r["inside"] is inside
        assert r["violation"] == (None if inside else "time" if not 1000 <= r["epoch_s"] < 2000 else "altitude")
    aside = airspace.conformance(samples.withColumn("lon", F.col("lon") + 1), reserved).where("violation = 'horizontal'")
    assert aside.count() == len(rows) - sum(not 1000 <= t < 2000 for t in times) * len(heights)
    climbing = airspace.conformance(samples.withColumn("phase", F.lit("climb")), reserved)
    assert climbing.where("inside is null and violation is null").count() == len(rows)


def test_compression_keeps_everything(spark):
    reserved = catalogue._reserved(spark, SF)
    segments, cells, normal = catalogue._compressed(spark, SF)

    def spread(df):
        atoms = df.withColumn("ix", F.explode(F.expr("sequence(vx << (21 - zx), ((vx + 1) << (21 - zx)) - 1)"))).withColumn("iy", F.explode(F.expr("sequence(vy << (21 - zy), ((vy + 1) << (21 - zy)) - 1)")))
        atoms = atoms.withColumn("ih", F.explode(F.expr("sequence(vf << (12 - zf), ((vf + 1) << (12 - zf)) - 1)")))
        return atoms.select("attribute", "ix", "iy", "ih", F.expr("vt << (32 - zt)").alias("a"), F.expr("(vt + 1) << (32 - zt)").alias("b"))

    def seconds(df):
        from tesseral.operators.intervals import merge_intervals

        return merge_intervals(spread(df), ["attribute", "ix", "iy", "ih"], "a", "b")

    assert seconds(cells).exceptAll(seconds(normal)).isEmpty() and seconds(normal).exceptAll(seconds(cells)).isEmpty()
    assert normal.count() < cells.count()
    totals = {r["representation"]: r for r in compression.representation_totals(segments, cells, normal, (21, 21, 12), 20).collect()}
    assert totals["normalized"]["records"] == normal.count() and totals["dyadic"]["records"] == cells.count()
    assert totals["seconds"]["records"] == segments.selectExpr("sum(end_s - start_s)").first()[0]
    assert compression.coarsening_counts(normal, (21, 21, 12)).first()["spatially_merged"] > 0
    assert compression.example_prefixes(normal).count() <= 9
    with pytest.raises(ValueError):
        compression.check_merges(cells, normal, {"x": 0})
    assert airspace.concurrent_flights(reserved).first()[0] > 0


def test_small_helpers(spark):
    assert airspace.departure_slots(0, 540) == [0, 180, 360, 540]
    speeds = airspace.balanced_speeds(34, random.Random(1))
    assert sorted(speeds.count(v) for v in (5.0, 8.0, 10.0)) == [11, 11, 12]
    sites = spark.createDataFrame([(1, 37.5, 139.9, 200.0)], "site_id int, lat double, lon double, ground_m double")
    cells = airspace.cell_bounds_of_sites(sites, [30, 50, 100], [20, 24, 28, 32])
    assert cells.count() == 12 and cells.where("west <= lon and lon < east and south < lat and lat <= north").count() == 12
    over = spark.createDataFrame([(1, 2, 3, 10, 20, 4)], "x21 long, y21 long, h12 long, start_s long, end_s long, coverage int")
    asked = spark.createDataFrame([(1, 2, 3, 15), (1, 2, 3, 25)], "x21 long, y21 long, h12 long, epoch_s long")
    assert {r["epoch_s"]: r["coverage"] for r in airspace.coverage_at(asked, over).collect()} == {15: 4, 25: 1}
    track = spark.createDataFrame([(1, t, 37.0 if t > 30 else t / 100, 139.0) for t in range(0, 101, 5)], "flight_id long, epoch_s long, lat double, lon double")
    assert airspace.thinned_routes(track, 4).count() == 3


def test_flights_as_flown_stray_and_come_back(spark):
    """Statistics of a hundred flights: on time, near the route, correlated from second to second, and no two alike."""
    f = catalogue.flights(spark, "/root/testdata/sf0.01")
    flown = airspace.actual_samples(f, fixtures.END_S + 100_000)
    per = flown.groupBy("flight_id").agg(
        F.max_by("phase", "elapsed_s").alias("last"), F.max("along_mm").alias("far"), F.max(F.abs("cross_mm")).alias("aside"), F.stddev(F.when(F.col("phase") == "cruise", F.col("cross_mm"))).alias("sigma"),
        F.min("speed_factor").alias("slow"), F.max("speed_factor").alias("fast"), F.count("*").alias("n"), (F.max("elapsed_s") + 1).alias("span"),
    ).collect()
    assert len(per) == f.count() and {r["last"] for r in per} == {"landed"} and all(r["n"] == r["span"] for r in per)
    routes = {r["flight_id"]: r["distance_m"] for r in airspace.with_route(f).collect()}
    assert all(r["far"] == int(routes[r["flight_id"]] * 1000) for r in per)
    assert min(r["slow"] for r in per) < 0.95 and max(r["fast"] for r in per) > 1.05
    assert all(0.899 <= r["slow"] <= r["fast"] <= 1.1 and r["aside"] <= airspace.CROSS_STRAY_MM for r in per)
    sigmas = [r["sigma"] for r in per if r["sigma"] is not None]  # some routes have no length
    assert len(set(sigmas)) == len(sigmas) > 90 and 800 < sum(sigmas) / len(sigmas) < 2500
    w = flown.where("phase = 'cruise'").selectExpr("flight_id", "cross_mm", "lag(cross_mm) over (partition by flight_id order by epoch_s) as was", "lag(cross_mm, 120) over (partition by flight_id order by epoch_s) as long_ago")
    near, far = w.selectExpr("corr(cross_mm, was)", "corr(cross_mm, long_ago)").first()
    assert near > 0.9 > 0.2 > abs(far)
    slow = f.withColumn("cruise_speed_mps", F.lit(6.1)).limit(2).unionByName(f.withColumn("flight_id", F.lit(None).cast("long")).limit(1)).unionByName(f.withColumn("departure_s", F.lit(None).cast("long")).limit(1))
    assert airspace.actual_samples(slow, fixtures.END_S).select("flight_id").distinct().count() == 2
