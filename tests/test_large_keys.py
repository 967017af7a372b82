"""Scans and joins that deal one large key out over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tesseral.functions.cells import CELL
from tesseral.operators import intervals, joins, scans

from .helpers import frame
from .helpers import regions as random_regions


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges as small as these would be put together else."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def spans(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), t := rnd.randrange(0, 40_000), t + rnd.choice([-3, 0, 1, 4, 9, 60])) for _ in range(6000)]
    rows += [("one", 0, 50_000), ("one", 7, 9), ("one", 60_000, 60_001)] + [("hot", 100, 101)] * 50
    return spark.createDataFrame(rows, "k string, start_s long, end_s long").repartition(3)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_merged_intervals(spans):
    assert rows_of(scans.merged_intervals(spans, ["k"])) == rows_of(intervals.merge_intervals(spans, ["k"]))
    assert scans.merged_intervals(spans.limit(0), ["k"]).count() == 0
    assert scans.Ranges(spans, ["k"], ["start_s", "end_s"]).rows.where("k = 'hot'").select("_range").distinct().count() > 1


def test_ranks(spans):
    got = scans.ranked(spans, ["k"], ["start_s", "end_s"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["rank"], r["start_s"], r["end_s"]))
    assert len(got) == spans.count()
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_asof(spark, spans):
    samples = spans.select("k", F.col("start_s").alias("t"), F.col("end_s").alias("v"))
    asked = spans.select("k", (F.col("start_s") * 3 % 41_000 - 5).alias("at")).union(spark.createDataFrame([("none", 5)], "k string, at long"))
    want = joins.asof_join(asked, samples, ["k"], "at", "t", within=False)
    assert rows_of(scans.asof(asked, samples, ["k"], "at", "t")) == rows_of(want)


def test_hot_keys(spans):
    assert scans.has_hot_key(spans, ["k"], 1000) and not scans.has_hot_key(spans, ["k"], 10_000)


def test_dyadic_interval_join(spark, spans):
    points = spans.select("k", (F.col("start_s") * 5 % 61_000).alias("at")).distinct()
    for how in ("inner", "left"):
        want = joins.interval_join(points, spans.distinct(), ["k"], "at", how=how)
        if how == "left":  # an interval that is empty holds nothing
            assert want.count() == joins.dyadic_interval_join(points, spans.distinct(), ["k"], "at", how=how).count()
        assert rows_of(joins.dyadic_interval_join(points, spans.distinct(), ["k"], "at", how=how)) == rows_of(want)
    plan = joins.dyadic_interval_join(points, spans, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "start_s" not in plan.partition("Join")[2].partition("\n")[0]


@pytest.mark.parametrize("most", [1, 4, 12])
def test_overlaps_by_steps(spark, most):
    a, b = (frame(spark, random_regions(seed, 3, "xyf", size=60, high=6), True).distinct() for seed in (1, 2))
    step = joins._zoom_step((a, b), most)
    assert step > 1 == joins._zoom_step((a, b), 10**6)
    key = ["region", *CELL]
    got = joins.overlap_join(a, b, by=["region"], most=most)
    assert got.columns == [*key, *["r_" + c for c in key]]
    assert rows_of(got) == rows_of(joins.overlap_join(a, b, by=["region"], most=10**6)) != []


def test_scheduled_flights(spark):
    from collections import Counter

    from tesseral.plans import airspace

    rows = airspace.scheduled(spark.range(0, 700, 7).withColumnRenamed("id", "flight_id"), 1000, 60).orderBy("flight_id").collect()
    assert [r["departure_s"] for r in rows] == [1000 + 60 * i for i in range(100)]
    speeds = [r["cruise_speed_mps"] for r in rows]
    assert sorted(Counter(speeds).values()) == [33, 33, 34] and speeds != sorted(speeds)
    assert airspace.scheduled(spark.range(0).withColumnRenamed("id", "flight_id"), 0).count() == 0
