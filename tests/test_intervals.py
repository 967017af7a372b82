import random
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException

from tesseral.operators import intervals, joins

SCHEMA = "key int, member int, start_s long, end_s long"


def data(seed, n=150, keys=4, members=5, span=200):
    rnd = random.Random(seed)
    return [(rnd.randrange(keys), rnd.randrange(members), a := rnd.randrange(span), a + rnd.randrange(0, 25)) for _ in range(n)]


def active(rows):
    """{(key, second): set of members}"""
    out = defaultdict(set)
    for k, m, a, b in rows:
        for t in range(a, b):
            out[k, t].add(m)
    return out


def test_merged_intervals(spark):
    rows = data(1, n=40)
    got = [tuple(r) for r in intervals.merge_intervals(spark.createDataFrame(rows, SCHEMA), ["key"]).collect()]
    want = {k for k, v in active(rows).items() if v}
    assert {(k, t) for k, a, b in got for t in range(a, b)} == want
    by = defaultdict(list)
    for k, a, b in got:
        by[k].append((a, b))
    assert all(b < c for v in by.values() for (_, b), (c, _) in zip(sorted(v), sorted(v)[1:], strict=False))  # touching ones are joined


@pytest.mark.parametrize("seed", [1, 2])
def test_sweeps(spark, seed):
    rows = data(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    by_second = active(rows)
    over = intervals.overlap_segments(df, ["key"], "member").collect()
    assert {(r["key"], t): set(r["members"]) for r in over for t in range(r["start_s"], r["end_s"])} == {k: v for k, v in by_second.items() if len(v) > 1}
    whole = intervals.attribute_segments(df, ["key"], "member").collect()
    assert {(r["key"], t): set(r["members"]) for r in whole for t in range(r["start_s"], r["end_s"])} == {k: v for k, v in by_second.items() if v}
    assert all(r["coverage"] == len(r["members"]) and list(r["members"]) == sorted(r["members"]) for r in whole)
    for r in whole:  # as long as can be
        assert by_second.get((r["key"], r["start_s"] - 1)) != set(r["members"]) and by_second.get((r["key"], r["end_s"])) != set(r["members"])


@pytest.mark.parametrize("width", [1, 7, 3600])
def test_max_concurrency(spark, width):
    rows = [r for r in data(7) if r[3] > r[2]]
    most = max(sum(a <= t < b for _, _, a, b in rows) for t in range(230))
    assert intervals.max_concurrency(spark.createDataFrame(rows, SCHEMA), width=width).first()[0] == most
    touching = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 5, 9)], SCHEMA)
    assert intervals.max_concurrency(touching, width=width).first()[0] == 1
    assert intervals.max_concurrency(spark.createDataFrame([], SCHEMA), width=width).first()[0] == 0


def test_dyadic_cover_is_exact_and_least(spark):
    def fewest(a, b, zoom):
        n = 0
        while a < b:
            size = (a & -a) or 1 << (zoom - 1)
            while size > b - a or size > 1 << (zoom - 1):
                size >>= 1
            a, n = a + size, n + 1
        return n

    rows = [(a, b) for a in range(33) for b in range(a, 33)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = defaultdict(list)
    for r in intervals.dyadic_cover(df, "a", "b", zoom=5).collect():
        got[r["a"], r["b"]].append((r["zt"], r["vt"]))
    for a, b in rows:
        blocks = got[a, b]
        covered = sorted(t for z, v in blocks for t in range(v << (5 - z), (v + 1) << (5 - z)))
        assert covered == list(range(a, b)) and len(blocks) == fewest(a, b, 5)
        assert all(1 <= z <= 5 for z, _ in blocks)
    top = spark.createDataFrame([(0, 1 << 32)], "a long, b long")
    assert sorted((r["zt"], r["vt"]) for r in intervals.dyadic_cover(top, "a", "b").collect()) == [(1, 0), (1, 1)]
    with pytest.raises(PySparkException):
        intervals.dyadic_cover(spark.createDataFrame([(-1, 5)], "a long, b long"), "a", "b").collect()


def test_interval_and_asof_joins(spark):
    rnd = random.Random(4)
    ivs = data(4)
    points = [(rnd.randrange(4), i, rnd.randrange(230)) for i in range(80)]
    p = spark.createDataFrame(points, "key int, id int, t long")
    i = spark.createDataFrame(ivs, SCHEMA)
    want = sorted((pid, a, b, m) for k, pid, t in points for kk, m, a, b in ivs if k == kk and a <= t < b)
    for got in (joins.interval_join(p, i, ["key"], "t"), joins.bucketed_interval_join(p, i, ["key"], "t", 10)):
        assert sorted((r["id"], r["i_start_s"], r["i_end_s"], r["i_member"]) for r in got.collect()) == want
    samples = [(k, t, f"{k}/{t}") for k in range(3) for t in sorted(rnd.sample(range(20, 200), 15))]
    s = spark.createDataFrame(samples, "key int, at long, name string")
    for within in (True, False):
        for r in joins.asof_join(p, s, ["key"], "t", "at", within=within).collect():
            own = [x for x in samples if x[0] == r["key"]]
            past = [x for x in own if x[1] <= r["t"]]
            known = past and (not within or r["t"] <= own[-1][1])
            assert r["s_name"] == (past[-1][2] if known else None)


def test_what_explode_made_of_a_row_is_not_broadcast(spark):
    """Its size is told from the row alone; the driver could not hold it."""
    many = spark.range(1).selectExpr("1 as key", "explode(sequence(0L, 99L)) as start_s").selectExpr("key", "start_s % 7 as member", "start_s", "start_s + 5 as end_s")
    asked = many.selectExpr("key", "start_s as t")
    for made in (joins.dyadic_interval_join(asked, many, ["key"], "t"), intervals.active_sets(many, ["key"], "member")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_segments_pick_their_members_from_a_row_a_bucket(spark):
    """Pairs of a segment and a member are not dealt out and grouped again."""
    rows = spark.createDataFrame([(k, m, a, a + 40) for k in range(3) for m in range(30) for a in range(m, 400 + m, 50)], "key int, member int, start_s int, end_s int")
    made = intervals.active_sets(rows, ["key"], "member")
    above = made._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    assert "Aggregate" not in above and "Exchange" not in above
    assert made.exceptAll(intervals.active_sets(rows, ["key"], "member", merged=True)).isEmpty()
    assert {(r["start_s"], r["end_s"]): r["members"] for r in made.where("key = 1 and end_s <= 3").collect()} == {(i, i + 1): list(range(i + 1)) for i in range(3)}
