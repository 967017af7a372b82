import random

import pytest

from tesseral.operators import occupancy
from tesseral.operators.graph import components


def by_hand(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rnd = random.Random(6)
    for links in ([(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)], [(i, i + 1) for i in range(200)], [(5, 5)], [(0, i) for i in range(50)]):
        df = spark.createDataFrame(links, "u long, v long")
        assert {r["node"]: r["root"] for r in components(df).collect()} == by_hand(links)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = spark.range(4000).selectExpr("id * 7919 % 4001 as u", "(id + 1) * 7919 % 4001 as v")
    assert {r["root"] for r in components(chain, rounds=16).collect()} == {0}


def voxels(spark, cells):
    return spark.createDataFrame(sorted(cells), "ix long, iy long, ih long")


def filled(df):
    return {(r["ix"], r["iy"], r["ih"]) for r in occupancy.flood_fill(df).select("ix", "iy", "ih").collect()}


@pytest.mark.parametrize("hole", [False, True])
def test_a_long_tunnel(spark, hole):
    """A winding tunnel between two floors: with a hole at its end all of it is outside, else all is filled."""
    turns, width = 24, 6
    walls = {(x, y, 1) for y in range(2 * turns + 1) for x in range(width) if x in (0, width - 1) or y % 2 == 0 and (y in (0, 2 * turns) or x != (1 if y % 4 == 0 else width - 2))}
    solid = walls | {(x, y, h) for x in range(width) for y in range(2 * turns + 1) for h in (0, 2)}
    tunnel = {(x, y, 1) for x in range(width) for y in range(2 * turns + 1)} - walls
    if hole:
        solid.discard((2, 2 * turns - 1, 2))
    got = filled(voxels(spark, solid))
    assert got == (solid if hole else solid | tunnel)


def test_points_far_apart(spark):
    cells = {(-(10**12), 0, 0), (10**12, 0, 0), (5, 10**12, 7)}
    assert filled(voxels(spark, cells)) == cells
    assert filled(voxels(spark, [(0, 0, 0)]).limit(0)) == set()
