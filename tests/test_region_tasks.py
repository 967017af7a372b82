"""Normal forms of regions in tasks, against the loop over all regions and against a plain one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.functions.cells import CELL
from tesseral.operators import algebra, regions

from .helpers import atoms_of, by_region, cell, frame, parts, prefix, random_cells
from .helpers import regions as random_regions


def plain(cells, one_pair=False):
    """Cell by cell: drop what is subsumed, merge on the first axis, start again."""
    cells = {tuple(c) for c in cells}

    def inside(a, b):
        return all(b[1 + i] <= a[1 + i] and a[5 + i] >> (a[1 + i] - b[1 + i]) == b[5 + i] for i in range(4))

    while True:
        cells = {a for a in cells if not any(a != b and inside(a, b) for b in cells)}
        for i in range(4):
            pairs = {}
            for c in cells:
                if c[1 + i] > 1:
                    z, v = list(c[1:5]), list(c[5:9])
                    z[i] -= 1
                    v[i] >>= 1
                    pairs.setdefault((tuple(z), tuple(v)), []).append(c)
            full = sorted((k for k, v in pairs.items() if len(v) == 2), key=lambda k: (tuple(z + (j == i) for j, z in enumerate(k[0])), k[1]))
            if full:
                for k in full[: 1 if one_pair else None]:
                    cells -= set(pairs[k])
                    cells.add((pairs[k][0][0], *k[0], *k[1]))
                break
        else:
            return cells


@pytest.mark.parametrize("axes", ["x", "xy", "xyf", "xyft"])
def test_random_regions(spark, axes):
    cells = random_regions(261009 + len(axes), 60, axes, size=30, high=5)
    df = frame(spark, cells, True)
    got = by_region(regions.normalize_regions(df, ["region"]), 60)
    one = by_region(regions.normalize_regions(df, ["region"], one_pair=True), 60)
    working = dict.fromkeys(axes, 5)
    for before, batch, pair in zip(cells, got, one, strict=True):
        assert set(batch) == plain(before) and len(set(batch)) == len(batch)
        assert set(pair) == plain(before, one_pair=True)
        if len(axes) < 3:
            assert atoms_of(batch, working) == atoms_of(before, working) == atoms_of(pair, working)
        if axes == "x":  # there the normal form is one
            assert set(batch) == set(pair)


def test_equal_to_the_loop(spark):
    cells = random_regions(5, 12, "xy", size=40, high=5)
    df = frame(spark, cells, True)
    key = lambda r: tuple(r)
    want = sorted(map(key, algebra.normalize_mixed(df, ["region"]).select("region", *CELL).collect()))
    assert sorted(map(key, regions.normalize_regions(df, ["region"]).collect())) == want
    # Some regions, and then all, are too large for a task.
    for large in (20, 0):
        assert sorted(map(key, regions.normalize_regions(df, ["region"], large=large).select("region", *CELL).collect())) == want
    with pytest.raises(ValueError, match="pair by pair"):
        regions.normalize_regions(df, ["region"], large=20, one_pair=True)


def test_full_grids_and_wide_keys(spark):
    grid = [cell(x=(4, i), y=(4, j), f=(4, k)) for i in range(16) for j in range(16) for k in range(16) if (i, j, k) != (15, 15, 15)]
    df = frame(spark, [grid], True)
    got = {tuple(r) for r in regions.normalize_regions(df, ["region"]).select(*CELL).collect()}
    assert got == {tuple(r) for r in algebra.normalize_uniform(df, {"x": 4, "y": 4, "f": 4}, ["region"]).select(*CELL).collect()}
    assert sum(2 ** (12 - sum(z for z, _ in parts(r).values())) for r in got) == 4095
    wide = [cell(x=(32, 2**32 - 1 - i), y=(32, 5), f=(31, 7), t=(31, 9)) for i in range(4)]
    (row,) = regions.normalize_regions(frame(spark, [wide], True), ["region"]).select(*CELL).collect()
    assert tuple(row) == cell(x=(30, 2**30 - 1), y=(32, 5), f=(31, 7), t=(31, 9))


def test_two_normal_forms(spark):
    cells = [cell(x=prefix(a), y=prefix(b)) for a, b in (("000", "0"), ("001", "0"), ("00", "00"), ("01", "00"))]
    df = frame(spark, [cells], True)
    (batch,) = by_region(regions.normalize_regions(df, ["region"]), 1)
    assert set(batch) == plain(cells)
    assert set(by_region(algebra.normalize_mixed(df, ["region"]), 1)[0]) == set(batch)


def test_one_pair_and_counters(spark):
    cells = random_regions(77, 20, "xyf", size=20, high=3)
    df = frame(spark, cells, True).distinct()
    got = by_region(regions.merge_one_pair(df, ["region"]), 20)
    for before, after in zip(cells, got, strict=True):
        before = set(before)
        if set(after) == before:
            made = regions.region_of(np.array([c[1:5] for c in before]), np.array([c[5:9] for c in before]))
            assert all(not regions.merge_axis(dict(made), a, 1) for a in range(4))
        else:
            gone = before - set(after)
            assert len(gone) == 2 and len(set(after)) in (len(before) - 1, len(before) - 2)
    single = frame(spark, sorted(set(cells[0])))
    assert set(map(tuple, regions.merge_one_pair(single).collect())) == set(got[0])
    for r in regions.normalize_counters(df, ["region"]).collect():
        assert r["cells"] == len(set(cells[r["region"]])) and r["normal"] == len(plain(cells[r["region"]])) == r["cells"] - r["dropped"] - r["merged"]


def test_odd_regions(spark):
    df = frame(spark, [random_cells(random.Random(1), 5, "xy")], True)
    assert regions.normalize_regions(df.limit(0), ["region"]).count() == 0
    assert regions.merge_one_pair(df.limit(0), ["region"]).count() == 0 == regions.merge_one_pair(df.limit(0).drop("region")).count()
    null = df.withColumn("region", F.lit(None).cast("int"))
    assert regions.normalize_regions(null, ["region"]).count() == regions.normalize_regions(df, ["region"]).count()
    mixed = frame(spark, [[cell(x=(2, 1)), cell(y=(2, 1))]], True)
    with pytest.raises(Exception, match="different axes"):
        regions.normalize_regions(mixed, ["region"]).collect()
