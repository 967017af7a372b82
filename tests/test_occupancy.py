import itertools
import random

import pytest

from tesseral.operators import occupancy

SCHEMA = "ix long, iy long, ih long"


def voxels(df):
    return {(r["ix"], r["iy"], r["ih"]) for r in df.collect()}


def some(seed, n=220, size=9):
    rnd = random.Random(seed)
    return {tuple(rnd.randrange(size) for _ in range(3)) for _ in range(n)}


def frame(spark, cells):
    return spark.createDataFrame(sorted(cells), SCHEMA)


CUBE = list(itertools.product((-1, 0, 1), repeat=3))
FACES = [d for d in CUBE if sum(map(abs, d)) == 1]


def add(p, d):
    return tuple(a + b for a, b in zip(p, d, strict=True))


@pytest.mark.parametrize("k", [1, 2])
def test_closing(spark, k):
    cells = some(1, 60)
    grown = set(cells)
    for _ in range(k):
        grown = {add(p, d) for p in grown for d in CUBE}
    for _ in range(k):
        grown = {p for p in grown if all(add(p, d) in grown for d in CUBE)}
    assert voxels(occupancy.close(frame(spark, cells), k)) == grown
    assert cells <= grown


def test_directional_fill(spark):
    cells = some(2)
    box = set(itertools.product(range(9), repeat=3))
    rows = {}
    for side, test in {"west": lambda p, q: q[0] < p[0] and q[1:] == p[1:], "east": lambda p, q: q[0] > p[0] and q[1:] == p[1:], "above": lambda p, q: q[2] > p[2] and q[:2] == p[:2], "south": lambda p, q: q[1] > p[1] and (q[0], q[2]) == (p[0], p[2]), "north": lambda p, q: q[1] < p[1] and (q[0], q[2]) == (p[0], p[2])}.items():
        rows[side] = {p for p in box if any(test(p, q) for q in cells)}
    for sides in (("west", "east", "above"), ("west", "east", "above", "north", "south")):
        want = cells | set.intersection(*(rows[s] for s in sides))
        assert voxels(occupancy.directional_fill(frame(spark, cells), sides)) == want
    with pytest.raises(ValueError):
        occupancy.directional_fill(frame(spark, cells), ("above",))


def flooded(cells):
    low = [min(p[i] for p in cells) - 1 for i in range(3)]
    high = [max(p[i] for p in cells) + 1 for i in range(3)]
    seen, todo = {tuple(low)}, [tuple(low)]
    while todo:
        p = todo.pop()
        for d in FACES:
            q = add(p, d)
            if q not in seen and q not in cells and all(a <= x <= b for a, x, b in zip(low, q, high, strict=True)):
                seen.add(q)
                todo.append(q)
    return set(itertools.product(*(range(a, b + 1) for a, b in zip(low, high, strict=True)))) - seen


def test_flood_fill(spark):
    hollow = {p for p in itertools.product(range(7), repeat=3) if any(x in (0, 6) for x in p)}
    leaky = (hollow | {(3, 3, 3)}) - {(0, 3, 3)}
    rows = [(r, *p) for r, cells in enumerate((hollow, leaky, some(3, 420, 8))) for p in sorted(cells)]
    got = occupancy.flood_fill(spark.createDataFrame(rows, "region int, " + SCHEMA), ["region"]).collect()
    for r, cells in enumerate((hollow, leaky, some(3, 420, 8))):
        assert {(x["ix"], x["iy"], x["ih"]) for x in got if x["region"] == r} == flooded(cells)
    assert voxels(occupancy.flood_fill(frame(spark, hollow))) == set(itertools.product(range(7), repeat=3))


def test_boundary_and_origin(spark):
    raw = some(4, 120, 6)
    closed = voxels(occupancy.close(frame(spark, raw), 1))
    solid = voxels(occupancy.directional_fill(frame(spark, closed)))
    edge = {p for p in solid if any(add(p, d) not in solid for d in FACES)}
    assert voxels(occupancy.boundary(frame(spark, solid))) == edge
    got = {(r["ix"], r["iy"], r["ih"]): r["origin"] for r in occupancy.classify_exposed(frame(spark, raw), frame(spark, closed), frame(spark, solid)).collect()}
    assert got == {p: "raw" if p in raw else "closed" if p in closed else "fill" for p in edge}
    sizes = occupancy.set_sizes(frame(spark, raw), frame(spark, closed), frame(spark, solid)).first()
    assert (sizes["raw"], sizes["closed_added"], sizes["fill_added"], sizes["solid"], sizes["raw_lost"]) == (len(raw), len(closed - raw), len(solid - closed - raw), len(solid), 0)


def test_largest_block(spark):
    cells = some(6, 300, 8) | set(itertools.product(range(4, 8), range(2, 4), range(4)))
    full = {}
    for dx, dy, dh in itertools.product(range(3), repeat=3):
        for b in {(x >> dx, y >> dy, h >> dh) for x, y, h in cells}:
            block = itertools.product(*(range(v << d, (v + 1) << d) for v, d in zip(b, (dx, dy, dh), strict=True)))
            if all(p in cells for p in block):
                full[dx, dy, dh, *b] = 1 << (dx + dy + dh)
    most = max(full.values())
    got = {tuple(r) for r in occupancy.max_inscribed(frame(spark, cells), (2, 2, 2)).collect()}
    assert got == {(*k, v) for k, v in full.items() if v == most} and most >= 32


def test_points(spark):
    points = spark.createDataFrame([(0.1, 0.1, 0.1), (0.2, 0.2, 0.3), (5.0, 5.0, -1.0)], "e double, n double, u double")
    assert occupancy.crop(points, {"u": 0.0}, {"e": 0.2}).count() == 2
    assert occupancy.downsample(points, 1.0).count() == 2
    v = occupancy.voxelize(points, 0.5, (0.0, 0.0, -1.0))
    assert voxels(v) == {(0, 0, 2), (10, 10, 0)}
    assert {tuple(r) for r in occupancy.voxel_centers(v, 0.5, (0.0, 0.0, -1.0)).collect()} == {(0.25, 0.25, 0.25), (5.25, 5.25, -0.75)}
    assert occupancy.quantize(points, 37.5, 139.9, 220.0, 24, 14).count() == 2  # tiles of two metres


def test_local_boxes(spark):
    from tests.helpers import SCHEMA as CELLS
    from tests.helpers import cell

    one = cell(x=(20, 931_000), y=(20, 405_000), f=(14, 8300))
    lat, lon = 36.5, 139.6
    boxes = occupancy.local_bounds(spark.createDataFrame([one, cell(x=(19, 465_500), y=(19, 202_500), f=(14, 8300))], CELLS), lat, lon).collect()
    small, large = sorted(boxes, key=lambda r: -r["zx"])
    assert 25 < small["high_e"] - small["low_e"] < 45 and 1.9 < small["high_u"] - small["low_u"] < 2.1
    assert large["low_e"] <= small["low_e"] and large["high_n"] >= small["high_n"]
    best = occupancy.largest_by_volume(spark.createDataFrame(boxes)).collect()
    assert [r["zx"] for r in best] == [19]
