import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesseral.functions.cells import CELL, compatible, is_valid, meet, subsumes
from tesseral.operators import algebra, joins, neighbors
from tesseral.sources import generators
from tests.helpers import SCHEMA, atoms_of, by_region, cell, frame, parts, prefix, random_cells, regions


def working(axes, z=5):
    return dict.fromkeys(axes, z)


def py_compatible(a, b):
    return all(min(za, zb) == 0 or va >> (za - min(za, zb)) == vb >> (zb - min(za, zb)) for (za, va), (zb, vb) in zip(parts(a).values(), parts(b).values(), strict=True))


def py_subsumes(a, b):
    return all(za <= zb and va == vb >> (zb - za) for (za, va), (zb, vb) in zip(parts(a).values(), parts(b).values(), strict=True))


@pytest.mark.parametrize("axes", ["x", "xy", "xyf", "xyft"])
def test_joins_are_their_predicates(spark, axes):
    rnd = random.Random(261007)
    a, b = random_cells(rnd, 120, axes, high=5), random_cells(rnd, 120, axes, high=5)
    left, right = frame(spark, set(a)), frame(spark, set(b))
    over = {(tuple(r)[:9], tuple(r)[9:]) for r in joins.overlap_join(left, right).collect()}
    assert over == {(p, q) for p in set(a) for q in set(b) if py_compatible(p, q)}
    inside = {(tuple(r)[:9], tuple(r)[9:]) for r in joins.containment_join(left, right).collect()}
    assert inside == {(p, q) for p in set(a) for q in set(b) if py_subsumes(p, q)}
    semi = {tuple(r) for r in joins.covered(left, right).collect()}
    assert semi == {q for _, q in inside}
    assert {tuple(r) for r in joins.covered(left, right, how="left_anti").collect()} == set(b) - semi
    both = joins.prefixed(left, "a_").crossJoin(joins.prefixed(right, "b_"))
    row = both.select(F.count_if(compatible("a_", "b_")), F.count_if(subsumes("a_", "b_"))).first()
    assert tuple(row) == (len(over), len(inside))
    for r in both.where(compatible("a_", "b_")).select(F.struct(*["a_" + c for c in CELL]).alias("a"), F.struct(*["b_" + c for c in CELL]).alias("b"), F.struct(*meet("a_", "b_")).alias("m")).limit(200).collect():
        w = working(axes)
        assert atoms_of([tuple(r["m"])], w) == atoms_of([tuple(r["a"])], w) & atoms_of([tuple(r["b"])], w)


def test_join_plans_have_no_nested_loop(spark):
    a, b = (generators.mixed_random_4d(spark, 200, seed=s) for s in (1, 2))
    plan = joins.containment_join(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("axes", ["x", "xy", "xyf"])
def test_normal_forms(spark, axes):
    n = 60
    regs = regions(261009, n, axes, size=14)
    df = frame(spark, regs, True)
    got = by_region(algebra.normalize(df, ["region"]), n)
    again = by_region(algebra.normalize(frame(spark, got, True), ["region"]), n)
    for region, normal, twice in zip(regs, got, again, strict=True):
        w = working(axes)
        assert atoms_of(normal, w) == atoms_of(region, w)
        assert sorted(normal) == sorted(twice)
        assert not any(p != q and py_subsumes(p, q) for p in normal for q in normal)
        for p, q in itertools.combinations(normal, 2):
            differ = [a for a in axes if parts(p)[a] != parts(q)[a]]
            if len(differ) == 1:
                (zp, vp), (zq, vq) = parts(p)[differ[0]], parts(q)[differ[0]]
                assert not (zp == zq > 1 and vp ^ 1 == vq)


@pytest.mark.parametrize("axes", ["x", "xy", "xyf"])
def test_uniform_regions_close_like_the_loop(spark, axes):
    rnd = random.Random(5)
    regs = [[cell(**{a: (3, rnd.randrange(8)) for a in axes}) for _ in range(rnd.randint(1, 60))] for _ in range(12)]
    df = frame(spark, regs, True)
    uniform = by_region(algebra.normalize_uniform(df, dict.fromkeys(axes, 3), ["region"]), 12)
    loop = by_region(algebra.normalize_mixed(df, ["region"]), 12)
    assert [sorted(r) for r in uniform] == [sorted(r) for r in loop]


def test_two_normal_forms(spark):
    start = [cell(x=prefix("000"), y=prefix("0")), cell(x=prefix("001"), y=prefix("0")), cell(x=prefix("00"), y=prefix("00")), cell(x=prefix("01"), y=prefix("00"))]
    stats = []
    got = algebra.normalize_mixed(frame(spark, start), stats=stats)
    assert {tuple(r) for r in got.collect()} == {cell(x=prefix("00"), y=prefix("0")), cell(x=prefix("0"), y=prefix("00"))}
    assert stats[0]["merged_x"] == 2 and stats[-1]["cells"] == 2


def test_hand_examples(spark):
    def one(f, *bits):
        return sorted((f"{r['vx']:0{r['zx']}b}" for r in f(*(frame(spark, [cell(x=prefix(b)) for b in group]) for group in bits)).collect()), key=lambda b: (len(b), b))

    assert one(algebra.difference, ["10"], ["101"]) == ["100"]
    assert one(algebra.difference, ["10"], ["1011"]) == ["100", "1010"]
    assert one(algebra.difference, ["10"], ["101111"]) == ["100", "1010", "10110", "101110"]
    assert one(algebra.normalize, ["100", "1010", "1011"]) == ["10"]


def test_whole_axis_is_two_cells(spark):
    for n in (1 << 10, 1 << 17):
        got = {tuple(r) for r in algebra.normalize(generators.merge_heavy_1d(spark, n)).collect()}
        assert got == {cell(x=(1, 0)), cell(x=(1, 1))}
    chain = algebra.normalize(generators.antichain_1d(spark, 500))
    assert chain.count() == 500
    assert algebra.normalize(generators.anisotropic_merge_2d(spark, 256)).count() == 4
    assert algebra.normalize(generators.merge_heavy_1d(spark, 100_000, 20)).count() == bin(100_000).count("1")


@pytest.mark.parametrize(("axes", "n"), [("x", 40), ("xy", 40), ("xyf", 15)])
def test_set_operations(spark, axes, n):
    a, b = regions(261015, n, axes), regions(261016, n, axes)
    da, db = frame(spark, a, True), frame(spark, b, True)
    w = working(axes)
    union = by_region(algebra.union(da, db, ["region"]), n)
    both = by_region(algebra.intersection(da, db, ["region"]), n)
    left = by_region(algebra.difference(da, db, ["region"]), n)
    for i in range(n):
        p, q = atoms_of(a[i], w), atoms_of(b[i], w)
        assert atoms_of(union[i], w) == p | q
        assert atoms_of(both[i], w) == p & q
        assert atoms_of(left[i], w) == p - q


def test_chained_operations(spark):
    regs = [regions(261018 + k, 10, "xy") for k in range(3)]
    a, b, c = (frame(spark, r, True) for r in regs)
    got = by_region(algebra.difference(algebra.union(a, b, ["region"]), algebra.intersection(b, c, ["region"]), ["region"]), 10)
    w = working("xy")
    for i in range(10):
        p, q, r = (atoms_of(x[i], w) for x in regs)
        assert atoms_of(got[i], w) == (p | q) - (q & r)
    same = {r["region"]: r["equal"] for r in algebra.semantic_equal(a, a.unionByName(a), w, ["region"]).collect()}
    assert all(same.values())
    sym = by_region(algebra.symmetric_difference(a, b, ["region"]), 10)
    assert all(atoms_of(sym[i], w) == atoms_of(regs[0][i], w) ^ atoms_of(regs[1][i], w) for i in range(10))


def test_working_zoom_limits_difference(spark):
    a, b = frame(spark, [cell(x=(1, 1))]), frame(spark, [cell(x=prefix("10111"))])
    got = {tuple(r) for r in algebra.difference(a, b, working={"x": 3}).collect()}
    assert got == {cell(x=prefix("11")), cell(x=prefix("100"))}  # what overlaps below zoom 3 is dropped


def test_refine_coarsen_atoms(spark):
    cells = random_cells(random.Random(3), 30, "xy", high=3)
    df = frame(spark, cells)
    w = working("xy", 6)
    fine = [tuple(r) for r in algebra.refine(df, ["x", "y", "x"]).select(*CELL).collect()]
    assert len(fine) == 8 * len(cells) and atoms_of(fine, w) == atoms_of(cells, w)
    grid = {tuple(r) for r in algebra.atoms(df, {"x": 4, "y": 4}).collect()}
    assert {(r[5], r[6]) for r in grid} == atoms_of(cells, working("xy", 4))
    assert {tuple(r) for r in algebra.coarsen(df, {"x": 1, "y": 1}).collect()} == {cell(x=(1, parts(c)["x"][1] >> (parts(c)["x"][0] - 1)), y=(1, parts(c)["y"][1] >> (parts(c)["y"][0] - 1))) for c in cells}
    for bad in (lambda: algebra.coarsen(df, {"x": 9}), lambda: algebra.atoms(df, {"x": 1, "y": 1}), lambda: algebra.refine(frame(spark, [cell(x=(32, 0))]), ["x"])):
        with pytest.raises(PySparkException):
            bad().collect()
    with pytest.raises(ValueError):
        algebra.refine(df, ["q"])


def test_validity_and_domains(spark):
    rows = [cell(x=(2, 3)), cell(x=(2, 4)), (8, 0, 0, 0, 0, 0, 0, 0, 0), (0,) * 9, cell(x=(33, 0))]
    assert [r[0] for r in spark.createDataFrame(rows, SCHEMA).coalesce(1).select(is_valid()).collect()] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        algebra.normalize(frame(spark, [cell(x=(2, 1)), cell(y=(3, 1))]))
    assert algebra.normalize(frame(spark, [])).count() == 0


def test_neighbors(spark):
    line = frame(spark, [cell(x=(3, 0)), cell(x=(3, 7))])
    step = lambda b: sorted((r["vx"], r["offset_id"]) for r in neighbors.neighbors(line, [{"x": -1}, {"x": 1}], b).collect())
    assert step("reject") == [(1, 1), (6, 0)]
    assert step("wrap") == [(0, 1), (1, 1), (6, 0), (7, 0)]
    assert step("clamp") == [(0, 0), (1, 1), (6, 0), (7, 1)]
    with pytest.raises(ValueError):
        step("bounce")
    carry = {"011": "100", "01111011": "01111100", "100010100": "100010101"}
    for a, b in carry.items():
        got = neighbors.neighbors(frame(spark, [cell(x=prefix(a))]), [{"x": 1}]).first()
        assert (got["zx"], got["vx"]) == prefix(b)


def test_morphology_on_a_grid(spark):
    rnd = random.Random(260903)
    cells = {(rnd.randrange(8), rnd.randrange(8)) for _ in range(40)}
    df = frame(spark, [cell(x=(3, x), y=(3, y)) for x, y in cells])
    steps = [{"x": 1}, {"x": -1}, {"y": 1}, {"y": -1}]
    d = [(o.get("x", 0), o.get("y", 0)) for o in steps]
    values = lambda out: {(r["vx"], r["vy"]) for r in out.collect()}
    inside = lambda p: 0 <= p[0] < 8 and 0 <= p[1] < 8
    assert values(neighbors.grid_dilate(df, steps)) == cells | {q for x, y in cells for a, b in d if inside(q := (x + a, y + b))}
    eroded = {(x, y) for x, y in cells if all((x + a, y + b) in cells for a, b in d)}
    assert values(neighbors.grid_erode(df, steps)) == eroded
    assert values(neighbors.grid_frontier(df, steps)) == cells - eroded
    dilated = algebra.atoms(neighbors.dilate(df, steps), {"x": 3, "y": 3})
    assert cells <= values(dilated)


def test_index_maintenance(spark):
    a = frame(spark, [cell(x=(3, i)) for i in range(4)])
    more = algebra.add_cells(a, frame(spark, [cell(x=(3, 3)), cell(x=(3, 5))]))
    assert more.count() == 5
    assert algebra.discard_cells(more, frame(spark, [cell(x=(3, 0)), cell(x=(3, 7))])).count() == 4
    with pytest.raises(KeyError):
        algebra.discard_cells(more, frame(spark, [cell(x=(3, 7))]), must_exist=True)


def test_enclosing(spark):
    df = frame(spark, [cell(x=(4, v), y=(4, 3)) for v in (4, 5, 7)])
    assert tuple(algebra.enclosing_cell(df).first()) == cell(x=(2, 1), y=(4, 3))
    split = frame(spark, [cell(x=(4, v), y=(4, 3)) for v in (4, 12)])
    assert tuple(algebra.enclosing_cell(split).first()) == cell(y=(4, 3))
    assert {tuple(r) for r in algebra.enclosing_cover(split).collect()} == {(*cell(x=(4, 4), y=(4, 3)), 1), (*cell(x=(4, 12), y=(4, 3)), 1)}
    assert algebra.enclosing_cell(frame(spark, [])).count() == 0
