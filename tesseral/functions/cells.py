"""Cells as flat columns, and the predicates and products of cells.

A cell has up to four axes: x (longitude), y (latitude), f (altitude) and t (time). flags has a bit
for each axis that is there; z<axis> is its zoom (1 to 32) and v<axis> its prefix value below 2 ** zoom.
Absent axes hold zoom 0 and value 0, so most formulas need no case for them. Columns are flat so that
Catalyst can prune them and join on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "f", "t")
BIT = {"x": 8, "y": 4, "f": 2, "t": 1}
ZOOMS = tuple(f"z{a}" for a in AXES)
VALUES = tuple(f"v{a}" for a in AXES)
CELL = ("flags", *ZOOMS, *VALUES)
MAX_ZOOM = 32


def shr(value: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", value.cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def shl(value: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", value.cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def at(name: str, side: str = "") -> Column:
    """A column of a cell; `side` is a prefix of its names."""
    return F.col(side + name)


def truncate(value: Column, zoom: Column, to: Column) -> Column:
    """The first `to` bits of a prefix of `zoom` bits; 0 <= to <= zoom."""
    return shr(value, zoom - to)


def as_cells(df: DataFrame, **axes: tuple[str, str]) -> DataFrame:
    """df with cell columns made of (zoom, value) columns by axis, as in as_cells(df, x=("zx", "ix"))."""
    made = {"flags": F.lit(sum(BIT[a] for a in axes)).cast("int")}
    for a in AXES:
        zoom, value = axes.get(a, (None, None))
        made[f"z{a}"] = (F.col(zoom) if zoom else F.lit(0)).cast("int")
        made[f"v{a}"] = (F.col(value) if value else F.lit(0)).cast("long")
    used = {c for pair in axes.values() for c in pair}
    return df.select(*[c for c in df.columns if c not in used and c not in made], *[v.alias(k) for k, v in made.items()])


def is_valid(side: str = "") -> Column:
    """flags from 1 to 15; zooms from 1 to 32 and values below 2 ** zoom on active axes, zeros on others."""
    tests = [at("flags", side).between(1, 15)]
    for a in AXES:
        z, v = at(f"z{a}", side), at(f"v{a}", side)
        on = at("flags", side).bitwiseAND(BIT[a]) != 0
        tests.append(F.when(on, z.between(1, MAX_ZOOM) & (v >= 0) & (v < shl(F.lit(1), F.least(z, F.lit(MAX_ZOOM))))).otherwise((z == 0) & (v == 0)))
    return reduce(Column.__and__, tests)


def same_domain(a: str, b: str) -> Column:
    return at("flags", a) == at("flags", b)


def require_domain(df: DataFrame, a: str, b: str) -> DataFrame:
    """df, failing when it is run if two cells in a row have different axes."""
    return df.where(F.assert_true(same_domain(a, b), F.lit("cells have different axes")).isNull())


def _each_axis(test) -> Column:  # noqa: ANN001
    return reduce(Column.__and__, (test(a) for a in AXES))


def compatible(a: str, b: str) -> Column:
    """Neither cell leaves the other on any axis: the shorter prefix begins the longer one."""

    def axis(x: str) -> Column:
        za, zb = at(f"z{x}", a), at(f"z{x}", b)
        q = F.least(za, zb)
        return truncate(at(f"v{x}", a), za, q) == truncate(at(f"v{x}", b), zb, q)

    return same_domain(a, b) & _each_axis(axis)


def subsumes(container: str, contained: str) -> Column:
    """Every point of the contained cell lies in the container."""

    def axis(x: str) -> Column:
        zc, zd = at(f"z{x}", container), at(f"z{x}", contained)
        return (zc <= zd) & (at(f"v{x}", container) == truncate(at(f"v{x}", contained), zd, F.least(zc, zd)))

    return same_domain(container, contained) & _each_axis(axis)


def matches(a: str, b: str) -> Column:
    """Overlap where an axis that either cell lacks does not matter."""

    def axis(x: str) -> Column:
        za, zb = at(f"z{x}", a), at(f"z{x}", b)
        q = F.least(za, zb)  # 0 where an axis is absent
        return truncate(at(f"v{x}", a), za, q) == truncate(at(f"v{x}", b), zb, q)

    return _each_axis(axis)


def meet(a: str, b: str) -> list[Column]:
    """The cell columns of the intersection of two compatible cells: the finer prefix on each axis."""
    finer = {x: at(f"z{x}", b) > at(f"z{x}", a) for x in AXES}
    zooms = [F.greatest(at(f"z{x}", a), at(f"z{x}", b)).alias(f"z{x}") for x in AXES]
    values = [F.when(finer[x], at(f"v{x}", b)).otherwise(at(f"v{x}", a)).alias(f"v{x}") for x in AXES]
    return [at("flags", a).alias("flags"), *zooms, *values]


def common_length(va: Column, za: Column, vb: Column, zb: Column) -> Column:
    """How many leading bits two prefixes share."""
    q = F.least(za, zb)
    d = truncate(va, za, q).bitwiseXOR(truncate(vb, zb, q))
    return q - F.when(d == 0, 0).otherwise(F.length(F.bin(d)))


def common_prefix(a: str, b: str) -> list[Column]:
    """Cell columns of the longest common prefix on each axis; an axis without a common first bit is dropped."""
    n = {x: common_length(at(f"v{x}", a), at(f"z{x}", a), at(f"v{x}", b), at(f"z{x}", b)).cast("int") for x in AXES}
    flags = reduce(Column.__add__, (F.when(n[x] > 0, BIT[x]).otherwise(0) for x in AXES))
    values = [F.when(n[x] > 0, truncate(at(f"v{x}", a), at(f"z{x}", a), n[x])).otherwise(F.lit(0).cast("long")).alias(f"v{x}") for x in AXES]
    return [flags.cast("int").alias("flags"), *(n[x].alias(f"z{x}") for x in AXES), *values]


def neighbor_value(value: Column, zoom: Column, step: Column, boundary: str) -> Column:
    """The prefix `step` places on at the same zoom; at the domain's edge null ("reject"), round ("wrap") or the edge ("clamp")."""
    n = shl(F.lit(1), zoom)
    moved = value + step
    if boundary == "reject":
        return F.when((moved >= 0) & (moved < n), moved)
    if boundary == "wrap":
        return F.pmod(moved, n)
    if boundary == "clamp":
        return F.greatest(F.lit(0).cast("long"), F.least(moved, n - 1))
    raise ValueError(f"unknown boundary policy: {boundary}")


def axis_of(name: str) -> str:
    if name not in AXES:
        raise ValueError(f"unknown axis: {name}")
    return name
