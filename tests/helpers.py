"""Cells as tuples and brute force over their atoms."""

import itertools
import random

from tesseral.functions.cells import AXES, BIT, CELL

SCHEMA = "flags int, " + ", ".join(f"z{a} int" for a in AXES) + ", " + ", ".join(f"v{a} long" for a in AXES)


def cell(**axes):
    """cell(x=(zoom, value), ...) as a row."""
    z = [axes.get(a, (0, 0)) for a in AXES]
    return (sum(BIT[a] for a in axes), *(p[0] for p in z), *(p[1] for p in z))


def parts(row):
    """{axis: (zoom, value)} of a row."""
    row = tuple(row)[-9:]
    return {a: (row[1 + i], row[5 + i]) for i, a in enumerate(AXES) if row[0] & BIT[a]}


def atoms_of(cells, working):
    """The set of atoms (one value an axis) that cells cover."""
    out = set()
    for c in cells:
        spans = []
        for a, (z, v) in parts(c).items():
            n = working[a] - z
            assert n >= 0
            spans.append(range(v << n, (v + 1) << n))
        out |= set(itertools.product(*spans))
    return out


def random_cells(rnd, n, axes, low=1, high=4):
    out = []
    for _ in range(n):
        made = {}
        for a in axes:
            z = rnd.randint(low, high)
            made[a] = (z, rnd.randrange(1 << z))
        out.append(cell(**made))
    return out


def frame(spark, cells, regions=None):
    """A DataFrame of cells, with a region number for each if there are several lists."""
    if regions is None:
        return spark.createDataFrame(list(cells), SCHEMA)
    rows = [(r, *c) for r, cs in enumerate(cells) for c in cs]
    return spark.createDataFrame(rows, "region int, " + SCHEMA)


def by_region(df, n):
    out = [[] for _ in range(n)]
    for r in df.select("region", *CELL).collect():
        out[r["region"]].append(tuple(r)[1:])
    return out


def prefix(bits):
    """(zoom, value) of a prefix written in binary digits."""
    return len(bits), int(bits, 2)


def regions(seed, n, axes, size=6, high=4):
    rnd = random.Random(seed)
    return [random_cells(rnd, rnd.randint(1, size), axes, high=high) for _ in range(n)]
