"""Triangle meshes in OBJ files, read by byte ranges.

An OBJ file numbers its vertices by their place in the file, and a face names them by number or by how far back they stand. So a range
of lines can't be understood alone: a first pass counts each range's vertices and faces, running sums give each range its first numbers, and
then vertices and faces of all ranges are told apart and joined by number.

spark.dataSource.register(ObjSource) is done by the functions here. A line belongs to the range in which it begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesseral.sources.ply import _open_fs

RANGE_BYTES = 16 << 20
BLOCK, ROWS = 1 << 20, 50_000
#: A range of short lines makes more than a million corners, so they are dealt to several tasks.
TASKS_PER_RANGE = 4
_SCHEMAS = {
    "count": "file string, range long, vertices long, faces long, object string",
    "v": "file string, range long, place long, x double, y double, z double",
    "f": "file string, range long, place long, before long, corners array<long>, object string",
}
_ARROW = {
    "count": [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()],
    "v": [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()],
    "f": [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()],
}


@dataclass
class _Range(InputPartition):
    path: str
    number: int
    first: int
    last: int


def lines_of(files: fs.FileSystem, path: str, first: int, last: int) -> Iterator[bytes]:
    """The lines that begin at bytes first to last - 1 of a file, without their ends."""
    with files.open_input_file(path) as f:
        at = max(0, first - 1)
        f.seek(at)
        held, began = b"", at
        skip = first > 0  # up to the first line that begins in the range
        while True:
            block = f.read(BLOCK)
            if not block:
                if held and not skip and began < last:
                    yield held
                return
            parts = (held + block).split(b"\n")
            for line in parts[:-1]:
                if skip:
                    skip = False
                elif began < last:
                    yield line
                began += len(line) + 1
                if began >= last:
                    return
            held = parts[-1]


class ObjReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "f")
        self.bytes = int(options.get("bytespertask", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        files, root = _open_fs(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else [x for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
        out = [_Range(x.path, i, a, min(a + self.bytes, x.size)) for x in sorted(found, key=lambda x: x.path) for i, a in enumerate(range(0, x.size, self.bytes))]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _open_fs(self.path)
        names = [c.split()[0] for c in _SCHEMAS[self.kind].split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW[self.kind], strict=True)], names=names)
        file, number = partition.path, partition.number
        vertices = faces = 0
        current, rows = None, []
        for line in lines_of(files, file, partition.first, partition.last):
            words = line.split()
            if not words:
                continue
            if words[0] == b"v":
                if self.kind == "v":
                    rows.append((file, number, vertices, *map(float, words[1:4])))
                vertices += 1
            elif words[0] == b"f":
                if self.kind == "f":
                    rows.append((file, number, faces, vertices, [int(w.partition(b"/")[0]) for w in words[1:]], current))
                faces += 1
            elif words[0] in (b"o", b"g"):
                current = b" ".join(words[1:]).decode("utf-8", "replace")
            if len(rows) >= ROWS:
                yield batch(rows)
                rows = []
        if self.kind == "count":
            rows = [(file, number, vertices, faces, current)]
        if rows:
            yield batch(rows)


class ObjSource(DataSource):
    """Options: kind (v, f or count), bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "obj_ranges"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("kind", "f")]

    def reader(self, schema) -> ObjReader:  # noqa: ANN001
        return ObjReader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Mesh:
    vertices: DataFrame  #: file, number (from 1), x, y, z
    faces: DataFrame  #: file, face (from 0), object, corners (numbers of vertices)
    ranges: int  #: how many ranges the files have


def read_mesh(spark: SparkSession, path: str, bytes_per_task: int = RANGE_BYTES) -> Mesh:
    """The vertices and faces of an OBJ file, or of all files of a folder, each numbered for itself.

    Texture and normal numbers of corners, and all other kinds of lines, are skipped. A face's object is the last `o` or `g` line
    before it, null before the first. Faces with less than three corners, or with corners that no vertex stands for, fail when they are used.
    """
    spark.dataSource.register(ObjSource)
    read = lambda kind: spark.read.format(ObjSource.name()).option("kind", kind).option("bytesPerTask", bytes_per_task).load(path)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # One short row a range, sent to all tasks.
    bases = F.broadcast(read("count").select(
        "file", "range", F.coalesce(F.sum("vertices").over(before), zero).alias("_v"), F.coalesce(F.sum("faces").over(before), zero).alias("_f"), F.last("object", ignorenulls=True).over(before).alias("_o"),
    ))
    ranges = len(ObjReader({"path": path, "bytespertask": bytes_per_task}).partitions())
    vertices = read("v").join(bases, ["file", "range"]).select("file", (F.col("_v") + F.col("place") + 1).alias("number"), "x", "y", "z")
    seen = F.col("_v") + F.col("before")
    corners = F.transform("corners", lambda c: F.when(c < 0, seen + c + 1).otherwise(c)).alias("corners")
    faces = read("f").join(bases, ["file", "range"]).select("file", (F.col("_f") + F.col("place")).alias("face"), F.coalesce("object", "_o").alias("object"), corners)
    return Mesh(vertices, faces, ranges)


def triangles(mesh: Mesh) -> DataFrame:
    """file, face, part, object, ax, ay, az, bx, ..., cz: faces cut into triangles that share their first corner, each a row."""
    ok = F.when(F.size("corners") >= 3, F.size("corners") - 3).otherwise(F.raise_error(F.lit("a face has less than three corners")).cast("int"))
    cut = mesh.faces.withColumn("part", F.explode(F.sequence(F.lit(0), ok)))
    which = F.array(F.col("corners")[0], F.get("corners", F.col("part") + 1), F.get("corners", F.col("part") + 2))
    corners = cut.select("file", "face", "part", "object", F.posexplode(which).alias("_at", "number"))
    # A task's share of the corners is that of a part of a range, however large the files are.
    parts = TASKS_PER_RANGE * mesh.ranges
    placed = corners.repartition(parts, "file", "number").join(mesh.vertices.repartition(parts, "file", "number"), ["file", "number"], "left")
    placed = placed.repartition(parts, "file", "face", "part", "object")
    found = F.when(F.count("x") == 3, F.lit(True)).otherwise(F.raise_error(F.lit("a face names a vertex that is not there")).cast("boolean"))
    at = [F.max(F.when(F.col("_at") == i, F.col(c))).alias(n + c) for i, n in enumerate("abc") for c in "xyz"]
    return placed.groupBy("file", "face", "part", "object").agg(found.alias("_ok"), *at).where("_ok").drop("_ok")


def transformed(mesh: Mesh, scale: float, yaw_deg: float) -> Mesh:
    """The mesh scaled and then turned about the upward axis, both about its own origin."""
    turn = F.radians(F.lit(float(yaw_deg)))
    x, y, z = (F.col(c) * scale for c in "xyz")
    return Mesh(mesh.vertices.select("file", "number", (x * F.cos(turn) - y * F.sin(turn)).alias("x"), (x * F.sin(turn) + y * F.cos(turn)).alias("y"), z.alias("z")), mesh.faces, mesh.ranges)
