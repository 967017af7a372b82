"""Point clouds in PLY files as a Spark data source.

spark.dataSource.register(PlySource); spark.read.format("ply").load(path). The fixed-size records of a binary file are
planned as ranges of points, so one large cloud is read by many tasks; an ASCII file is one range. Writing makes one
binary file a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: PLY's number types (fixed values).
_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_SCHEMA = pa.schema([("e", pa.float64()), ("n", pa.float64()), ("u", pa.float64()), ("red", pa.int32()), ("green", pa.int32()), ("blue", pa.int32())])


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Header:
    fields: list[tuple[str, str]]
    points: int
    order: str  # "<", ">" or "" for text
    size: int  # bytes up to the first point


def read_header(data: bytes) -> Header:
    """The vertex part of a PLY header; other elements may follow the vertices."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    order, points, fields, element = "", 0, [], ""
    for words in (line.split() for line in data[:end].decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            order = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}[words[1]]
        elif words[:1] == ["element"]:
            element = words[1]
            if element == "vertex":
                points = int(words[2])
            elif not fields:
                raise ValueError("vertices must come first")
        elif words[:1] == ["property"] and element == "vertex":
            if words[1] == "list":
                raise ValueError("vertices with lists can't be read")
            fields.append((words[2], order + _TYPES[words[1]]))
    return Header(fields, points, order, data.index(b"\n", end) + 1)


@dataclass
class _Points(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class _Written(WriterCommitMessage):
    path: str


class PlyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("pointspertask", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        files, root = _open_fs(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else [x for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".ply")]
        out: list[InputPartition] = []
        for x in sorted(found, key=lambda x: x.path):
            with files.open_input_file(x.path) as f:
                h = read_header(f.read(1 << 16))
            step = self.each if h.order else max(1, h.points)
            out += [_Points(x.path, a, min(a + step, h.points)) for a in range(0, h.points, step)]
        return out or [_Points("", 0, 0)]

    def read(self, partition: _Points) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _open_fs(self.path)
        with files.open_input_file(partition.path) as f:
            h = read_header(f.read(1 << 16))
            kind = np.dtype(h.fields)
            f.seek(h.size + (partition.first * kind.itemsize if h.order else 0))
            left = partition.last - partition.first
            lines = iter(f.read().decode("ascii").splitlines()) if not h.order else None
            while left:
                n = min(left, 65_536)
                if h.order:
                    rows = np.frombuffer(f.read(n * kind.itemsize), kind, n)
                else:
                    rows = np.array([tuple(next(lines).split()[: len(kind)]) for _ in range(n)], dtype=kind)
                left -= n
                columns = [pa.array(rows[c].astype(np.float64)) for c in "xyz"]
                columns += [pa.array(rows[c].astype(np.int32)) if c in kind.names else pa.nulls(n, pa.int32()) for c in ("red", "green", "blue")]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _open_fs(self.path)
        files.create_dir(root, recursive=True)
        xyz = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1) for b in iterator if b.num_rows]
        points = np.concatenate(xyz) if xyz else np.zeros((0, 3))
        path = f"{root}/{uuid.uuid4().hex}.ply"
        with files.open_output_stream(path) as out:
            out.write(f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\nproperty double x\nproperty double y\nproperty double z\nend_header\n".encode())
            out.write(points.astype("<f8").tobytes())
        return _Written(path)

    def abort(self, messages: list[_Written | None]) -> None:
        files, _ = _open_fs(self.path)
        for m in messages:
            if m:
                files.delete_file(m.path)


class PlySource(DataSource):
    """Columns e, n, u (from x, y, z) and red, green, blue (null without colours). Option pointsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "e double, n double, u double, red int, green int, blue int"

    def reader(self, schema) -> PlyReader:  # noqa: ANN001
        return PlyReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> PlyWriter:  # noqa: ANN001
        return PlyWriter({k.lower(): v for k, v in self.options.items()})
