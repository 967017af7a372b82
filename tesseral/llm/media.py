"""Media columns: payloads kept as images in archives, read by a custom Spark data source.

An archive directory holds zip files of PNG images (one member a row, stored as they are) of
bounded size, and a manifest that names the committed ones. The source `png_archive`
plans partitions as byte ranges of the archives. A task opens its archive, takes from its
directory the members whose offset lies in its range, and streams them out in Arrow batches
of bounded size. Each member is fetched by its own offset and retried by itself, on a
newly opened file, so one bad read costs one member and not the partition.
"""

from __future__ import annotations

import contextlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tesseral.llm.common import fresh_path

#: Samples in a row of an image; payloads are padded to whole rows.
WIDTH = 576
_PNG = b"\x89PNG\r\n\x1a\n"
_MANIFEST = "_manifest"


def padded_payload(text: Column | str, unit: int = WIDTH) -> Column:
    """UTF-8 bytes of the text (null: none), then bytes 255 up to a positive multiple of `unit`."""
    data = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    n = F.length(data)
    short = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    return F.concat(data, F.unhex(F.repeat(F.lit("FF"), short)))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, WIDTH wide, whose samples are the payload."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"a payload of {len(payload)} bytes is no positive multiple of {WIDTH}")
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that to_png made, by row."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, width, height, packed = 8, 0, 0, []
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"a damaged {kind.decode('latin-1')} chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit grey images without interlacing are kept here")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are kept here")
    return rows[:, 1:]


def image_feature(samples: np.ndarray) -> str:
    """A 64-bit average hash and the mean and deviation of the samples, as text.

    The image is cut into 8 by 8 blocks of nearly equal size (rows repeat where there are fewer than 8).
    """
    height = samples.shape[0]
    edges = np.arange(8) * height // 8
    rows = np.add.reduceat(samples.astype(np.int64), edges, axis=0) if height >= 8 else samples.astype(np.int64)[np.arange(8) * height // 8]
    counts = np.diff(np.append(edges, height))[:, None] if height >= 8 else np.ones((8, 1), np.int64)
    blocks = rows.reshape(8, 8, -1).sum(axis=2) / (counts * (samples.shape[1] // 8))
    bits = int("".join("01"[int(x)] for x in (blocks > blocks.mean()).ravel()), 2)
    return f"{bits:016x}:{samples.mean():.4f}:{samples.std():.4f}"


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path there. Stores that only Hadoop's clients reach are refused with the reason."""
    scheme = uri.split(":", 1)[0] if ":" in uri else "file"
    if scheme not in ("file", "hdfs", "viewfs", "s3", "gs", "gcs"):
        raise ValueError(f"archives can't be kept at {uri}: tasks open them with pyarrow, which has file, hdfs, viewfs, s3 and gs but not {scheme}; name such a folder in spark.checkpoint.dir or as `path`")
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class _Written(WriterCommitMessage):
    archives: list[tuple[str, int, int]]  # name, bytes, members


@dataclass
class _Range(InputPartition):
    archive: str
    start: int
    end: int


class PngArchiveWriter(DataSourceArrowWriter):
    """Each task writes zip files of its own; the driver's commit names them in a manifest."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.archive_bytes = int(options.get("archivebytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _open_fs(self.path)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out = archive = None
        name, members = "", 0

        def close() -> None:
            archive.close()
            out.close()
            done.append((name, files.get_file_info(f"{root}/{name}").size, members))

        try:
            for batch in iterator:
                for key, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if archive is None:
                        name, members = f"{uuid.uuid4().hex}.zip", 0
                        out = files.open_output_stream(f"{root}/{name}")
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    archive.writestr(zipfile.ZipInfo(f"{members}/{'' if key is None else key}.png"), to_png(payload.as_py()))
                    members += 1
                    if out.tell() >= self.archive_bytes:
                        close()
                        out = archive = None
            if archive is not None:
                close()
        except BaseException:
            # The attempt's archives are in no manifest; only those of a lost executor stay behind.
            for left in {x[0] for x in done} | ({name} if name else set()):
                with contextlib.suppress(OSError):
                    files.delete_file(f"{root}/{left}")
            raise
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _open_fs(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{_MANIFEST}-{uuid.uuid4().hex}") as out:
            for message in messages:
                for archive in message.archives if message else []:
                    out.write(json.dumps(archive).encode() + b"\n")

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = _open_fs(self.path)
        for message in messages:
            for name, _, _ in message.archives if message else []:
                files.delete_file(f"{root}/{name}")


class PngArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.tries = int(options.get("tries", 4))
        self.wait_s = float(options.get("waits", 0.2))

    def partitions(self) -> list[_Range]:
        """One range for each `rangeBytes` of each archive that the manifests name; members are not listed here."""
        files, root = _open_fs(self.path)
        found = []
        for info in files.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith(_MANIFEST):
                with files.open_input_stream(info.path) as lines:
                    for name, size, _ in map(json.loads, lines.read().splitlines()):
                        found += [_Range(name, at, min(at + self.range_bytes, size)) for at in range(0, size, self.range_bytes)]
        return found or [_Range("", 0, 0)]

    def tried(self, read: Callable[[], object], held: list[zipfile.ZipFile], what: str):  # noqa: ANN201
        """read(), again after a failure, with the archive opened anew."""
        for k in range(self.tries):
            try:
                return read()
            except (OSError, zipfile.BadZipFile, zlib.error) as e:
                held.clear()
                if k + 1 == self.tries:
                    raise OSError(f"{what}: {e}") from e
                time.sleep(self.wait_s * 2**k)
        raise AssertionError

    def opened(self, files: fs.FileSystem, path: str, held: list[zipfile.ZipFile]) -> zipfile.ZipFile:
        if not held:
            held.append(zipfile.ZipFile(files.open_input_file(path)))
        return held[0]

    def fetch(self, files: fs.FileSystem, path: str, held: list[zipfile.ZipFile], member: zipfile.ZipInfo) -> bytes:
        """One member, checked against its checksum."""
        return self.tried(lambda: self.opened(files, path, held).read(member), held, f"{path}, member {member.filename} at offset {member.header_offset}")

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, root = _open_fs(self.path)
        path = f"{root}/{partition.archive}"
        held: list[zipfile.ZipFile] = []
        listed = self.tried(lambda: self.opened(files, path, held).infolist(), held, f"{path}, its directory")
        members = [x for x in listed if partition.start <= x.header_offset < partition.end]
        keys: list[int | None] = []
        media: list[bytes] = []
        size = 0
        for member in members:
            key = member.filename.split("/", 1)[1].removesuffix(".png")
            keys.append(int(key) if key else None)
            media.append(self.fetch(files, path, held, member))
            size += len(media[-1])
            if size >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])
                keys, media, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])


class PngArchive(DataSource):
    """Options: path; for writing archiveBytes; for reading rangeBytes, batchBytes, tries and waitS."""

    @classmethod
    def name(cls) -> str:
        return "png_archive"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> PngArchiveReader:  # noqa: ANN001
        return PngArchiveReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> PngArchiveWriter:  # noqa: ANN001
        return PngArchiveWriter({k.lower(): v for k, v in self.options.items()})


def store_payloads(docs: DataFrame, path: str, **options: str) -> None:
    """Write each document's padded payload as an image into the archive directory `path`.

    docs: doc_id, text; other columns are not read. Null and empty texts become one row of
    255s; null ids come back as null; repeated rows are members of their own; very long texts are one member each. No documents leave an empty directory.
    """
    docs.sparkSession.dataSource.register(PngArchive)
    rows = docs.select("doc_id", padded_payload("text").alias("payload"))
    rows.write.format("png_archive").mode("append").options(**options).save(path)


def read_media(spark, path: str, **options: str) -> DataFrame:  # noqa: ANN001
    """Rows doc_id, media (the stored image), payload (its samples), n_bytes (of the payload before its
    padding: UTF-8 holds no byte 255) and feature of every stored member."""
    spark.dataSource.register(PngArchive)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = media.as_py()
                samples = from_png(image)
                payload = samples.tobytes()
                rows.append((key, image, payload, len(payload.rstrip(b"\xff")), image_feature(samples)))
                size += samples.size
                if size >= 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return spark.read.format("png_archive").options(**options).load(path).mapInArrow(decode, "doc_id long, media binary, payload binary, n_bytes long, feature string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "media", "payload", "n_bytes", "feature"])


def media_table(docs: DataFrame) -> DataFrame:
    """docs stored in a new archive directory in the shared folder and read back."""
    path = fresh_path(docs.sparkSession, "media")
    store_payloads(docs, path)
    return read_media(docs.sparkSession, path)
