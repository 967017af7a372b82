"""One nested JSON document written and read by many tasks.

A row is a leaf: a path from the document's root and the JSON text of what stands there. Steps of a path are names of members; a step that
begins with `[` is an element of an array, told from its neighbours by the rest of the step. A last step `*` puts all members of an
object there instead of one. Between two leaves that follow each other, the text that closes and opens what their paths do not share
is told from the two paths alone, so a task writes the leaves of its range without knowing of others, and the commit, which
knows the first and the last path of each part, joins the parts.

No row holds more than a leaf, no task more than a batch and a block, and the commit copies the parts in blocks, each part deleted when it has been copied.

A task cuts its text into blocks of some MB that hold whole elements of one list (or one other member of the document). Where each block lies, and what opens and closes the
containers around it, goes into a small index beside the document, so `read_document` reads the members asked for by blocks, in many tasks. At a
path that ends in .gz each block is a gzip member of its own, and the document is a gzip file like any other.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BLOCK = 1 << 20
#: Characters of a block at least, if its member has so many; an element more at most.
TEXT_BLOCK = 4 << 20
#: Blocks that a task reads.
TASK_BLOCKS = 8
ALL = "*"
#: What a list without elements is written as, at a path that ends in the list's name.
EMPTY = "[]"


def _is_element(step: str) -> bool:
    return step.startswith("[")


def closing(path: Sequence[str], depth: int = 0) -> str:
    """What closes the containers that a leaf's path opened below its first `depth` steps."""
    return "".join("]" if _is_element(path[i + 1]) else "}" for i in range(len(path) - 2, depth - 1, -1))


def opening(path: Sequence[str], depth: int = 0) -> str:
    """What leads from the container at `depth` to a leaf's value."""
    out = []
    for i in range(depth, len(path)):
        if path[i] != ALL and not _is_element(path[i]):
            out.append(json.dumps(path[i]) + ":")
        if i + 1 < len(path):
            out.append("[" if _is_element(path[i + 1]) else "{")
    return "".join(out)


def between(before: Sequence[str], after: Sequence[str]) -> str:
    """The text between the values of two leaves that follow each other."""
    depth = 0
    while depth < min(len(before), len(after)) - 1 and before[depth] == after[depth]:
        depth += 1
    return closing(before, depth) + "," + opening(after, depth)


def list_name(path: Sequence[str]) -> str:
    """The names on a leaf's path, with dots."""
    return ".".join(s for s in path if s != ALL and not _is_element(s))


def packed(text: str, path: str) -> bytes:
    """The bytes of a piece of a document at this path."""
    if not path.endswith(".gz") or not text:
        return text.encode()
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress(text.encode()) + out.flush()


def unpacked(data: bytes, path: str) -> str:
    return (zlib.decompress(data, 31) if path.endswith(".gz") else data).decode()


def index_path(path: str) -> str:
    """The folder of a document's index; its name is hidden from listings."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.index"


def _same_element(before: Sequence[str], after: Sequence[str]) -> bool:
    return len(before) > 1 and _is_element(before[1]) and before[:2] == after[:2]


@dataclass
class _Block:
    first: tuple[str, ...]
    last: tuple[str, ...] = ()
    offset: int = 0  #: in its part
    length: int = 0


@dataclass
class _Part(WriterCommitMessage):
    task: int = 0
    path: str = ""
    first: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    leaves: dict[str, int] = field(default_factory=dict)
    blocks: list[_Block] = field(default_factory=list)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema) -> None:  # noqa: ANN001
        self.path, self.totals, self.block = options["path"], options.get("totals", ""), int(options.get("block", TEXT_BLOCK))
        self.columns = [schema.fieldNames().index(c) for c in ("path", "value")]

    def _parts(self) -> tuple[fs.FileSystem, str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root, f"{root}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        files, _, folder = self._parts()
        part, last, leaves = _Part(TaskContext.get().partitionId()), None, Counter()
        out, at, text, size = None, 0, [], 0

        def flush(between_blocks: str = "") -> None:
            nonlocal out, at, text, size
            if out is None:
                files.create_dir(folder, recursive=True)
                part.path = f"{folder}/{uuid.uuid4().hex}"
                out = files.open_output_stream(part.path, compression=None)
            data, rest = packed("".join(text), self.path), packed(between_blocks, self.path)
            block = part.blocks[-1]
            block.last, block.offset, block.length = tuple(last), at, len(data)
            out.write(data + rest)
            at, text, size = at + len(data) + len(rest), [], 0

        for batch in iterator:
            for path, value in zip(batch.column(self.columns[0]).to_pylist(), batch.column(self.columns[1]).to_pylist(), strict=True):
                if path[-1] == ALL and not (value := value.strip()[1:-1].strip()):
                    continue
                if last is None:
                    part.first = tuple(path)
                    part.blocks.append(_Block(tuple(path)))
                elif path[0] != last[0] or (size >= self.block and not _same_element(last, path)):
                    flush(between(last, path))
                    part.blocks.append(_Block(tuple(path)))
                else:
                    text.append(between(last, path))
                    size += len(text[-1])
                text.append(value)
                size += len(value)
                last = path
                leaves[list_name(path)] += value != EMPTY or _is_element(path[-1])
        if last is not None:
            flush()
            out.close()
        part.last, part.leaves = tuple(last or ()), dict(leaves)
        return part

    def commit(self, messages: list[_Part | None]) -> None:
        files, root, folder = self._parts()
        parts = sorted((m for m in messages if m and m.path), key=lambda m: m.task)
        total = sum((Counter(m.leaves) for m in parts), Counter())
        files.create_dir(root.rpartition("/")[0], recursive=True)
        joined, index = f"{root}.{uuid.uuid4().hex}", index_path(root)
        self._clean(files, index)
        whole = not any(_same_element(a.last, b.first) for a, b in zip(parts, parts[1:], strict=False))
        lines, at = f"{folder}/index/blocks.json", 0
        files.create_dir(f"{folder}/index", recursive=True)
        with files.open_output_stream(joined, compression=None) as out, files.open_output_stream(lines) as blocks:

            def put(text: str) -> None:
                nonlocal at
                data = packed(text, self.path)
                at += len(data)
                out.write(data)

            before: tuple[str, ...] = ()
            for m in parts:
                put(between(before, m.first) if before else "{" + opening(m.first))
                for b in m.blocks:
                    line = {"member": b.first[0], "at": at + b.offset, "length": b.length, "opening": "{" + opening(b.first), "closing": closing(b.last) + "}"}
                    blocks.write((json.dumps(line) + "\n").encode())
                with files.open_input_stream(m.path, compression=None) as read:
                    while block := read.read(BLOCK):
                        at += len(block)
                        out.write(block)
                files.delete_file(m.path)
                before = m.last
            put(closing(before) if before else "{")
            if self.totals:
                put(("," if before else "") + f"{json.dumps(self.totals)}:{json.dumps(dict(sorted(total.items())))}")
            put("}\n")
            # The reader takes the index for this document alone.
            blocks.write((json.dumps({"member": None, "length": at}) + "\n").encode())
        files.move(joined, root)
        if whole:
            files.move(f"{folder}/index", index)
        self._clean(files, folder)

    def abort(self, messages: list[_Part | None]) -> None:
        files, _, folder = self._parts()
        self._clean(files, folder)

    @staticmethod
    def _clean(files: fs.FileSystem, folder: str) -> None:
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class DocumentSource(DataSource):
    """Rows path, value to one JSON document. Options: path; totals, a member of the document that gets the number of leaves by list; block, the characters of a block."""

    @classmethod
    def name(cls) -> str:
        return "nested_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:  # noqa: ANN001
        return DocumentWriter({k.lower(): v for k, v in self.options.items()}, schema)


def write_document(rows: DataFrame, path: str, order: Sequence[str], *, totals: str = "", ranges: Sequence[str | Column] = (), leaves: Callable[[DataFrame], DataFrame] | None = None, tasks: int = 0, block: int = TEXT_BLOCK) -> None:
    """Leaves (path array<string>, value string, and the columns to order them by) as one JSON document at `path`.

    Leaves that share the beginning of their paths must follow each other in this order, and two leaves may not have the same place. Nulls in path or value fail.
    No leaves give an empty object, with `totals` if asked for. What stood at `path` is replaced when all is written. `ranges` are what leaves are dealt to tasks by
    instead of `order`, ascending with it: where they are the same for all leaves of an element of each list at the root, the document is read by blocks, of `block` characters at least, else as a whole.
    With `leaves`, rows become leaves by it after they have been dealt out and sorted. `tasks`: at least so many tasks.
    """
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(tasks, *(ranges or order)).sortWithinPartitions(*order)
    ranged = (leaves(ranged) if leaves else ranged).select("path", "value")
    writer = ranged.write.format(DocumentSource.name()).mode("append").option("block", block)
    (writer.option("totals", totals) if totals else writer).save(path)


def _indexed(path: str) -> bool:
    """Whether an index stands beside the document that was written with it."""
    files, root = fs.FileSystem.from_uri(path)
    index = f"{index_path(root)}/blocks.json"
    if files.get_file_info(index).type != fs.FileType.File:
        return False
    with files.open_input_file(index) as read:
        read.seek(max(0, read.size() - 200))
        length = json.loads(read.read().splitlines()[-1])["length"]
    return files.get_file_info(root).size == length


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The members of a document's root that schema names, as columns.

    A document with an index gives a row for each block of these members, with a part of one member's elements and null for the others; tasks read
    nothing else of it. Any other document is one row.
    """
    if not _indexed(path):
        return spark.read.schema(schema).json(path, multiLine=True)
    members = spark.createDataFrame([], schema).columns
    blocks = spark.read.schema("member string, at long, length long, opening string, closing string").json(index_path(path)).where(F.col("member").isin(members))
    blocks = blocks.repartition(max(1, math.ceil(blocks.count() / TASK_BLOCKS)))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        with files.open_input_file(root) as read:
            for batch in batches:
                for b in batch.to_pylist():
                    read.seek(b["at"])
                    text = b["opening"] + unpacked(read.read(b["length"]), path) + b["closing"]
                    yield pa.RecordBatch.from_pydict({"text": [text]})

    return blocks.mapInArrow(texts, "text string").select(F.from_json("text", schema).alias("d")).select("d.*")
