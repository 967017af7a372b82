"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised where they lie, cut into pieces no longer than a sequence, and
only (id, piece, start, length, checksum) rows move. Which lengths share a sequence is
decided on the histogram of piece lengths. It has at most `capacity` rows whatever the
corpus, and so may go to the driver; the plan that comes back is a list of runs ("the next n pieces of
length l take offset o in sequences s, s + 1, ...") of the same order of size, which is
why it may be broadcast. Each piece finds its run by its rank among pieces of its length: tasks number the pieces of each
length as they make them, and the counts of the tasks before are added. So nothing is sorted, no length meets in one task, and
token ids don't cross the network.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.llm.common import stored, text_or_empty
from tesseral.llm.words import kept


#: Words, and parts of words, that a Python worker remembers, and as many older ones: in tasks that do nothing else, and where they send ids on too.
WORDS, WORDS_WITH_IDS = 150_000, 20_000
#: Up to so many bytes of counts by length and task, at 40 a row, are broadcast; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 20 << 20


class Run(NamedTuple):
    """The pieces of one length with ranks first_rank to first_rank + n - 1 take one place in n sequences."""

    length: int
    first_rank: int
    n: int
    first_sequence: int
    offset: int


class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of length {length} does not fit {capacity}")
            self.left[length] = n
        self.rank = [0] * (capacity + 1)
        self.sequences = 0
        self.runs: list[Run] = []
        #: Bit i: pieces of length i are left; and the same mirrored, bit capacity - i.
        self.have = sum(1 << i for i, n in enumerate(self.left) if n)
        self.mirror = sum(1 << (capacity - i) for i, n in enumerate(self.left) if n)

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, self.rank[length], n, sequence, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.have &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))

    def times(self, lengths: list[int]) -> int:
        """How many sequences can hold just these lengths."""
        return min(self.left[x] // lengths.count(x) for x in lengths)

    def open(self, lengths: list[int], n: int) -> None:
        """n new sequences that hold these lengths."""
        offset = 0
        for x in lengths:
            self.place(x, n, self.sequences, offset)
            offset += x
        self.sequences += n

    def pair(self, total: int, others: list[int]) -> list[int] | None:
        """Two lengths that sum to total and are left beside the others, the longer as long as can be."""
        found = self.have & (self.mirror >> (self.capacity - total)) & ((1 << total) - 1) & ~1
        while found:
            a = found.bit_length() - 1
            if 2 * a < total:
                return None
            if self.times([*others, a, total - a]):
                return [a, total - a]
            found &= ~(1 << a)
        return None

    def complement(self, length: int) -> list[int] | None:
        """One, two or three lengths that fill up a sequence that begins with this one."""
        gap = self.capacity - length
        if not gap:
            return []
        if self.left[gap] and self.times([length, gap]):
            return [gap]
        if two := self.pair(gap, [length]):
            return two
        rest = self.have & ((1 << gap) - 1)
        while rest:
            a = rest.bit_length() - 1
            if a and self.times([length, a]) and (two := self.pair(gap - a, [length, a])):
                return [a, *two]
            rest &= ~(1 << a)
        return None

    def exact(self, least: int) -> None:
        """Fill sequences exactly that begin with a length of `least` or more."""
        for length in range(self.capacity, least - 1, -1):
            while self.left[length] and (rest := self.complement(length)) is not None:
                self.open([length, *rest], self.times([length, *rest]))

    def best_fit(self) -> None:
        """What no exact combination takes: longest first, each into the tightest gap."""
        gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
        there = 0
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                if fits := there >> length:
                    gap = length + (fits & -fits).bit_length() - 1
                    first, n = gaps[gap].pop()
                    k = min(n, self.left[length])
                    self.place(length, k, first, self.capacity - gap)
                    if k < n:
                        gaps[gap].append((first + k, n - k))
                else:
                    each = min(self.capacity // length, self.left[length])
                    k, first, gap = self.left[length] // each, self.sequences, self.capacity - (each - 1) * length
                    self.open([length] * each, k)
                if gap - length:
                    gaps[gap - length].append((first, k))
                    there |= 1 << (gap - length)
                if not gaps[gap]:
                    there &= ~(1 << gap)


def plan_packing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Pack counts[length] pieces of each length into as few sequences as the method finds.

    From the longest length down, gaps are filled exactly by one length, by two or by
    three, as often as all of them are left; bit sets of the lengths that are left answer
    "which pairs sum to g" at once. What remains is packed best-fit decreasing.
    With few pieces an exact filling can spend what longer pieces will need, so plans that
    only fill up long pieces exactly, or none, are made as well and the one with the fewest sequences is taken.
    Each step uses up a length or a run of gaps, so the runs are a small multiple of
    `capacity`, however many pieces there are.
    """
    plans = []
    for least in (1, capacity // 2 + 1, capacity + 1):
        plan = _Plan(counts, capacity)
        plan.exact(least)
        plan.best_fit()
        plans.append(plan)
    return min(plans, key=lambda p: p.sequences).runs


#: The normaliser and pre-tokeniser of tokenizers whose tokens never reach across white space (fixed values).
_WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_WORD_PRETOKENIZER = ["Split", "ByteLevel"]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """What encode(word) gave for the words met lately. Once `most` are held they become the older ones, which are looked up
    before a word is encoded again, and go when the next lot is full."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__({"": b""})
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        self[word] = got = self.encode(word) if got is None else got
        return got

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
            self[""] = b""


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, without special tokens added.

    If the tokenizer lower-cases, drops white space and splits words by a pattern, the ids of a text are
    those of its words in turn. Words repeat, so each is encoded once and remembered, and so are the
    parts into which the pattern splits words; a memory holds up to `most` words, or parts, met of late and as many older ones.
    Words of Latin letters go straight to the model; any others, and
    whole texts under any other tokenizer, go through all of the tokenizer.
    """

    def __init__(self, path: str, most: int = 20_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        normal = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        pre = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = normal == _WORD_NORMALIZER and [x["type"] for x in pre] == _WORD_PRETOKENIZER and pre[0]["invert"] and pre[0]["behavior"] == "Removed"
        if self.by_word:
            self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
            self.special = [x["content"] for x in form["added_tokens"]]
            byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            #: What the byte-level step makes of Latin letters beyond ASCII.
            self.latin = {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in range(0xA1, 0x250)}
            self.model = self.tokenizer.model
        self.words, self.parts = _Words(self.word, most), _Words(self.part, most)

    def part(self, part: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.latin))])

    def word(self, word: str) -> bytes:
        low = word.lower()  # most words are Latin letters and perhaps a mark
        core = low[:-1] if low[-1] in ".," else low
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
            return self.parts[core] + self.parts[low[-1]] if core is not low else self.parts[core]
        if word.isprintable() and max(low) < "\u0250" and not any(x in word for x in self.special):
            return b"".join(map(self.parts.__getitem__, self.pattern.findall(low)))
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.words.turn()
        self.parts.turn()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))


def word_encoder(path: str, most: int) -> WordEncoder:
    """The encoder of a Python worker."""
    return kept(f"packing-{most}-{path}", lambda: WordEncoder(path, most))


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int, *, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, part, place (and ids as bytes) of every document's pieces: place counts
    the pieces of one length that the task `part` made, from 0.

    A document is its token ids and then id 0; pieces end at multiples of `capacity`.
    A null text is an empty one: one piece, of id 0 alone. Null ids stay null; other
    columns are not read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())]
    out = pa.schema([*fields, ("ids", pa.binary())] if with_ids else fields)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer, WORDS_WITH_IDS if with_ids else WORDS)
        task, made = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), task, made[n], part)[: len(out)])
                    made[n] += 1
                    held += len(part) * with_ids
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(pieces, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, *, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there, and its ids if asked for.

    docs: doc_id, text and any other columns, which are left out. Null texts are empty
    texts; an empty text is one piece of length 1. Repeated rows are packed each on its own.
    No documents give no rows. Each sequence is filled without holes from offset 0.
    """
    spark = docs.sparkSession
    pieces = stored(tokenize_pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces")
    # One row for each length and task, numbered through the tasks.
    before = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = stored(before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")), "before")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    side = before.select("length", "part", "before")
    if 40 * before.count() <= BROADCAST_BYTES:
        side = F.broadcast(side)
    ranked = pieces.join(side, ["length", "part"]).withColumn("rank", F.col("place") + F.col("before"))
    runs = spark.createDataFrame(
        [(r.length, r.first_rank, r.first_rank + r.n, r.first_sequence, r.offset) for r in plan_packing(counts, capacity)],
        "length long, from_rank long, to_rank long, first_sequence long, offset long",
    )
    # A bounded plan: see plan_packing.
    placed = ranked.alias("p").join(
        F.broadcast(runs).alias("r"),
        (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")),
    )
    return placed.select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset",
        *(["ids"] if with_ids else []),
    )
