"""Language of a text by averaged embeddings of hashed subwords and a linear softmax, trained by gradient descent in numpy.

A word is its letters in lower case; its features are the hashes of its pieces of one to five letters, ends counted as letters. A
text's embedding is the average over the features of all its words. Predictions have a probability, calibrated by a temperature on a
fold of their own, and one below the threshold found there is marked as rejected.

The rows it learns from are a bounded sample of those with a language; every text is read whole.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.llm.common import stored, text_or_empty

HASH_BITS = 15
SIZE = 16
#: Lengths of pieces; ends of words count as letters.
LENGTHS = (1, 2, 3, 4, 5)
#: Rows of this fold are never learnt from; those of CHECKED calibrate.
HELD_OUT, CHECKED = 2, 3
UNKNOWN = "und"
#: About so many characters of a text are looked at together.
CHUNK = 1 << 15
_SPACE = re.compile(r"\s")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; a null id is in fold 0."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(4))


@cache
def _kinds() -> np.ndarray:
    """1 for each code point that is a letter or a mark, else 0."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), np.uint8, 0x110000)


def chunks_of(text: str) -> Iterator[str]:
    """A text in pieces of about CHUNK characters that end at blanks."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def subwords(text: str) -> np.ndarray:
    """The features of a piece of text: hashes of the pieces of its words, which are runs of letters and marks in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.zeros(len(points) + 2, np.uint32)
    letters[1:-1] = points * _kinds()[points]
    # One zero between words.
    some = letters != 0
    letters = letters[some | np.concatenate([[True], some[:-1]])]
    some = letters != 0
    found, inside = [], np.ones(len(letters), bool)
    mixed = np.zeros(len(letters), np.uint32)
    for k in LENGTHS:
        n = len(letters) - k + 1
        if n <= 0:
            break
        mixed = mixed[:n] * np.uint32(0x01000193) + letters[k - 1 :] + np.uint32(1)
        if k > 2:
            inside = inside[:n] & some[k - 2 : k - 2 + n]
        good = mixed[some] if k == 1 else mixed[inside[:n]]
        good = (good ^ (good >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
        found.append((good ^ (good >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - HASH_BITS))
    return np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)


def counts_of(text: str) -> np.ndarray:
    """How often a text has each feature."""
    times = np.zeros(1 << HASH_BITS, np.int64)
    for chunk in chunks_of(text):
        times += np.bincount(subwords(chunk), minlength=1 << HASH_BITS)
    return times


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    #: What calibration saw: rows, right ones, right ones among those not rejected, rejected ones.
    checked: dict[str, float] = field(default_factory=dict)

    def probabilities(self, text: str) -> np.ndarray | None:
        """Of each language; None if the text has no word."""
        times = counts_of(text)
        n = times.sum()
        if not n:
            return None
        total = times.astype(np.float32) @ self.embeddings
        z = (total / n @ self.out + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_softmax(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], *, epochs: int, rate: float, seed: int = 17) -> LanguageModel:
    """From rows (features, how often each occurs, number of the language), by steps on single rows in a seeded order, rate falling to 0."""
    rng = np.random.default_rng(seed)
    model = LanguageModel(languages, rng.normal(0, 0.05, (1 << HASH_BITS, SIZE)).astype(np.float32), rng.normal(0, 0.3, (SIZE, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return model
    seen = np.bincount([y for *_, y in rows], minlength=len(languages))
    weigh = len(rows) / len(languages) / np.maximum(seen, 1)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, times, y = rows[i]
            share = (times / times.sum())[:, None]
            x = (share * model.embeddings[at]).sum(axis=0)
            z = x @ model.out + model.bias
            p = np.exp(z - z.max())
            off = p / p.sum()
            off[y] -= 1
            off *= rate * (1 - done / steps) * weigh[y]
            back = model.out @ off
            model.out -= np.outer(x, off)
            model.bias -= 0.1 * off
            # A feature's share in a text is small; steps on it are as if it were the share's root.
            model.embeddings[at] -= np.sqrt(share) * back
            done += 1
    return model


def calibrate(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]], accuracy: float) -> None:
    """Set the temperature of the least loss on these rows, and the least threshold from which on predictions reach `accuracy`."""
    if not rows or len(model.languages) < 2:
        return
    z = np.array([(t / t.sum()) @ model.embeddings[a] @ model.out + model.bias for a, t, _ in rows], np.float64)
    y = np.array([y for *_, y in rows])

    def logs(temperature: float) -> np.ndarray:
        x = z / temperature
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    model.temperature = float(min(np.geomspace(0.1, 10, 61), key=lambda t: -logs(t)[np.arange(len(y)), y].mean()))
    p = np.exp(logs(model.temperature))
    sure, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-sure, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= accuracy * np.arange(1, len(y) + 1))
    model.threshold = float(sure[order[good[-1]]]) if len(good) else 1.0
    taken = sure >= model.threshold
    model.checked = {"rows": len(y), "right": float(right.mean()), "right_of_taken": float(right[taken].mean()) if taken.any() else 0.0, "rejected": float(1 - taken.mean())}


#: Learning rates and epochs among which the fold that calibrates chooses.
SETTINGS = ((2, 0.5), (2, 1.5))


def fit_and_calibrate(rows: list[dict], accuracy: float) -> LanguageModel:
    """Folds 0 and 1 train, fold 3 chooses the settings by its loss and calibrates."""
    rows = sorted(rows, key=lambda r: (r["rank"], r["part"]))
    languages = sorted({r["lang"] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    made = lambda part: [(np.frombuffer(r["features"], np.int32), np.frombuffer(r["times"], np.float32), number[r["lang"]]) for r in part]
    train, check = made(r for r in rows if r["fold"] != CHECKED), made(r for r in rows if r["fold"] == CHECKED)
    best = None
    for epochs, rate in SETTINGS:
        model = fit_softmax(train, languages, epochs=epochs, rate=rate)
        calibrate(model, check, accuracy)
        if best is None or model.checked.get("right", 0) > best.checked.get("right", 0):
            best = model
    return best


def _counted(text: str) -> tuple[bytes, bytes] | None:
    """A text's features and how often it has each."""
    times = counts_of(text)
    at = np.flatnonzero(times).astype(np.int32)
    return (at.tobytes(), times[at].astype(np.float32).tobytes()) if len(at) else None


def training_rows(docs: DataFrame, most: int, parts: int) -> DataFrame:
    """Rows rank, part, fold, lang, features, times of about `most` documents with a language outside the held-out fold, as many of each
    language as there are, up to equal shares. Part 0 is the whole text; `parts` others are a few words from anywhere in it.
    Chosen by hashes of ids, so larger corpora change which, not how many; repeated rows count once."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != HELD_OUT)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    spread = 1 << 24
    cut = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, most / len(counts) / n) * spread))]) if counts else F.create_map(F.lit(""), F.lit(0))
    picked = known.where(F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(spread)) <= cut[F.col("lang")])
    picked = picked.select(F.xxhash64(F.lit(37), "doc_id", "lang", "text").alias("rank"), fold("doc_id").cast("int").alias("fold"), "lang", text_or_empty().alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rank, of, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                rng, whole = np.random.default_rng(rank & 0xFFFFFFFF), text.as_py()
                pieces = [whole]
                for _ in range(parts if len(whole) > 100 else 0):
                    at, n = int(rng.integers(0, len(whole) - 60)), int(rng.integers(8, 60))
                    pieces.append(whole[at : at + n].partition(" ")[2].rpartition(" ")[0])
                out += [(rank, i, of, lang, *got) for i, piece in enumerate(pieces) if (got := _counted(piece))]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["rank", "part", "fold", "lang", "features", "times"])

    return stored(picked.mapInArrow(read, "rank long, part int, fold int, lang string, features binary, times binary"), "sample").dropDuplicates(["rank", "part"])


def train_language(docs: DataFrame, *, sample: int = 6_000, parts: int = 2, sample_bytes: int = 48 << 20, accuracy: float = 0.99) -> LanguageModel:
    """A model from about `sample` documents with a language, fitted in one task; the held-out fold is never read.

    docs: doc_id, text, lang. Rows whose language or id is null are left out, texts without letters too; repeated rows count once.
    Long texts are read whole; a row has a feature for each of 2 ** HASH_BITS hashes at most. The task holds `sample_bytes` of rows: one
    that doesn't fit any more is skipped, and the next is tried. With no rows there are no languages, with one there is nothing to tell apart.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], sample_bytes
        for batch in batches:
            for r in batch.to_pylist():
                if (size := len(r["features"]) + len(r["times"]) + 200) <= left:
                    left -= size
                    rows.append(r)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_and_calibrate(rows, accuracy))], pa.binary())], names=["model"])

    rows = training_rows(docs, sample, parts).repartition(1).sortWithinPartitions("rank", "part")
    made = rows.mapInArrow(fit, "model binary").first()
    return pickle.loads(made["model"]) if made else fit_and_calibrate([], accuracy)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows doc_id, lang_pred, score, rejected.

    docs: doc_id, text; no other column is read. lang_pred is a language of the model; UNKNOWN with score 0, rejected, where the text is null or has
    no letter, or the model has no language. Equal texts are told alike, repeated rows give repeated rows and no documents none. Very long
    texts are read whole, piece by piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        for batch in batches:
            told = []
            for scalar in batch.column(1):
                text = scalar.as_py()
                p = model.probabilities(text) if model.languages and has_letter(text) else None
                best = None if p is None else int(p.argmax())
                told.append((UNKNOWN, 0.0, True) if p is None else (model.languages[best], float(p[best]), bool(p[best] < model.threshold)))
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([t[i] for t in told], k) for i, k in enumerate(kinds)]], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
