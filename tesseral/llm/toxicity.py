"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed into buckets; buckets that enough training texts hold have embeddings, all
other words share one of zeros. Filters of several widths slide over the whole text, each keeps
its largest response, and a linear layer makes a logit of them. Thresholds are
calibrated by the language that the text's own function words show, and the score is the
logit's distance from the threshold, squashed to 0..1 so that 0.5 is the threshold.

It learns from every labelled row outside the held-out fold. Labels meet texts in a shuffle, and the rows of a
partition are a lot. How many texts of each label hold a bucket is counted over all lots and gives the first
embeddings. Then, round by round, each lot learns on from the same network, and the mean of what all lots changed makes the
next one: a bucket's mean is over the lots that changed it, by how often they did. Thresholds come from counts of all
calibration texts by steps of the logit. Sums are of whole numbers, so that their order does not matter.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.llm.common import pieces_of, stored, text_or_empty
from tesseral.llm.words import LANGUAGES, WordTable, kept, language_row, plain, word_hash

HASH_BITS = 24
#: About so many labelled rows are a lot, or those among eight times as many documents; there are LEAST_LOTS at least, as a mean of few follows chance.
LOT_ROWS, LEAST_LOTS = 4_096, 4
ROUNDS = 4
#: A bucket has an embedding if so many texts hold it. The network has no more than MOST_BUCKETS of them, those that tell labels apart most surely.
LEAST_TEXTS = 3
MOST_BUCKETS = 1 << 17
WIDTHS = (1, 2, 3)
FILTERS = 6
SIZE = 8
#: Words of a text that are looked up at once.
LOOKED_UP = 1 << 15
#: Changes are summed in whole numbers of 1 / UNIT, and logits counted in steps of 1 / STEPS between -FAR and FAR.
UNIT = 1 << 30
STEPS, FAR = 256, 30


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; a null id is in fold 0."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(5))


@dataclass
class TextCnn:
    buckets: np.ndarray  # sorted; bucket buckets[i] has embedding i + 1
    embeddings: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self) -> dict[int, int]:
        """The embedding of each bucket that has one; all others are row 0."""
        return {b: i + 1 for i, b in enumerate(self.buckets.tolist())}

    def index(self, words: np.ndarray) -> np.ndarray:
        """The embeddings' rows of an array of word buckets, padded."""
        if not len(self.buckets):
            return pad(np.zeros(len(words), np.int64))
        at = np.searchsorted(self.buckets, words)
        return pad(np.where(self.buckets[np.minimum(at, len(self.buckets) - 1)] == words, at + 1, 0))

    def dense(self) -> np.ndarray:
        """All parameters but the embeddings in rows of SIZE, as moved() and add() number them after those."""
        flat = np.concatenate([*[self.filters[k].ravel() for k in WIDTHS], self.bias, self.out, [self.out_bias]])
        return np.pad(flat, (0, -len(flat) % SIZE)).reshape(-1, SIZE)

    def add(self, rows: np.ndarray, change: np.ndarray) -> None:
        """Add changes to rows: embeddings first, then those of dense()."""
        own = rows < len(self.embeddings)
        self.embeddings[rows[own]] += change[own]
        flat = self.dense()
        flat[rows[~own] - len(self.embeddings)] += change[~own]
        ends = np.cumsum([*[k * SIZE * FILTERS for k in WIDTHS], len(self.bias), len(self.out), 1])
        *parts, self.bias, self.out, last, _ = np.split(flat.ravel(), ends)
        self.filters = {k: p.reshape(k, SIZE, FILTERS) for k, p in zip(WIDTHS, parts, strict=True)}
        self.out_bias = float(last[0])

    def tables(self) -> np.ndarray:
        """Each embedding's response to the filters, by width, place in it and filter."""
        return np.concatenate([self.embeddings @ self.filters[k][j] for k in WIDTHS for j in range(k)], axis=1)

    def logit(self, rows: np.ndarray, tables: np.ndarray) -> float:
        rows, pooled = pad(rows), np.full((len(WIDTHS), FILTERS), -np.inf)
        over = max(WIDTHS) - 1
        for start in range(0, len(rows) - over, LOOKED_UP):
            got = np.ascontiguousarray(tables[rows[start : start + LOOKED_UP + over]].T).reshape(-1, FILTERS, min(LOOKED_UP + over, len(rows) - start))
            at = 0
            for i, k in enumerate(WIDTHS):
                n = got.shape[2] - k + 1
                response = got[at][:, :n]
                for j in range(1, k):
                    response = response + got[at + j][:, j : n + j]
                pooled[i] = np.maximum(pooled[i], response.max(axis=1))
                at += k
        return float(np.maximum(pooled.ravel() + self.bias, 0) @ self.out + self.out_bias)

    def score(self, logit: float, language: str) -> float:
        x = logit - self.thresholds.get(language, self.thresholds.get("", 0.0))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def pad(rows: np.ndarray) -> np.ndarray:
    """At least as many rows as the widest filter."""
    return rows if len(rows) >= max(WIDTHS) else np.concatenate([rows, np.zeros(max(WIDTHS) - len(rows), rows.dtype)])


def language_of(weights: np.ndarray) -> str:
    return LANGUAGES[int(weights.argmax())] if weights.max() > 0 else "other"


def begin(buckets: np.ndarray, sure: np.ndarray, seed: int = 9) -> TextCnn:
    """The network before it learns, for sorted buckets. The first embedding dimension is how surely a bucket is commoner in texts
    of label 1 than in others, and the first filter reads it; everything is then learned further."""
    rng = np.random.default_rng(seed)
    embeddings = np.zeros((len(buckets) + 1, SIZE))
    embeddings[1:] = rng.normal(0, 0.02, (len(buckets), SIZE))
    embeddings[1:, 0] = np.clip(sure / 6, -0.5, 1.5)
    filters = {k: rng.normal(0, 0.05, (k, SIZE, FILTERS)) for k in WIDTHS}
    filters[1][0, :, 0] = np.eye(SIZE)[0]
    model = TextCnn(buckets, embeddings, filters, np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, len(WIDTHS) * FILTERS), -3.0)
    model.out[0] = 5.0
    return model


class Learner:
    """What one lot makes of a network, by Adagrad on single texts. Texts of label 1 weigh `weight`."""

    def __init__(self, start: TextCnn, weight: float, rate: float = 0.02):
        self.start, self.weight, self.rate, self.texts = start, weight, rate, 0
        self.embeddings, self.filters = start.embeddings.copy(), {k: w.copy() for k, w in start.filters.items()}
        self.bias, self.out, self.out_bias = start.bias.copy(), start.out.copy(), start.out_bias
        self.times = np.zeros(len(self.embeddings), np.int64)
        self.sums = {k: np.full_like(v, 1e-3) for k, v in self.filters.items()}
        self.sum_e, self.sum_b, self.sum_o, self.sum_c = np.full_like(self.embeddings, 1e-3), np.full_like(self.bias, 1e-3), np.full_like(self.out, 1e-3), 1e-3

    def step(self, rows: np.ndarray, label: int) -> None:
        """Learn from one text, the rows of its words' embeddings."""
        rate, x = self.rate, self.embeddings[rows]
        places, pooled = [], []
        for k in WIDTHS:
            n = len(x) - k + 1
            response = sum(x[j : n + j] @ self.filters[k][j] for j in range(k))
            places.append(response.argmax(axis=0))
            pooled.append(response[places[-1], np.arange(FILTERS)])
        before = np.concatenate(pooled) + self.bias
        hidden = np.maximum(before, 0)
        z = hidden @ self.out + self.out_bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * (self.weight if label else 1.0)
        grad_o, grad_h = off * hidden, off * self.out * (before > 0)
        self.sum_o += grad_o**2
        self.out -= rate * grad_o / np.sqrt(self.sum_o)
        self.sum_c += off**2
        self.out_bias -= rate * off / self.sum_c**0.5
        self.sum_b += grad_h**2
        self.bias -= rate * grad_h / np.sqrt(self.sum_b)
        for w, k in enumerate(WIDTHS):
            g = grad_h[w * FILTERS : (w + 1) * FILTERS]
            if not g.any():
                continue
            for j in range(k):
                at = rows[places[w] + j]
                grad_e = self.filters[k][j].T * g[:, None]
                grad_f = (self.embeddings[at] * g[:, None]).T
                grad_e[at == 0] = 0
                np.add.at(self.sum_e, at, grad_e**2)
                np.add.at(self.embeddings, at, -rate * grad_e / np.sqrt(self.sum_e[at]))
                np.add.at(self.times, at, 1)
                self.sums[k][j] += grad_f**2
                self.filters[k][j] -= rate * grad_f / np.sqrt(self.sums[k][j])
        self.embeddings[0] = 0
        self.texts += 1

    def moved(self) -> pa.RecordBatch:
        """Rows row, times, d0, d1 ... of what was changed, in units and times `times`: how often an embedding was changed, and for
        other parameters the number of texts."""
        self.times[0] = 0
        at = np.flatnonzero(self.times)
        own = TextCnn(self.start.buckets, self.embeddings, self.filters, self.bias, self.out, self.out_bias)
        dense = own.dense() - self.start.dense()
        rows = np.concatenate([at, len(self.embeddings) + np.arange(len(dense))])
        times = np.concatenate([self.times[at], np.full(len(dense), self.texts, np.int64)])
        change = np.rint(np.concatenate([self.embeddings[at] - self.start.embeddings[at], dense]) * UNIT).astype(np.int64) * times[:, None]
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(times), *[pa.array(np.ascontiguousarray(change[:, i])) for i in range(SIZE)]], names=["row", "times", *_CHANGES])


_CHANGES = [f"d{i}" for i in range(SIZE)]


def best_threshold(counts: dict[int, list[int]]) -> float:
    """The logit from which calling texts toxic gives the best F1, halfway to the next lower one that occurs. counts: texts of
    label 0 and of label 1 by the step that a logit lies in."""
    steps = sorted(counts, reverse=True)
    hits, called = np.cumsum([counts[x][1] for x in steps]), np.cumsum([sum(counts[x]) for x in steps])
    i = int((2 * hits / (called + hits[-1])).argmax())
    low = steps[i + 1] + 1 if i + 1 < len(steps) else steps[i] - 2 * STEPS
    return (steps[i] + low) / 2 / STEPS


def _bucket(word: str) -> int:
    return word_hash(plain(word), HASH_BITS)


def _describe(word: str) -> tuple[float, ...]:
    return (_bucket(word), *language_row(plain(word)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int | None = None) -> DataFrame:
    """Rows lot, rank, fold, label, buckets, language of the labelled documents outside fold 0, stored, in the order of rank in a lot; repeated rows
    count once. With `sample`, of about so many of them, chosen by hashes of ids."""
    known = labels.where(F.col(label).isin(0, 1) & (fold("doc_id") != 0))
    rows = known.count()
    if sample is not None and rows > sample:
        known = known.where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 20)) < int(sample / rows * (1 << 20)))
        rows = sample
    lots = max(LEAST_LOTS, pieces_of(rows, LOT_ROWS), pieces_of(docs.count(), 8 * LOT_ROWS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, languages = [], []
            for text in batch.column(4):
                words = text.as_py().split()
                table: WordTable = kept("toxicity-training", lambda: WordTable(_describe, 5, np.float32))
                at = table.rows(words)
                got = table.table[at]
                rows.append(got[:, 0].astype(np.int32).tobytes())
                languages.append(language_of(got[:, 1:].sum(axis=0)) if len(words) else "other")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, pa.binary()), pa.array(languages)], names=["lot", "rank", "fold", "label", "buckets", "language"])

    # Rows of one id share a partition, so repeated ones are found there. Lots depend on ids alone, not on how the tables are split.
    known = known.repartition(lots, "doc_id").groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(fold("doc_id") != 0).repartition(lots, "doc_id")
    both = texts.join(known, "doc_id").withColumn("rank", F.xxhash64(F.lit(29), "doc_id", "text")).dropDuplicates(["doc_id", "rank"])
    both = both.select(F.spark_partition_id().alias("lot"), "rank", fold("doc_id").cast("int").alias("fold"), "label", "text")
    got = both.mapInArrow(read, "lot int, rank long, fold int, label int, buckets binary, language string").sortWithinPartitions("rank", "buckets")
    # No more files than lots were asked for, where a session makes more partitions.
    return stored(got.coalesce(lots), "labelled")


def begun(train: DataFrame, ones: int, zeros: int) -> TextCnn:
    """The network as counts of all training texts by bucket and label make it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((keys & ((1 << HASH_BITS) - 1)).astype(np.int32)), pa.array((keys >> HASH_BITS).astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "label", "n"])

        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(np.unique(np.frombuffer(data.as_py(), np.int32)) | (label << HASH_BITS))
                size += len(held[-1])
            if size > 1 << 20:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    p, q = (F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)) for x in (1, 0))
    seen = train.select("label", "buckets").mapInArrow(count, "bucket int, label int, n long").groupBy("bucket").agg(p.alias("p"), q.alias("q"))
    odds = F.log((F.col("p") + 0.5) / (ones + 1)) - F.log((F.col("q") + 0.5) / (zeros + 1))
    sure = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    seen = seen.where(F.col("p") + F.col("q") >= LEAST_TEXTS).select("bucket", sure.alias("sure")).withColumn("level", F.floor(100 * F.log2(1 + F.abs("sure"))).cast("int")).persist()
    room, least = MOST_BUCKETS, 0
    for r in sorted(seen.groupBy("level").count().collect(), reverse=True):  # about 2,000 levels at most
        room -= r["count"]
        if room < 0:
            least = r["level"] + 1
            break
    got = seen.where(F.col("level") >= least).select("bucket", "sure").toArrow()  # MOST_BUCKETS rows at most
    seen.unpersist()
    buckets, sure = (got.column(i).to_numpy() for i in range(2))
    order = np.argsort(buckets)
    return begin(buckets[order].astype(np.int64), sure[order])


def learn_round(train: DataFrame, model: TextCnn, weight: float) -> None:
    """Let every lot learn on from the model, and add the mean of their changes to it."""
    shared = train.sparkSession.sparkContext.broadcast(model)  # of bounded size: see MOST_BUCKETS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, own = None, None
        for batch in batches:
            for at, label, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own is None or at != lot:
                    if own is not None:
                        yield own.moved()
                    lot, own = at, Learner(shared.value, weight)
                own.step(shared.value.index(np.frombuffer(data.as_py(), np.int32)), label)
        if own is not None:
            yield own.moved()

    # A lot is one run of rows in one file, so one task has it whole unless it is larger than a row group; parts of it count as lots then.
    moved = train.select("lot", "label", "buckets").mapInArrow(learn, "row int, times long, " + ", ".join(f"{c} long" for c in _CHANGES))
    got = moved.groupBy("row").agg(F.sum("times"), *[F.sum(c) for c in _CHANGES]).toArrow()  # a row for each of the network's, of SIZE numbers
    rows, times, *change = (c.to_numpy() for c in got.columns)
    model.add(rows, np.stack(change, axis=1) / times[:, None] / UNIT)
    shared.destroy()


def calibrate(check: DataFrame, model: TextCnn, least: int = 25) -> None:
    """Set thresholds for each language with `least` texts of label 1, and "" for all others."""
    shared = check.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, Counter()
        tables = model.tables()
        for batch in batches:
            for language, label, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                logit = model.logit(model.index(np.frombuffer(data.as_py(), np.int32)), tables)
                seen[language, math.floor(STEPS * min(max(logit, -FAR), FAR)), label] += 1
        if seen:
            columns = [*zip(*seen, strict=True), seen.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.int32(), pa.int64()], strict=True)], names=["language", "step", "label", "n"])

    counts = check.select("language", "label", "buckets").mapInArrow(count, "language string, step int, label int, n long").groupBy("language", "step", "label").agg(F.sum("n").alias("n"))
    by: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for r in counts.collect():  # languages, labels and steps are few
        for language in ("", r["language"]):
            by[language][r["step"]][r["label"]] += r["n"]
    for language, steps in sorted(by.items()):
        if sum(x[1] for x in steps.values()) >= (least if language else 1):
            model.thresholds[language] = best_threshold(steps)
    shared.destroy()


def train_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int | None = None) -> TextCnn:
    """A network that learned from all labelled rows, or from about `sample` of them where that is given: folds 2 to 4 train it, fold 1 sets
    the thresholds, fold 0 is never read.

    docs: doc_id, text; labels: doc_id and `label`. Labels that are null or neither 0 nor 1, and null ids, are left out; a document with
    both labels counts as 1. Repeated rows of either count once; null and empty texts are texts without words; very long
    ones are read whole. With no rows, or rows of one label, the network is as it begins.
    """
    rows = training_rows(docs, labels, label, sample)
    train, check = rows.where("fold <> 1"), rows.where("fold = 1")
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    model = begun(train, max(1, ones), max(1, zeros))
    if ones and zeros:
        for _ in range(ROUNDS):
            # Texts of the rarer label weigh more, though far less than fully so.
            learn_round(train, model, (zeros / ones) ** 0.25)
    calibrate(check, model)
    return model


def score_toxicity(docs: DataFrame, model: TextCnn) -> DataFrame:
    """Rows doc_id, language (as guessed), score, predicted.

    docs: doc_id, text; no other column is read. Null and empty texts score like any text without
    words, equal texts alike; repeated rows give repeated rows and no documents none. Very long texts are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stamp = f"toxicity-{uuid.uuid4().hex}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables().astype(np.float32)

        def table_of() -> WordTable:
            rows = model.rows()
            return WordTable(lambda w: (rows.get(word_hash(p := plain(w), HASH_BITS), 0), *language_row(p)), 5, np.float32)

        words: WordTable = kept(stamp, table_of)
        for batch in batches:
            languages, scores = [], []
            for text in batch.column(1):
                got = words.rows(text.as_py().split())
                table = words.table
                guess = language_of(table[got, 1:].sum(axis=0)) if len(got) else "other"
                languages.append(guess)
                scores.append(model.score(model.logit(table[got, 0].astype(np.int64), tables), guess))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "language", "score"])

    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(score, "doc_id long, language string, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
