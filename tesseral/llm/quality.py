"""Quality classifier from weak labels.

Nine heuristic labellers vote good, bad or nothing on each document. Their accuracies
are estimated by expectation-maximisation over the counts of vote patterns of all documents:
there are at most 3 ** 9 patterns, so the driver gets a bounded table of counts, whatever the corpus.
The posterior of a pattern is the soft label by which a linear scorer over hashed features
(words, word shapes and binned statistics) learns on a bounded sample. The scorer then reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesseral.llm.common import bounded, stored, text_or_empty
from tesseral.llm.words import FUNCTION, WordTable, kept, let_go, plain, word_hash

BITS = 18
SPACE = 1 << BITS
#: The scorer learns from no more bytes of features: some three million.
SAMPLE_BYTES = 24 << 20
LABELLERS = ("symbols", "capitals", "one_word", "repeats", "bare_marks", "function_words", "runs", "length", "marked_words")
#: What a word is described by: characters, letters, capitals, symbols, whether it has no letter,
#: whether it ends in two marks or more, whether it is a function word, and two feature numbers.
_CHARS, _LETTERS, _CAPITALS, _SYMBOLS, _BARE, _MARKED, _FUNCTION, _SHAPE, _WORD = range(9)
_COMMON_MARKS = set(".,;:'\"!?()-’“”„«»…")


def _shape(word: str) -> str:
    """Runs of capitals, other letters, digits and each mark, as A, a, 0 and the mark."""
    kinds = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not kinds or kinds[-1] != k:
            kinds.append(k)
    return "".join(kinds)


_simple_shapes = {}


def _describe(word: str) -> tuple[int, ...]:
    core = plain(word)
    function, number = core in FUNCTION, word_hash("w" + core, BITS)
    n = len(word)
    letters = n if word.isalpha() else n - 1 if word[:-1].isalpha() and word[-1] in ".,;" else 0
    if letters and (low := word.islower()) | word.istitle():  # as most words are
        key = (low, letters == 1, word[letters:])
        if key not in _simple_shapes:
            _simple_shapes[key] = word_hash("s" + _shape(word), BITS)
        return (n, letters, not low, 0, False, False, function, _simple_shapes[key], number)
    letters = sum(map(str.isalpha, word))
    symbols = sum(not c.isalnum() and c not in _COMMON_MARKS for c in word)
    marked = n > 2 and not word[-1].isalnum() and not word[-2].isalnum()
    return (n, letters, sum(map(str.isupper, word)), symbols, letters == 0, marked, function, word_hash("s" + _shape(word), BITS), number)


def _repeated(values: np.ndarray) -> float:
    """The share of values that are not the first of their kind."""
    s = np.sort(values)
    return 1 - (1 + np.count_nonzero(s[1:] != s[:-1])) / len(s)


@dataclass
class Reading:
    votes: np.ndarray  # for each labeller: 1 good, 2 bad, 0 nothing
    features: np.ndarray
    values: np.ndarray


def read_text(text: str, *, with_features: bool = True) -> Reading:
    """Votes and, if asked for, hashed features of a whole text; blank texts have neither."""
    words = text.split()
    votes = np.zeros(len(LABELLERS), np.int64)
    if not words:
        return Reading(votes, np.zeros(0, np.int64), np.zeros(0, np.float32))
    known: WordTable = kept("quality", lambda: WordTable(_describe, 9, np.int32))
    rows = known.rows(words)
    distinct, counts = np.unique(rows, return_counts=True)
    table = known.table[distinct]
    n = len(words)
    chars, letters, capitals, symbols, bare, marked, function = (counts @ table[:, :7]).tolist()
    five = rows * 1_000_003
    for k in range(1, 5):
        five = five[: len(five) - 1] * 1_000_003 + rows[k:] if n > 4 else five
    stats = {
        "symbols": symbols / chars,
        "capitals": capitals / max(letters, 1),
        "one_word": counts.max() / n if n >= 20 else 0.0,
        "repeats": _repeated(five) if n >= 20 else 0.0,
        "bare_marks": bare / n,
        "function_words": function / n,
        "runs": np.count_nonzero(rows[1:] == rows[:-1]) / n,
        "word_length": chars / n,
        "length": float(n),
        "marked_words": marked / n,
    }
    #: good up to, bad from (fixed values); between them a labeller says nothing.
    for i, (name, good, bad) in enumerate((("symbols", 0.04, 0.12), ("capitals", 0.25, 0.5), ("one_word", 0.15, 0.3), ("repeats", 0.25, 0.5), ("bare_marks", 0.1, 0.3), (None, 0, 0), ("runs", 0.05, 0.25), (None, 0, 0), ("marked_words", 0.08, 0.25))):
        if name:
            votes[i] = 1 if stats[name] <= good else 2 if stats[name] >= bad else 0
    if n >= 30:
        votes[5] = 1 if stats["function_words"] >= 0.08 else 2 if stats["function_words"] <= 0.01 else 0
    if n < 20:  # too short for shares of marks to tell much
        votes[4] = votes[8] = 0
    votes[7] = 1 if n >= 15 else 0

    if not with_features:
        return Reading(votes, np.zeros(0, np.int64), np.zeros(0, np.float32))
    bins = [word_hash(f"b{name}:{min(9, int(x * 10))}", BITS) for name, x in stats.items() if name not in ("word_length", "length")]
    bins += [word_hash(f"bword_length:{min(20, int(stats['word_length']))}", BITS), word_hash(f"blength:{n.bit_length()}", BITS)]
    features = np.concatenate([table[:, _SHAPE], table[:, _WORD], bins]).astype(np.int64)
    values = np.concatenate([counts / n * 4, counts / n, np.ones(len(bins))]).astype(np.float32)
    return Reading(votes, features, values)


def pattern_of(votes: np.ndarray) -> int:
    return int(votes @ 3 ** np.arange(len(votes)))


@dataclass
class LabelModel:
    prior: float
    good: np.ndarray  # how often a labeller that votes on a good document says good
    bad: np.ndarray  # how often one that votes on a bad document says bad

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that documents with these vote patterns are good."""
        votes = patterns[:, None] // 3 ** np.arange(len(self.good)) % 3
        up = np.log(self.prior) + np.where(votes == 1, np.log(self.good), np.where(votes == 2, np.log1p(-self.good), 0)).sum(axis=1)
        down = np.log1p(-self.prior) + np.where(votes == 2, np.log(self.bad), np.where(votes == 1, np.log1p(-self.bad), 0)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(down - up, -500, 500)))


def fit_labellers(counts: dict[int, int], steps: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns: {pattern: documents}.

    Prior counts keep every labeller better than a coin on good documents and leave room for
    labellers that see one kind of bad document only.
    """
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    model = LabelModel(0.85, np.full(len(LABELLERS), 0.98), np.full(len(LABELLERS), 0.4))
    for _ in range(steps if len(n) else 0):
        p = model.posterior(patterns)
        g, b = n * p, n * (1 - p)
        says_good, says_bad = votes == 1, votes == 2
        good = (g @ says_good + 49) / (g @ (says_good | says_bad) + 50)
        bad = (b @ says_bad + 2) / (b @ (says_good | says_bad) + 6)
        model = LabelModel(float(np.clip((g.sum() + 17) / (n.sum() + 20), 0.5, 0.999)), np.clip(good, 0.6, 0.9995), np.clip(bad, 0.02, 0.98))
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, reading: Reading) -> float:
        """From 0 (bad) to 1 (good); 0 for blank texts."""
        if not len(reading.features):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[reading.features] @ reading.values + self.bias, -30, 30))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 120, rate: float = 0.3) -> Scorer:
    """Logistic regression on soft labels by full-batch Adagrad steps with a little decay."""
    weights, bias = np.zeros(SPACE, np.float32), 0.0
    if not rows:
        return Scorer(weights, bias)
    at = np.concatenate([f for f, _ in rows])
    used, column = np.unique(at, return_inverse=True)
    value = np.concatenate([v for _, v in rows])
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    w, squares, bias_square = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(doc, value * w[column], len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        grad = np.bincount(column, value * off[doc], len(used)) + 1e-6 * w
        squares += grad**2
        w -= rate * grad / np.sqrt(squares)
        bias_square += off.sum() ** 2
        bias -= rate * off.sum() / np.sqrt(bias_square)
    weights[used] = w
    return Scorer(weights, float(bias))


def _patterns(docs: DataFrame) -> dict[int, int]:
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, int] = {}
            for text in batch.column(0):
                p = pattern_of(read_text(text.as_py(), with_features=False).votes)
                found[p] = found.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(votes, "pattern long, n long")
    return {r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def _sample(docs: DataFrame, rows: int, most: int, most_bytes: int) -> DataFrame:
    """Rows pattern, features, values (as bytes) of about `most` different documents, picked by a hash of id and text; repeated rows
    count once. If they have more than `most_bytes`, as many as fit: see bounded()."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_text(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([pattern_of(r.votes) for r in got], pa.int64()), pa.array([r.features.astype(np.int32).tobytes() for r in got], pa.binary()), pa.array([r.values.tobytes() for r in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rank", "pattern", "features", "values"])

    part = min(1.0, most / max(rows, 1))
    picked = docs.select("doc_id", text_or_empty().alias("text")).where(F.pmod(F.xxhash64(F.lit(41), "doc_id", "text"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    ranked = picked.select(F.xxhash64(F.lit(43), "doc_id", "text").alias("rank"), "text").dropDuplicates(["rank"])
    read_ = stored(ranked.mapInArrow(read, "rank long, pattern long, features binary, values binary").where(F.length("features") > 0), "sample")
    # About `most` rows, whatever the corpus.
    return bounded(read_, F.length("features") + F.length("values"), most_bytes)


def _train(sample: DataFrame, labellers: LabelModel) -> Scorer | None:
    """The scorer, fitted in one task: the sample is bounded. None if there is nothing to learn from."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((r["pattern"], r["features"], r["values"]) for b in batches for r in b.to_pylist()))
        rows = [(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)) for _, f, v in got]
        scorer = fit_scorer(rows, labellers.posterior(np.array([p for p, _, _ in got], np.int64)) if got else np.zeros(0))
        n = len(rows)
        del got, rows
        let_go()  # the sample took far more memory than the scoring to come
        yield pa.RecordBatch.from_arrays([pa.array([scorer.weights.tobytes()], pa.binary()), pa.array([scorer.bias], pa.float64()), pa.array([n], pa.int64())], names=["weights", "bias", "rows"])

    made = sample.select("pattern", "features", "values").repartition(1).mapInArrow(fit, "weights binary, bias double, rows long").first()
    return Scorer(np.frombuffer(made["weights"], np.float32), made["bias"]) if made and made["rows"] else None


def classify_quality(docs: DataFrame, *, sample: int = 4_000, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """docs with quality (0 to 1, higher is better), posterior (of the labellers' votes) and kept (quality >= 0.5).

    docs: doc_id, text and any others, all kept; columns named like the three new ones are replaced. Null
    and blank texts score 0 and aren't kept; equal texts score alike, so repeated rows do. Labellers' accuracies
    come from all documents; the scorer learns on about `sample` of them and at most `sample_bytes` of their features, and if none fits, the posterior is the quality. Very long texts are read whole.
    No documents give no rows.
    """
    docs = docs.drop("quality", "posterior", "kept")
    counts = _patterns(docs)
    labellers = fit_labellers(counts)
    scorer = _train(_sample(docs, sum(counts.values()), sample, sample_bytes), labellers)
    shared = docs.sparkSession.sparkContext.broadcast((labellers, scorer))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labellers, scorer = shared.value
        for batch in batches:
            got = [read_text(t.as_py() or "") for t in batch.column(text_at)]
            posterior = labellers.posterior(np.array([pattern_of(r.votes) for r in got], np.int64))
            quality = [scorer.score(r) if scorer else float(p) * (len(r.features) > 0) for r, p in zip(got, posterior, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quality, pa.float64()), pa.array(posterior, pa.float64())], names=[*batch.schema.names, "quality", "posterior"])

    text_at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("quality", DoubleType()), StructField("posterior", DoubleType())])
    return docs.mapInArrow(score, schema).withColumn("kept", F.col("quality") >= 0.5)
