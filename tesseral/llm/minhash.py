"""Near-duplicate documents by Order MinHash.

A text is a sequence of words (lower case, split at white space). Its k-mers are runs of five
words, each labelled with its occurrence number so that repeats count. For each of several
hash orders the sketch of a text is its few smallest labelled k-mers *in the order of the text*: texts
agree on a sketch if they share those k-mers and have them in the same order, so agreement follows
edit similarity rather than mere overlap.

Candidates agree on a sketch; if one of them has few k-mers, they share some of their rarest ones. They are verified on the whole
texts by a banded alignment of their words: with L words aligned in order, the similarity is
L / (n + m - L), and 0.8 or more links two texts.

Exact copies are classed first, so one text stands for all its copies. In each bucket of equal
sketches every text is first compared with the bucket's leader only; texts that end up in one class
need no more comparisons. Only buckets that still hold several classes pair their texts across classes. Before texts are fetched, pairs
are sifted by what an alignment of the threshold entails: lengths that allow it, and enough equal minimum hashes of single words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.llm.common import stored, text_or_empty
from tesseral.llm.words import let_go

WORDS = 5
THRESHOLD = 0.8
#: So many sketches are made; texts meet if they agree on one. One that takes more k-mers is rarer among texts that
#: share a passage, but also among copies with scattered edits: with a tenth of all words changed two texts share 0.33 to 0.42 of
#: their k-mers and agree on a sketch of three with a probability of 0.04 to 0.07, so 91 to 99 in 100 such pairs meet.
SKETCHES = 64
SMALLEST = 3
#: Columns that hold a bit of each of MARKED minimum hashes of single words, 64 in a long. Unequal minima agree in it half the time. Two longs are
#: compared by counting bits, which keeps the test of a pair short enough for compiled code.
MARKED = 1024
MARKS = tuple(f"m{i}" for i in range(MARKED // 64))
#: Pairs are verified if they agree on as many minima as pairs at the threshold do but for this share.
LOST = 1e-5
#: Pairs of which one text has up to so many k-mers are found by shared k-mers instead of sketches.
SHORT = 24
#: Larger buckets, and texts in more pairs, are dealt over several tasks.
BUCKET_ROWS = 2_000
PAIR_ROWS = 500
#: Up to so many texts the keys of those to align are broadcast, some 50 bytes each; beyond that the texts are shuffled to them.
BROADCAST_TEXTS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> np.ndarray:
    """Hashes of the text's words in order."""
    data = text.lower().encode("utf-8", "surrogatepass").split()
    w = np.fromiter(map(zlib.crc32, data), np.uint64, len(data))
    w = (w + np.uint64(1)) * _MIX
    return w ^ (w >> np.uint64(29))


def kmers(w: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the k-mers of a sequence of words; fewer words than a k-mer has are one k-mer, none have none."""
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(words, len(w))):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + w[j : j + n]
        h ^= h >> np.uint64(31)
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """The hashes mixed with how often the same k-mer stood before."""
    if not len(h):
        return h
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    out = h.copy()
    if not new.all():
        starts = np.flatnonzero(new)
        nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
        out[order] += nth.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(30)
    return out * _MIX


_orders = np.random.default_rng(20_261).integers(1, 1 << 63, max(SKETCHES, MARKED), np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(h: np.ndarray) -> np.ndarray:
    """A 64-bit key for each order: the SMALLEST labelled k-mers under it, in the order of the text."""
    x = labelled(h)
    k = min(SMALLEST, len(x))
    if not k:
        return np.zeros(0, np.int64)
    picked = np.empty((SKETCHES, k), np.int64)
    step = max(1, (1 << 17) // len(x))
    for a in range(0, SKETCHES, step):
        values = x[None, :] * _orders[a : min(a + step, SKETCHES), None]
        picked[a : a + step] = np.argpartition(values, k - 1, axis=1)[:, :k] if k < len(x) else np.arange(k)
    picked.sort(axis=1)
    keys = np.zeros(SKETCHES, np.uint64)
    for j in range(k):
        keys = keys * np.uint64(0xFF51AFD7ED558CCD) + x[picked[:, j]]
        keys ^= keys >> np.uint64(33)
    return (keys + _orders[:SKETCHES]).view(np.int64)  # another key for each order


def marks(w: np.ndarray) -> np.ndarray:
    """A bit for each order, of the smallest labelled word under it, packed in bytes."""
    x = labelled(w)
    if not len(x):
        return np.zeros(MARKED // 8, np.uint8)
    step = max(1, (1 << 17) // len(x))
    least = [(x[None, :] * _orders[a : min(a + step, MARKED), None]).min(axis=1) for a in range(0, MARKED, step)]
    return np.packbits((np.concatenate(least) >> np.uint64(20)).astype(np.uint8) & 1)


def bag_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two bags of words; no alignment is more similar than the bags."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(a) + len(b) - common)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """L / (n + m - L) for the longest common subsequence L of two sequences within the band
    that the threshold allows; 0 if it is surely below the threshold.

    If the similarity is t, at most (1 - t) / (1 + t) * (n + m) words stay without a partner, so no partners are
    further apart. The alignment is bit-parallel: a row of the table is one integer.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < threshold * max(n, m):
        return 0.0
    if n == m and (a == b).all():
        return 1.0
    band = int((1 - threshold) / (1 + threshold) * (n + m)) + 1
    common = min(n, m)
    same = a[:common] == b[:common]
    head = common if same.all() else int(same.argmin())
    same = a[n - common + head :][::-1] == b[m - common + head :][::-1]
    tail = len(same) if same.all() else int(same.argmin())
    core_a, core_b = a[head : n - tail], b[head : m - tail]
    length = head + tail
    if len(core_a) and len(core_b):
        places: dict[int, int] = {}
        for i, x in enumerate(core_a.tolist()):
            places[x] = places.get(x, 0) | 1 << i
        every = (1 << len(core_a)) - 1
        window = (1 << (2 * band + 1)) - 1
        v = every
        for j, x in enumerate(core_b.tolist()):
            at = places.get(x, 0)
            if at:
                at &= window << (j - band) if j >= band else window >> (band - j)
                u = v & at
                v = ((v + u) | (v - u)) & every
        length += len(core_a) - v.bit_count()
    return length / (n + m - length)


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:  # noqa: ANN001
    """A join that broadcasts nothing: loops would leave many relations with the driver."""
    return left.join(right.hint("merge"), on, how)


def sketch_table(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows doc_id, copy (a 128-bit hash of the whole text), size (its words), grams (the labelled k-mers of texts that have few), keys (the
    sketches; texts of up to SHORT k-mers have none) and m0, m1, ...: its marks."""
    reach = (SHORT + WORDS - 1) / threshold + 1e-9  # a text of more words is no partner of one of SHORT k-mers

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sizes, grams, keys, marked = [], [], [], np.zeros((len(batch), MARKED // 8), np.uint8)
            for i, text in enumerate(batch.column(2)):
                w = words_of(text.as_py())
                h = kmers(w)
                sizes.append(len(w))
                grams.append(labelled(h).view(np.int64) if 0 < len(w) <= reach else None)
                keys.append(sketches(h) if len(h) > SHORT else np.zeros(0, np.int64))
                marked[i] = marks(w)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in np.ascontiguousarray(marked.view(np.int64).T)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "size", "grams", "keys", *MARKS])

    return _with_copy(docs).select("doc_id", "copy", "_text").mapInArrow(sketch, "doc_id long, copy binary, size long, grams array<long>, keys array<long>, " + ", ".join(f"{m} long" for m in MARKS))


def _with_copy(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text", text_or_empty()).withColumn("copy", F.unhex(F.md5(F.col("_text").cast("binary"))))


def _texts_of(pairs: DataFrame, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Rows id, text of the texts in pairs (a, b), once each."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = stored(_joined(wanted, distinct.select("id", "copy", "doc_id"), "id"), "wanted")
    rows = _with_copy(docs).select(F.col("copy").alias("_copy"), F.col("doc_id").alias("_doc"), "_text")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    found = rows.join(side, (F.col("_copy") == F.col("copy")) & F.equal_null("_doc", "doc_id"))
    # Only repeated rows are still there twice.
    return stored(found.select("id", F.col("_text").alias("text")).dropDuplicates(["id"]), "texts")


def compared(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are as similar as the threshold, with similarity. A text of many pairs is
    repeated for parts of them, so its pairs don't meet in one task."""
    texts = _texts_of(pairs, docs, distinct)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        last, known = None, None
        for batch in batches:
            out = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:  # pairs come in runs with the same first text
                    last, known = a, words_of(x.as_py())
                other = words_of(y.as_py())
                out.append(aligned(known, other, threshold) if bag_similarity(known, other) >= threshold else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    parts = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts")), "parts")
    dealt = _joined(pairs, parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    both = _joined(dealt, texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    first = _joined(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), parts, "a")
    first = first.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = _joined(both, first, ["a", "part"])
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(align, "a long, b long, similarity double")
    return found.where(F.col("similarity") >= threshold)


def components(links: DataFrame, *, steps: int = 60) -> DataFrame:
    """Rows node, root: the smallest node of each connected component of links (a, b).

    Alternates large-star and small-star steps until the edges are stars; each step is a
    grouped minimum and a join, and is written out, so no component meets in one task or on the driver.
    The steps needed grow with the logarithm of the longest chain; beyond `steps` it fails.
    """
    files = links.sparkSession.sparkContext.defaultParallelism  # edges are few and short: no more files than cores
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct().coalesce(files), "edges")
    before = None
    for _ in range(steps):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = _joined(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, least, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = stored(small.coalesce(files), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {steps} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (id, ...) with the root of each id: itself if it has no link."""
    return _joined(rows, roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


@cache
def needed_marks(threshold: float) -> int:
    """On so many marks, or more, all pairs as similar as the threshold agree but for LOST: their bags of words are as similar,
    so the minima are equal with that probability, and a bit agrees with half the rest."""
    p = threshold + (1 - threshold) / 2
    below, a = (1 - p) ** MARKED, 0
    while below <= LOST:
        a += 1
        below += math.comb(MARKED, a) * p**a * (1 - p) ** (MARKED - a)
    return a


def _alike(p: str, q: str, threshold: float) -> Column:
    """Whether the sizes and marks of two rows allow the threshold."""
    apart = reduce(Column.__add__, (F.bit_count(F.col(p + m).bitwiseXOR(F.col(q + m))) for m in MARKS))
    return (F.least(p + "size", q + "size") >= threshold * F.greatest(p + "size", q + "size")) & (apart <= MARKED - needed_marks(threshold))


def short_bands(distinct: DataFrame, threshold: float) -> DataFrame:
    """Rows id, key: for each text with grams its rarest k-mers, so many that similar texts share one of them.

    At most n * (1 - t) / (1 + t) words of n are substituted at threshold t, each in at most five k-mers. With room for one edit more, the
    first so many k-mers and one, in whatever order, hold one that both texts have; the order of rarity keeps the buckets small.
    """
    grams = distinct.where(F.col("grams").isNotNull()).select("id", "size", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1")
    ranked = _joined(grams, often, "gram", "left").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "gram"))).alias("ranked"))
    edits = F.floor(F.col("size") * ((1 - threshold) / (1 + threshold)) + 1e-9) + 1
    first = F.slice("ranked", F.lit(1), (WORDS * edits + 1).cast("int"))
    return ranked.select("id", F.explode(first).alias("first")).where("first.often > 1").select("id", F.xxhash64(F.lit(5), "first.gram").alias("key"))


def components_of(docs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """Rows node, root: the components of the links among the distinct texts (id, copy, doc_id, size, grams, keys, m0, m1, ...)."""
    bands = distinct.select("id", F.explode("keys").alias("key")).unionByName(short_bands(distinct, threshold))
    several = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(_joined(bands, several, "key"), "shared")
    # A bucket's leader is the text that shares most sketches with others: one in the middle of its group.
    degree = shared.groupBy("id").agg(F.count("*").alias("degree"))
    leaders = _joined(shared, degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("leader"))
    members = stored(_joined(shared, leaders.select("key", F.col("leader.id").alias("leader")), "key"), "members")
    traits = distinct.select("id", "size", *MARKS)
    side = lambda p: traits.select([F.col(c).alias(p + c) for c in traits.columns])
    stars = members.where("id != leader").select(F.col("leader").alias("a_id"), F.col("id").alias("b_id")).distinct()
    stars = _joined(_joined(stars, side("b_"), "b_id"), side("a_"), "a_id").where(_alike("a_", "b_", threshold))
    stars = stored(stars.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "stars")
    links = stored(compared(stars, docs, distinct, threshold), "links")
    roots = components(links)

    # Buckets that still hold several classes.
    classed = stored(_rooted(members.select("key", "id", "n"), roots), "classed")
    mixed = classed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    still = _joined(_joined(classed, mixed, "key"), traits, "id").withColumn("short", F.hash("key"))
    own = still.groupBy("id").agg(F.array_sort(F.collect_set("short")).alias("own"))
    still = _joined(still, own, "id").select("key", "short", "id", "size", "root", "own", *MARKS, F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts"))
    still = stored(still, "open")
    # A bucket of many texts is dealt into parts on one side and repeated on the other. A pair is made in the first of
    # its common buckets only.
    p = still.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    q = still.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    p, q = (x.select([F.col(c).alias(s + c) for c in x.columns]) for s, x in (("p_", p), ("q_", q)))
    tests = [
        F.col("p_key") == F.col("q_key"), F.col("p_part") == F.col("q_part"), F.col("p_id") < F.col("q_id"), F.col("p_root") != F.col("q_root"),
        _alike("p_", "q_", threshold), F.array_min(F.array_intersect("p_own", "q_own")) == F.col("p_short"),
    ]
    across = _joined(p, q, reduce(Column.__and__, tests)).select(F.col("p_id").alias("a"), F.col("q_id").alias("b")).distinct()
    known = stars.select("a", "b").union(stars.select("b", "a"))
    pairs = stored(_joined(across, known, ["a", "b"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return roots
    return components(links.unionByName(stored(compared(pairs, docs, distinct, threshold), "links")))


def duplicate_classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Rows doc_id, copy, class_id, kept: one for each row of docs.

    A class is a set of texts joined by links, with all their copies; class_id is its smallest doc_id. Texts are linked if they share a run of
    five words and their words align to the threshold. kept holds for the rows with that doc_id and, should several texts have it, the first of them by hash.
    docs: doc_id, text; other columns are not read. A null text is an empty one; blank texts are
    copies of each other if they are equal, and linked to nothing else. Texts of fewer than five words are
    one k-mer, so only those of the same words are linked. Very long texts are sketched and aligned whole, row by row of a banded table.
    Null ids are classed like others but come after all numbers; a class of null ids alone has a null class_id.
    Repeated rows are copies of each other. No documents give no rows.
    """
    table = stored(sketch_table(docs, threshold), "sketches")
    distinct = table.groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("grams").alias("grams"), F.first("keys").alias("keys"), *[F.first(m).alias(m) for m in MARKS])
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")  # numbered once, as written
    roots = components_of(docs, distinct, threshold)

    classed = _rooted(distinct.select("id", "copy", "doc_id"), roots)
    first = classed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first"))
    classed = _joined(classed, first, "root")
    classed = classed.select(F.col("copy").alias("_copy"), F.col("first.doc_id").alias("class_id"), (F.col("copy") == F.col("first.copy")).alias("_stands"))
    out = _joined(table.select("doc_id", "copy"), stored(classed, "classes"), F.col("copy") == F.col("_copy"))
    return out.select("doc_id", "copy", "class_id", (F.col("_stands") & F.equal_null("doc_id", "class_id")).alias("kept"))


def keep_one_each(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stand for their classes, with the columns of docs: one row of each class."""
    kept = duplicate_classes(docs, threshold=threshold).where("kept")
    kept = stored(kept.groupBy("copy", "doc_id").agg(F.count("*").alias("_n")).withColumnRenamed("copy", "_copy").withColumnRenamed("doc_id", "_doc"), "kept")
    rows = _with_copy(docs.withColumnRenamed("copy", "_own_copy")) if "copy" in docs.columns else _with_copy(docs)
    rows = _joined(rows, kept, (F.col("copy") == F.col("_copy")) & F.equal_null("doc_id", "_doc"))
    out = [F.col("_own_copy").alias("copy") if c == "copy" else F.col(c) for c in docs.columns]
    once = rows.where("_n = 1").select(*out)
    if kept.where("_n > 1").isEmpty():
        return once
    return once.unionByName(rows.where("_n > 1").dropDuplicates(["_copy", "_doc"]).select(*out))
