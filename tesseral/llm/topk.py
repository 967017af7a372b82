"""Exact top-k inner products over integer vectors with KD-trees per shard.

Vectors are dealt into shards of bounded size, and each shard becomes one KD-tree (median splits on the widest
axis, tight bounding boxes), which is stored. Queries are sent to the trees and stream past them in batches; a tree answers each
query best-first. The bound of a box is the largest inner product that any point in it could have; boxes whose bound lies below the
query's k-th score so far are not opened. Every query first searches one home shard; the
k-th score found there is handed on to its searches of all the others. So vectors move once, and queries once for each shard.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.llm.common import pieces_of, stored

LEAF = 512
_OUT = "query long, query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows vec_id, dim, v: floor(scale * component) as long. Vectors that are null, or hold nulls or
    components that aren't finite, are left out."""
    usable = F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(usable).select(F.col(id_col).alias("vec_id"), F.size(vec_col).alias("dim"), v.alias("v"))


class KdTree:
    """Nodes in arrays: boxes low and high, children (or -1), and the span of points in a leaf."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.child: list[tuple[int, int]] = []
        self.span: list[tuple[int, int]] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = points[self.order[a:b]]
            node = len(self.low)
            self.low.append(here.min(axis=0))
            self.high.append(here.max(axis=0))
            self.child.append((-1, -1))
            self.span.append((a, b))
            if parent >= 0:
                pair = list(self.child[parent])
                pair[side] = node
                self.child[parent] = (pair[0], pair[1])
            width = self.high[-1] - self.low[-1]
            if b - a > leaf and width.max() > 0:
                middle = (b - a) // 2
                by = np.argpartition(here[:, int(width.argmax())], middle)
                self.order[a:b] = self.order[a:b][by]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.points, self.ids = points[self.order], ids[self.order]
        self.boxes = np.stack(self.low), np.stack(self.high)
        self.most = int(max(abs(int(x)) for x in (points.min(), points.max())))

    def ready(self, queries: np.ndarray) -> np.ndarray:
        """The queries, in a type in which their products with all points are whole; the tree's numbers become of that type."""
        most = int(max(abs(int(x)) for x in (queries.min(), queries.max())))
        # Sums stay whole numbers in float64 up to 2 ** 53; beyond that Python's integers do it.
        kind = np.float64 if self.most * most * queries.shape[1] < 1 << 53 and self.points.dtype != object else object
        if self.points.dtype != kind:
            self.points, self.boxes = self.points.astype(kind), tuple(x.astype(kind) for x in self.boxes)
        return queries.astype(kind)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the most that an inner product with a point of the node's box can be."""
        low, high = self.boxes
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), but for `own`; those below `floor` may be missing. Ties go to smaller ids."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id), worst first
        worst = floor
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if worst is not None and -bound < worst:
                break
            a, b = self.span[node]
            left, right = self.child[node]
            if left >= 0:
                heapq.heappush(todo, (-bounds[left], left))
                heapq.heappush(todo, (-bounds[right], right))
                continue
            scores = self.points[a:b] @ query
            near = np.flatnonzero(scores >= worst) if worst is not None else np.arange(b - a)
            near = near[self.ids[a + near] != own]
            if len(near) > 4 * k:  # no more than k, and all ties with the last of them, can matter
                cut = np.partition(scores[near], len(near) - k)[len(near) - k]
                near = near[scores[near] >= cut]
            for i in near:
                item = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (worst is None or best[0][0] > worst):
                worst = best[0][0]
        return [(s, -x) for s, x in best]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), dim)


def _grow(leaf: int):
    """The tree of one shard, in the smallest whole numbers that hold it."""

    def grow(key: tuple, vectors: pa.Table) -> pa.Table:
        v = _matrix(vectors["v"], key[0].as_py())
        for kind in (np.int16, np.int32):
            if np.iinfo(kind).min <= v.min() and v.max() <= np.iinfo(kind).max:
                v = v.astype(kind)
                break
        tree = pickle.dumps(KdTree(v, vectors["vec_id"].to_numpy(), leaf))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([tree], pa.binary())})

    return grow


def _answer(k: int):
    """Rows in the order of shards, each shard's tree before its queries, to what the trees find."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            kinds, i = batch.column(2).to_pylist(), 0
            while i < len(places):
                if kinds[i] == 0:
                    at, tree = places[i], pickle.loads(batch.column(3)[i].as_py())
                    i += 1
                    continue
                j = i
                while j < len(places) and kinds[j] == 1 and places[j] == places[i]:
                    j += 1
                if places[i] == at:  # else a query of a dimension that no vector of this shard has
                    part = batch.slice(i, j - i)
                    q = tree.ready(_matrix(part.column(6), at[0]))
                    bounds = tree.bounds(q)
                    for n, (row, own, floor) in enumerate(zip(part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(7).to_pylist(), strict=True)):
                        rows += [(row, own, x, s) for s, x in tree.search(q[n], bounds[n], own, k, floor)]
                i = j
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return answer


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, shard_rows: int = 16_384, leaf: int = LEAF) -> DataFrame:
    """Rows query_id, rank, vec_id, score: each query's k highest inner products, ties to smaller ids.

    vectors, queries: vec_id, dim, v as quantized() makes them, other columns are not read; only vectors of a query's dimension are
    compared with it, and none with the query's own id. A query with fewer than k others
    has all of them; one with none has no rows. Repeated rows of `vectors` are candidates each, and
    repeated queries are answered each. Null ids are left out. Without vectors or without queries there are no rows.
    """
    vectors = stored(vectors.where(F.col("vec_id").isNotNull() & (F.col("dim") > 0)).select("vec_id", "dim", "v"), "vectors")
    queries = queries.where(F.col("vec_id").isNotNull() & (F.col("dim") > 0))
    queries = stored(queries.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "dim", "v"), "queries")
    shards = pieces_of(vectors.count(), shard_rows)
    # Rows of a stored table come in a fixed order, so their numbers deal even repeated rows evenly and alike on each run.
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    trees = stored(dealt.groupBy("dim", "shard").applyInArrow(_grow(leaf), "dim int, shard int, tree binary"), "trees")
    asked = queries.withColumn("home", F.pmod(F.xxhash64("query"), F.lit(shards)).cast("int"))

    def run(part: DataFrame) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        held = trees.select("dim", "shard", F.lit(0).alias("kind"), "tree", none("long").alias("query"), none("long").alias("query_id"), none("array<bigint>").alias("v"), none("long").alias("floor"))
        sent = part.select("dim", "shard", F.lit(1).alias("kind"), none("binary").alias("tree"), "query", "query_id", "v", "floor")
        # As many partitions as shards: a partition holds a few trees, and one batch no more.
        rows = held.unionByName(sent).repartition(min(shards, 1 << 14), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        return rows.mapInArrow(_answer(k), _OUT)

    at_home = stored(run(asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("long"))), "home")
    found = at_home
    if shards > 1:
        # The k-th score at home, where k were found.
        kth = at_home.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        away = asked.join(kth, "query", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard != home")
        found = at_home.unionByName(run(away))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
