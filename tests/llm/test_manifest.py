"""Brute force for the Merkle manifest."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tesseral.llm import merkle
from tesseral.llm.queries import ORACLE_SQL, op13_merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    """The root, and for each node its siblings level by level: (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    level = list(nodes)
    while len(level) > 1:
        for i in range(len(nodes)):
            run = level[at[i] // fanout * fanout :][:fanout]
            own = at[i] % fanout
            paths[i].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at[i] //= fanout
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def fold(node, path):
    for left, right in path:
        node = h(left, node, right)
    return node


def by_hand(rows, fanout=3):
    """Rows of the query for dicts of documents."""
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, h(*[field(r[f]) for f in FIELDS]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in sources[s]], fanout)
    if not order:
        return []
    root, above = tree([trees[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, above, strict=True):
        for (_, _, leaf, r), path in zip(sources[s], trees[s][1], strict=True):
            changed = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = r["text"] and r["text"].replace("\n", "")
                changed = h(*[field(text if f == "text" else r[f]) for f in FIELDS])
            way = path + up
            out.append((r["doc_id"], leaf, trees[s][0], root, h(*[a + b for a, b in way]), fold(changed, way), fold(changed, way) == root))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir, documents):
    got = rows_of(op13_merkle_manifest(spark, sf_dir))
    assert got == sorted(by_hand([r.asDict() for r in documents]), key=str)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_trees_of_many_sizes(spark, fanout):
    rows = [dict(doc_id=i * 7 % 1000, source=None if n == 5 else f"s{n}", lang="x", n_chars=None, text=f"{i}") for n in (1, 2, 3, 4, 5, 9, 10, 27, 28, 100) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    made = merkle.manifest(docs, FIELDS, group="source", order="doc_id", fanout=fanout)
    made = made.select("doc_id", *[merkle.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest(F.col("path")).alias("p"))
    same = made.withColumn("folded", F.col("root"))
    assert sorted(r[:5] for r in rows_of(same)) == sorted(r[:5] for r in by_hand(rows, fanout))


def test_a_hot_group_lies_in_many_ranges(spark):
    rows = spark.range(3000).selectExpr("'a' as key", "id % 1500 as o", "id").repartition(3)
    got = merkle._numbered(rows, "key", ["o", "id"]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["idx"])] == [x for i in range(1500) for x in (i, i + 1500)]
    assert {r["n"] for r in got} == {3000} and sorted(r["idx"] for r in got) == list(range(3000))


def test_odd_rows(spark, odd, none, tmp_path):
    for df, name in ((odd, "odd"), (none, "none")):
        (tmp_path / name).mkdir()
        whole = df.withColumn("n_chars", F.length("text").cast("long"))
        whole.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        got = rows_of(op13_merkle_manifest(spark, f"file://{tmp_path}/{name}"))
        assert got == sorted(by_hand([r.asDict() for r in whole.collect()]), key=str)
    assert "op13_merkle_manifest" in ORACLE_SQL
