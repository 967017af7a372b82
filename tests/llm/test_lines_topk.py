from collections import Counter

import duckdb
import numpy as np
import pytest

from tesseral.llm import lines, topk
from tesseral.llm.queries import ORACLE_SQL, QUERIES


def oracle(name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.sql(ORACLE_SQL[name])
    return got.columns, Counter(got.fetchall())


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_exact_top_k"])
def test_query_is_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns, rows = oracle(name, sf_dir)
    assert got.columns == columns
    assert Counter(map(tuple, got.collect())) == rows


def test_site_relative(spark):
    rows = [(i, f"Menu\nown line {i}\n  Menu  \n\nshared by few" if i < 3 else f"Menu\nown {i}", "a") for i in range(10)]
    rows += [(100 + i, "Menu\nother", "b" if i else None) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["lines_in"], r["lines_dropped"]) for r in lines.drop_boilerplate(docs, ratio=0.5, min_pages=2).collect()}
    assert got[0] == ("own line 0\n\nshared by few", 5, 2)
    assert got[5] == ("own 5", 2, 1)
    assert got[100] == ("Menu\nother", 2, 0) == got[101]


@pytest.mark.parametrize("most", [0, 500_000])
def test_lines_odd_rows(odd, none, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST_LINES", most)
    out = lines.drop_boilerplate(odd, ratio=0.3, min_pages=2)
    assert out.columns == [*odd.columns, "lines_in", "lines_dropped"]
    got = out.collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert (by[3]["text"], by[3]["lines_in"], by[5]["text"], by[4]["text"]) == (None, 0, " \n\t ", "")
    assert by[1]["text"] == "It was a sunny day in the town."
    assert [r["text"] for r in got if r["doc_id"] == 8] == ["", ""]
    assert lines.drop_boilerplate(none).count() == 0


def brute(vectors, queries, k):
    out = []
    for qid, q in queries:
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), i) for i, v in vectors if i != qid and len(v) == len(q)))[:k]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return Counter(out)


@pytest.mark.parametrize(("scale", "shard_rows"), [(3, 40), (200, 1000), (1 << 29, 60)])
def test_top_k_against_brute_force(spark, scale, shard_rows):
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.normal(size=6) * scale).astype(int).tolist()) for i in range(300)] + [(700 + i, [1] * 6) for i in range(30)] + [(900, [5, 5]), (901, [7, 1])]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>").selectExpr("vec_id", "size(v) as dim", "v")
    queries = [x for x in vectors if x[0] % 50 == 0]
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=shard_rows, leaf=16)
    assert Counter(map(tuple, got.collect())) == brute(vectors, queries, 5)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.999, 0.0]), (5, [0.999, 0.0]), (None, [1.0, 1.0]), (50, [2.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk.quantized(df)
    assert Counter((r["vec_id"], tuple(r["v"])) for r in q.collect())[5, (255, 0)] == 2
    got = topk.top_k(q, q.where("vec_id % 50 = 0"), 5).collect()
    assert Counter(map(tuple, got)) == Counter([(0, 1, 5, 256 * 255), (0, 2, 5, 256 * 255)])
    assert topk.top_k(q.limit(0), q, 5).count() == 0


def test_repeated_queries_and_candidates(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-9, 9, 4).tolist()) for i in range(120)] + [(50, [9, 9, 9, 9])] * 6 + [(7, [8, 8, 8, 8])] * 3 + [(100, rng.integers(-9, 9, 4).tolist()) for _ in range(3)]
    df = spark.createDataFrame([(*x, "s", 1) for x in vectors], "vec_id long, v array<long>, shard string, rank int").selectExpr("*", "size(v) as dim")
    want = brute(vectors, [x for x in vectors if x[0] % 50 == 0], 5)
    for shard_rows in (30, 1000):
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=shard_rows, leaf=8)
        assert Counter(map(tuple, got.collect())) == want


def test_repeated_own_rows_take_no_places():
    points = np.array([[100.0]] * 4 + [[float(x)] for x in range(60)])
    ids = np.array([7] * 4 + list(range(100, 160)))
    tree = topk.KdTree(points, ids)
    query = np.array([1.0])
    got = tree.search(query, tree.bounds(query[None])[0], 7, 5, None)
    assert sorted(got, reverse=True) == [(x, 100 + x) for x in range(59, 54, -1)]
