import re
import zlib
from collections import Counter, defaultdict

import pytest

from tesseral.llm import mixing, sharding
from tesseral.llm.queries import op7_two_pass_shuffle, op8_entropy_mixing


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shuffle_query(spark, sf_dir, documents):
    got = op7_two_pass_shuffle(spark, sf_dir).collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in documents)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    check_shards(got, 24)
    again = op7_two_pass_shuffle(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


@pytest.mark.parametrize(("shards", "bucket_bytes"), [(3, 200), (5, 1 << 25), (40, 100)])
def test_shuffle_odd_rows(odd, shards, bucket_bytes):
    out = sharding.shuffle_into_shards(odd, shards, bucket_bytes=bucket_bytes)
    assert out.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    check_shards(got, shards)


def test_shuffle_deals_repeated_rows(spark):
    """One record makes up nearly all rows: it is dealt over all buckets, and the files of a shard follow its slots."""
    docs = spark.range(3000).selectExpr("cast(5 as long) as doc_id", "repeat('y', 40) as text").unionByName(spark.range(30).selectExpr("id as doc_id", "'z' as text"))
    out = sharding.shuffle_into_shards(docs, 4, bucket_bytes=10_000)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    check_shards(got, 4)


def test_shuffle_looks_random(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 20) as text")
    got = sharding.shuffle_into_shards(docs, 4, bucket_bytes=20_000).collect()
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    near = sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False))
    assert near < 20  # two of 4,000 are expected
    assert abs(sum(order[:2000]) / 2000 - 2000) < 120
    other = sharding.shuffle_into_shards(docs, 4, seed=5, bucket_bytes=20_000).collect()
    assert {r["doc_id"]: r["slot"] for r in got} != {r["doc_id"]: r["slot"] for r in other}


def test_shuffle_no_rows_and_files(none, odd, tmp_path, spark):
    assert sharding.shuffle_into_shards(none, 24).count() == 0
    out = sharding.shuffle_into_shards(odd, 3, seed=2)
    sharding.write_shards(out, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert Counter(r["shard"] for r in back.collect()) == Counter(r["shard"] for r in out.collect())


def targets_by_hand(sizes, share=1.5, weights=(5, 2, 1), limit=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, rest = share * sum(sizes.values()), {}, list(order)
    while rest:
        level = left / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > limit * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in rest}
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
        rest = [s for s in rest if s not in over]
    return out


def check_mix(rows, docs):
    words = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs]
    sizes = Counter()
    for _, source, n in words:
        sizes[source] += n
    want = targets_by_hand(dict(sizes))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, n) for d, _, n in words)
    source_of = {d: s for d, s, _ in words}
    taken = Counter()
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    return {s: (taken[s], want[s]) for s in sizes}


def test_mix_query(spark, sf_dir, documents):
    got = op8_entropy_mixing(spark, sf_dir).collect()
    for taken, target in check_mix(got, documents).values():
        assert abs(taken - target) <= max(3, 0.02 * target)
    again = op8_entropy_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_hot_source(spark):
    rows = [(i, "w " * (i % 37 + 1), "hot" if i % 3 else f"s{i % 11}") for i in range(3000)] + [(9000 + i, "same text of six words here", "hot") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_to_targets(docs, ranked_rows=100)
    got = mixed.selectExpr("doc_id", "size", "source_size", "target", "copies * size as taken").collect()
    for taken, target in check_mix(got, docs.collect()).values():
        assert abs(taken - target) <= 1


def test_mix_odd_rows(odd, none):
    out = mixing.mix_to_targets(odd)
    assert out.columns == [c for c in odd.columns if c != "size"] + ["size", "source_size", "target", "copies"]
    got = out.selectExpr("doc_id", "source", "size", "source_size", "target", "copies * size as taken").collect()
    check_mix([r for r in got], odd.collect())
    assert mixing.mix_to_targets(none).count() == 0
    assert mixing.repeated(out).count() == sum(r["copies"] for r in out.collect())


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, None: 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.capped_targets(df, (5, 2, 1), 1.5, 2).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))
