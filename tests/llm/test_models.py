import zlib
from collections import Counter

import numpy as np

from tesseral.llm import quality, toxicity
from tesseral.llm.queries import op9_quality_classifier, op10_toxicity

SF = "/root/testdata/sf0.1"


def test_labellers_are_weighed():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    k = len(quality.LABELLERS)
    right_good, right_bad = np.full(k, 0.97), np.linspace(0.2, 0.8, k)
    votes = np.where(good[:, None], np.where(rng.random((len(good), k)) < right_good, 1, 2), np.where(rng.random((len(good), k)) < right_bad, 2, 1))
    votes[rng.random(votes.shape) < 0.1] = 0
    patterns = votes @ 3 ** np.arange(k)
    model = quality.fit_labellers(Counter(patterns.tolist()))
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(model.bad - right_bad).max() < 0.05 and np.abs(model.good - right_good).max() < 0.02
    assert ((model.posterior(patterns) >= 0.5) == good).mean() > 0.95


def test_junk_is_seen():
    prose = "The mayor of the town said on Monday that it would open a new library for all of its readers, which is near the old bridge. "
    reads = {name: quality.read_text(text).votes for name, text in {"prose": prose * 2, "shout": "BUY!! NOW!! CHEAP!! " * 10, "marks": "the&&& of%%% and### is*** " * 10, "runs": "Word " * 40}.items()}
    assert 2 not in reads["prose"]
    assert all(2 in v for k, v in reads.items() if k != "prose")
    assert not quality.read_text("").votes.any()


def test_quality_query_on_labels(spark):
    got = {r["doc_id"]: r for r in op9_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.05
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_odd_rows(odd, none):
    out = quality.classify_quality(odd, sample=5)
    assert out.columns == [*odd.columns, "quality", "posterior", "kept"]
    got = out.collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert not any(by[i]["kept"] or by[i]["quality"] for i in (3, 4, 5, 6))
    assert len({r["quality"] for r in got if r["doc_id"] in (8, 9)}) == 1
    assert quality.classify_quality(none).count() == 0


def test_toxicity_query_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in op10_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert len(got) == len(docs)
    for (doc,) in docs:
        assert got[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert 0 <= got[doc]["score"] <= 1 and got[doc]["predicted"] == int(got[doc]["score"] >= 0.5)
    labels = [(r["toxic"], got[r["doc_id"]]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    ones = np.array([x["score"] for t, x in labels if t == 1])
    zeros = np.array([x["score"] for t, x in labels if t == 0])
    auc = ((ones[:, None] > zeros).mean() + 0.5 * (ones[:, None] == zeros).mean())
    assert auc > 0.98
    assert (ones >= 0.5).mean() > 0.85 and (zeros >= 0.5).mean() < 0.03


def test_toxicity_does_not_read_held_out_rows(spark):
    rows = [(i, f"plain words number {i} in a text" + (" vile" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = (toxicity.train_toxicity(docs, x, sample=1000) for x in (labels, flipped))
    assert np.array_equal(a.embeddings, b.embeddings) and a.thresholds == b.thresholds
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, a).collect()}
    assert got == {i: int(i % 4 == 0) for i, _ in rows}


def test_toxicity_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[3] == by[4] == by[5] and by[8] == by[9]
    empty = toxicity.train_toxicity(none, labels.limit(0))
    assert toxicity.score_toxicity(odd, empty).count() == odd.count()
    assert toxicity.score_toxicity(none, model).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark):
    ids = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 5 > 1]
    rare = {i: f"rare{k // 3}" for k, i in enumerate(ids[::97][:60])}
    docs = spark.createDataFrame([(i, f"plain text {rare.get(i, '')}") for i in ids] + [(ids[0], f"plain text {rare[ids[0]]}")], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "0 as toxic")
    buckets = set(toxicity.train_toxicity(docs, labels).buckets.tolist())
    assert {toxicity._bucket(w) for w in rare.values()} <= buckets
    assert toxicity.training_rows(docs, labels, "toxic").count() == len(ids)


def test_lots_change_the_network_by_their_mean():
    start = toxicity.begin(np.array([3, 5, 9]), np.array([4.0, -1.0, 0.5]))
    moved = []
    for words, label in (([3, 5, 7], 1), ([5, 9], 0)):
        own = toxicity.Learner(start, 2.0)
        own.step(start.index(np.array(words)), label)
        moved.append((own, own.moved()))
    (a, rows), _ = moved
    once = toxicity.begin(start.buckets, np.array([4.0, -1.0, 0.5]))
    once.add(rows.column(0).to_numpy(), np.stack([c.to_numpy() for c in rows.columns[2:]], axis=1) / rows.column(1).to_numpy()[:, None] / toxicity.UNIT)
    assert np.allclose(once.embeddings, a.embeddings, atol=1e-8) and np.allclose(once.out, a.out, atol=1e-8) and abs(once.out_bias - a.out_bias) < 1e-8
    assert all(np.allclose(once.filters[k], a.filters[k], atol=1e-8) for k in toxicity.WIDTHS) and not once.embeddings[0].any()


def test_logits_of_parts_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(4)
    model = toxicity.begin(np.arange(50), rng.normal(0, 3, 50))
    tables = model.tables()
    for n in (0, 1, 2, 3, 7, 8, 9, 200):
        rows = toxicity.pad(rng.integers(0, 51, n))
        x, pooled = model.embeddings[rows], []
        for k in toxicity.WIDTHS:
            pooled.append(np.max([sum(x[i + j] @ model.filters[k][j] for j in range(k)) for i in range(len(x) - k + 1)], axis=0))
        want = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.out_bias
        for most in (1, 5, 1 << 15):
            monkeypatch.setattr(toxicity, "LOOKED_UP", most)
            assert abs(model.logit(rows, tables) - want) < 1e-9


def test_languages():
    from tesseral.llm.words import language_row, plain

    texts = {"en": "The house of the man and it is that", "de": "Der Mann und die Frau mit dem Kind", "fr": "Le chat est dans les rues et pour", "es": "El perro y los gatos con una para", "other": "Zyx wvu"}
    for language, text in texts.items():
        assert toxicity.language_of(np.array([language_row(plain(w)) for w in text.split()]).sum(axis=0)) == language


def test_sample_limits_pass_over_what_does_not_fit(spark):
    from pyspark.sql import functions as F

    from tesseral.llm.common import bounded

    rows = spark.createDataFrame([(i, n) for i, n in enumerate([700, 90, 1, 2, 80, 3, 60])], "rank long, size int")
    kept = lambda most: sorted(r["size"] for r in bounded(rows, F.col("size"), most).collect())
    assert kept(100) == [1, 2, 90] and kept(10_000) == [1, 2, 3, 60, 80, 90, 700]
    assert kept(640) == [1, 2, 3, 60, 80, 90] and kept(0) == [] and kept(2) == [1]


def test_quality_without_a_sample_goes_by_the_labellers(spark):
    prose = "The mayor of the town said on Monday that it would open a new library for all of its readers, which is near the old bridge. "
    docs = spark.createDataFrame([(i, prose * 2 if i % 2 else "BUY!! NOW!! CHEAP!! " * 10) for i in range(60)] + [(99, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.classify_quality(docs, sample_bytes=10).collect()}
    assert all(got[i]["kept"] == bool(i % 2) for i in range(60)) and got[99]["quality"] == 0
    assert all(got[i]["quality"] == got[i]["posterior"] for i in range(60))
