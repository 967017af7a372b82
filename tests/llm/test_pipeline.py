from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_minhash import classes_by_hand
from tests.llm.test_packing import pieces_of, whole
from tests.llm.test_sharding_mixing import targets_by_hand


def test_stages_against_brute_force(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    from tesseral.llm.common import stored
    from tesseral.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, keep), (_, lines), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    raw = {r["doc_id"]: r["text"] for r in documents}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}

    kept = stored(keep(spark, docs, sf_dir), "t")
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert all(i in ids for i, q in labels.items() if q == 1) and sum(i in ids for i, q in labels.items() if q == 0) <= 1

    cleaned = stored(lines(spark, kept, sf_dir), "t")
    rows = cleaned.collect()
    assert cleaned.columns == docs.columns and {r["doc_id"] for r in rows} == ids
    pages, on = Counter(r["source"] for r in kept.collect()), Counter()
    for r in kept.collect():
        on.update({(r["source"], x.strip(" ")) for x in r["text"].split("\n") if x.strip(" ")})
    for r in rows:
        want = [x for x in raw[r["doc_id"]].split("\n") if not (x.strip(" ") and on[r["source"], x.strip(" ")] >= 5 and on[r["source"], x.strip(" ")] > 0.02 * pages[r["source"]])]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])

    one = stored(near(spark, cleaned, sf_dir), "t")
    assert one.columns == docs.columns
    classes = classes_by_hand({r["doc_id"]: r["text"] for r in rows})
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(classes.values()))

    mixed = stored(mix(spark, one, sf_dir), "t")
    assert mixed.columns == docs.columns
    taken, sizes = defaultdict(int), defaultdict(int)
    for r in one.collect():
        sizes[r["source"]] += len(r["text"].split(" "))
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split(" "))
    for source, target in targets_by_hand(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(5, 0.05 * target)
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) == 2

    packed = pack(spark, mixed, sf_dir).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter(p for r in mixed.collect() for p in pieces_of(r["doc_id"], r["text"], tokenizer, 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    whole(packed, 2048)


def test_run_is_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns, and no rows at all."""
    from tests.llm.conftest import ROWS

    rows = [(i, text, "en" if k % 2 else None, source, None if k % 3 else 7, "x", k, True) for k, (i, text, source) in enumerate(ROWS)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, copies int, kept boolean")
    for docs in (odd, odd.limit(0)):
        own = Counter((r["doc_id"], r["size"]) for r in docs.collect())
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            got = Counter((r["doc_id"], r["size"]) for r in out.collect())
            assert set(got) <= set(own), name
            assert name != "line dedup" or got == own
            assert name != "mixing" or all(n <= 2 * own[x] for x, n in got.items())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
