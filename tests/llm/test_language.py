import re
import zlib

import numpy as np

from tesseral.llm import language
from tesseral.llm.queries import op11_language_id

SF = "/root/testdata/sf0.1"


def features_by_hand(text):
    """How many pieces of one to five letters the words of a text have, ends counted as letters."""
    words = re.findall(r"[a-zéñüß]+", text.lower())
    return sum(sum(max(0, len(w) + 2 - k + 1) for k in range(2, 6)) + len(w) for w in words) if words else 0


def test_features_of_words():
    for text in ("", "12 34!", "a", "ab cd", "Hello, wörld", "naïve" * 3):
        if "ï" not in text and "ö" not in text:
            # A piece may reach over one end only: with ends shared by neighbours none is lost.
            assert len(language.subwords(text)) == features_by_hand(text)
    assert np.array_equal(language.subwords("Ab, cd"), language.subwords("ab  CD!"))
    assert not np.array_equal(np.sort(language.subwords("ab cd")), np.sort(language.subwords("abcd")))


def test_pieces_lose_no_feature():
    text = ("the quick brown fox über Straße 12, " * 3000).strip()
    whole = np.bincount(language.subwords(text), minlength=1 << language.HASH_BITS)
    assert len(list(language.chunks_of(text))) > 2
    assert np.array_equal(language.counts_of(text), whole)


def test_query_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in op11_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(docs)
    right, short = [], []
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == d["lang"])
            if len(d["text"].split()) < 12:
                short.append(right[-1])
    assert np.mean(right) > 0.995 and np.mean(short) > 0.95


def test_held_out_rows_are_not_read(spark):
    rows = [(i, ("der mann und die frau" if i % 2 else "the man and the woman") + f" {chr(97 + i % 26)}{chr(97 + i % 7)}", "de" if i % 2 else "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz zz' else text end as text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end as lang")
    a, b = (language.train_language(d, sample=400) for d in (docs, other))
    assert a.languages == b.languages == ["de", "en"]
    assert np.array_equal(a.embeddings, b.embeddings) and a.threshold == b.threshold
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs, a).collect()} == {i: x for i, _, x in rows}


def test_rejection_is_calibrated():
    rng = np.random.default_rng(3)
    model = language.LanguageModel(["a", "b"], np.zeros((1 << language.HASH_BITS, language.SIZE), np.float32), np.zeros((language.SIZE, 2), np.float32), np.zeros(2, np.float32))
    model.embeddings[:1000, 0] = rng.normal(0, 2, 1000)
    model.out[0] = [1, -1]
    rows = [(np.array([i], np.int32), np.ones(1, np.float32), int(rng.random() > 1 / (1 + np.exp(-2 * model.embeddings[i, 0])))) for i in range(1000)]
    language.calibrate(model, rows, 0.95)
    assert 0.8 < model.temperature < 1.25
    assert model.checked["right_of_taken"] >= 0.95 > model.checked["right"] and 0 < model.checked["rejected"] < 0.9


def test_large_rows_are_skipped_and_not_the_rest(spark):
    words = [f"{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(26) for b in range(26) for c in range(26)]
    rows = [(i, " ".join(words) if i % 3 == 0 else "un petit chat noir" if i % 2 else "a small black cat", "fr" if i % 2 else "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_language(docs, sample=300, parts=0, sample_bytes=100_000)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs, model).collect()}
    assert all(got[i] == x for i, _, x in rows if i % 3)


def test_odd_rows(spark, odd, none):
    model = language.train_language(odd, sample=100)
    got = language.predict_language(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (3, 4, 5, 6):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] == "x" and r["score"] == 1.0
    empty = language.train_language(none)
    assert empty.languages == []
    assert {r["lang_pred"] for r in language.predict_language(odd, empty).collect()} == {"und"}
    assert language.predict_language(none, model).count() == 0
