import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesseral.llm import minhash
from tesseral.llm.queries import op2_order_minhash


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    rnd = random.Random(4)
    for _ in range(300):
        a = [rnd.randrange(6) for _ in range(rnd.randrange(1, 60))]
        b = list(a)
        for _ in range(rnd.randrange(6)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = [rnd.randrange(6)] * rnd.randrange(2)
        n = lcs(a, b)
        true = n / (len(a) + len(b) - n) if a or b else 1.0
        got = minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(true) if true >= 0.8 else got < 0.8


def test_sketches_keep_order_and_occurrences():
    kmers = lambda text: minhash.kmers(minhash.words_of(text))
    words = [f"w{i}" for i in range(300)]
    h = kmers(" ".join(words))
    moved = kmers(" ".join(words[150:] + words[:150]))  # almost the same 5-mers, another order
    near = kmers(" ".join(words[:100] + ["new"] + words[101:]))
    same = lambda x: int((minhash.sketches(h) == minhash.sketches(x)).sum())
    assert same(h) == minhash.SKETCHES
    assert same(near) > 40 > 28 > same(moved)
    assert len(set(minhash.labelled(kmers("a " * 50)).tolist())) == 46


def multiset(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def linked(a, b):
    """Equal words, or a common run of five words and an alignment of 0.8 or more."""
    x, y = a.lower().split(), b.lower().split()
    if x == y:
        return bool(x)
    both = sum((Counter(x) & Counter(y)).values())
    if both < 0.8 * (len(x) + len(y) - both) or not multiset(a) & multiset(b):
        return False
    n = lcs(x, y)
    return n / (len(x) + len(y) - n) >= 0.8


def classes_by_hand(texts):
    """Components of pairs of equal texts or linked ones."""
    ids = list(texts)
    bags = {i: multiset(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i in ids:
        for x in bags[i]:
            where[x].append(i)
    pairs = {(a, b) for group in where.values() for k, a in enumerate(group) for b in group[:k]}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i in ids:
        root[find(i)] = find(first.setdefault(texts[i], i))
    for a, b in pairs:
        if find(a) != find(b) and linked(texts[a], texts[b]):
            root[find(a)] = find(b)
    smallest = {}
    for i in ids:
        smallest[find(i)] = min(i, smallest.get(find(i), i))
    return {i: smallest[find(i)] for i in ids}


def test_query_against_brute_force(spark, sf_dir, documents):
    got = op2_order_minhash(spark, sf_dir).collect()
    want = classes_by_hand({r["doc_id"]: r["text"] or "" for r in documents})
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert len(got) == len(documents)
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(set(want.values()))


def near_copies(rnd, n, words, share):
    base = [f"b{rnd.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(int(words * share)):
            copy[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        yield " ".join(copy)


def test_groups_and_common_passages(spark):
    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = list(near_copies(rnd, 60, 200, 0.01))  # linked all over
    texts += list(near_copies(rnd, 25, 120, 0.055))  # near the threshold: chains
    texts += [passage + " " + " ".join(f"u{i}_{j}" for j in range(25)) for i in range(80)]  # alike by 60 of 85 words
    texts += [passage + " " + " ".join(f"v{j}" for j in range(25)) + f" x{i}" for i in range(6)]  # alike in truth
    texts += ["same words"] * 5
    rows = dict(enumerate(texts))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.duplicate_classes(docs).collect()}
    assert got == classes_by_hand(rows)
    kept = minhash.keep_one_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values()))


def test_labels_do_not_depend_on_other_repeats():
    once, twice = (set(minhash.labelled(minhash.kmers(minhash.words_of(t))).tolist()) for t in ("a b c d e f g a b c d", "a b c d e f g a b c d e"))
    assert once < twice


def test_marks_tell_similar_bags():
    agree = lambda x, y: int((np.unpackbits(minhash.marks(x)) == np.unpackbits(minhash.marks(y))).sum())
    needed = minhash.needed_marks(0.8)
    assert needed > 0.8 * minhash.MARKED
    rnd = np.random.default_rng(2)
    for common, each in ((24, 3), (400, 50)):  # similarity 0.8
        got = []
        for _ in range(300):
            w = rnd.integers(1, 1 << 63, common + 2 * each, np.uint64)
            got.append(agree(w[: common + each], np.delete(w, slice(common, common + each))))
        assert min(got) >= needed and abs(np.mean(got) - 0.9 * minhash.MARKED) < 8
    apart = [agree(rnd.integers(1, 1 << 63, 200, np.uint64), rnd.integers(1, 1 << 63, 200, np.uint64)) for _ in range(50)]
    assert max(apart) < needed - 80


@pytest.mark.parametrize("spread", [True, False])
def test_recall_of_edits(spark, spread):
    """Copies with 1 to 10 of 100 words substituted, evenly or anywhere, that align to 0.8 or more: nine in ten are found, and far more of few edits."""
    rnd = random.Random(21)
    texts, edits = [], []
    for k in range(1, 11):
        for _ in range(40):
            n = rnd.choice((60, 150, 400))
            base = [f"r{rnd.randrange(10**8)}" for _ in range(n)]
            places = [int((i + 0.5) * 100 / k) for i in range(n * k // 100)] if spread else rnd.sample(range(n), n * k // 100)
            copy = list(base)
            for i in places:
                copy[i] = f"e{rnd.randrange(10**8)}"
            texts += [" ".join(base), " ".join(copy)]
            edits.append(k)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.duplicate_classes(docs).collect()}
    assert all(got[2 * i] == 2 * i for i in range(len(edits)))
    true = [(k, got[2 * i + 1] == 2 * i) for i, k in enumerate(edits) if linked(texts[2 * i], texts[2 * i + 1])]
    assert np.mean([hit for k, hit in true]) > 0.95
    assert np.mean([hit for k, hit in true if k >= 9]) > (0.8 if spread else 0.9) and all(hit for k, hit in true if k <= 4)


def test_short_texts_meet(spark):
    rnd = random.Random(3)
    texts = []
    for n in [8, 9, 10, 11, 12, 13, 15, 20, 24, 27, 28, 29, 33, 34, 40]:
        for i in range(4):
            words = [f"s{n}_{i}_{rnd.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, "more"])]
            if n >= 14:
                texts += [" ".join([*words[:-2], "a", "b"]), " ".join(words[: -(n // 7)])]
    texts += [f"a common line of some eight words {i}" for i in range(50)]
    rows = dict(enumerate(texts))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.duplicate_classes(docs).collect()}
    assert got == classes_by_hand(rows)
    assert got[1] == 0 and got[9] == 8


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001 + i: 1000 for i in range(50)}


@pytest.mark.parametrize("most", [0, 500_000])
def test_odd_rows(odd, none, monkeypatch, most):
    monkeypatch.setattr(minhash, "BROADCAST_TEXTS", most)
    got = [(r["doc_id"], r["class_id"]) for r in minhash.duplicate_classes(odd).collect()]
    by = dict(got)
    assert len(got) == odd.count()
    assert by[3] == by[4] == by[6] == 3 and by[5] == 5 and by[None] is None and by[8] == by[9] == 8
    kept = minhash.keep_one_each(odd.withColumn("copy", odd["size"]))
    assert kept.columns == [*odd.columns, "copy"]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 5, None, 7, 8, 10, 11])
    assert minhash.duplicate_classes(none).count() == 0
    assert minhash.keep_one_each(none).count() == 0
