import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesseral.llm import packing
from tesseral.llm.queries import tokenizer_path, op1_best_fit_packing


def whole(rows, capacity):
    """Checks that sequences are filled gaplessly and not beyond capacity; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def pieces_of(doc_id, text, tokenizer, capacity):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    for k, a in enumerate(range(0, len(ids), capacity)):
        part = ids[a : a + capacity]
        yield doc_id, k, a, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))


def first_fit_decreasing(counts, capacity):
    gaps = []
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        for i, g in enumerate(gaps):
            if g >= x:
                gaps[i] -= x
                break
        else:
            gaps.append(capacity - x)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_places_each_piece_once(counts):
    runs = packing.plan_packing(counts, 30)
    used, full = Counter(), Counter()
    ranks = defaultdict(list)
    for r in runs:
        used[r.length] += r.n
        ranks[r.length] += range(r.first_rank, r.first_rank + r.n)
        for s in range(r.first_sequence, r.first_sequence + r.n):
            full[s] += r.length
    assert used == Counter(counts)
    assert all(sorted(v) == list(range(counts[k])) for k, v in ranks.items())
    assert all(v <= 30 for v in full.values())
    assert len(full) <= first_fit_decreasing(counts, 30) + 1


def test_exact_complements():
    runs = packing.plan_packing({5: 3, 3: 3, 2: 3}, 10)
    assert max(r.first_sequence + r.n for r in runs) == 3
    runs = packing.plan_packing({7: 1, 1: 3, 4: 5}, 10)  # 7+1+1+1, 4+4, 4+4, 4
    assert max(r.first_sequence + r.n for r in runs) == 4


def test_many_lengths_reach_the_bound():
    rnd = random.Random(3)
    counts = Counter(min(2048, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(50_000))
    runs = packing.plan_packing(dict(counts), 2048)
    n = max(r.first_sequence + r.n for r in runs)
    assert n <= 1.002 * -(-sum(k * v for k, v in counts.items()) // 2048)
    assert len(runs) < 20 * 2048


def test_word_encoder_is_the_tokenizer(documents):
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(tokenizer_path()), packing.WordEncoder(tokenizer_path(), most=500)
    texts = [r["text"] for r in documents[:80]] + ["", "a\x1cb c<|endoftext|>d  <|startoftext|>", "Ａé é 'S it's ΣΑΣ", "x\r\ny\tz\x0b\x0c w", "İ ǅ 👩‍👩‍👧 12", "it's we'LL İx ½² naïve-É ß<|endoftext|>", "\xa0a\xadb\u2003c ǆ"]
    texts += ["".join(random.Random(i).choices("aB'stT éÉßΣ1½.,\n\t\x1c<|>\u0301中ا", k=60)) for i in range(300)]
    for text in texts:
        assert fast(text) == b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids)


def test_words_are_remembered():
    from itertools import product

    encode, made = packing.word_encoder(tokenizer_path(), packing.WORDS), []
    once = encode.words.encode
    encode.words.encode = lambda word: made.append(word) or once(word)
    words = ["".join(x) for x in product("abcdefghij", repeat=5)][:60_000]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    first = [encode(x) for x in texts]
    assert [encode(x) for x in texts] == first and len(made) == len(words)


def test_other_tokenizers_see_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.WordEncoder(path)(" two  words") == b"".join(i.to_bytes(4, "little") for i in Tokenizer.from_file(path).encode(" two  words", add_special_tokens=False).ids)


def test_query_against_brute_force(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted(p for r in documents for p in pieces_of(r["doc_id"], r["text"], tokenizer, 2048))
    got = op1_best_fit_packing(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    n = whole(got, 2048)
    assert n <= 1.02 * -(-sum(p[3] for p in want) // 2048) + 1


@pytest.mark.parametrize("most", [0, 20 << 20])
def test_odd_rows(odd, monkeypatch, most):
    monkeypatch.setattr(packing, "BROADCAST_BYTES", most)
    got = packing.pack_documents(odd.repartition(3), tokenizer_path(), 64, with_ids=True).collect()
    whole(got, 64)
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter([1, 2, 3, 4, 5, 6, None, 7, 8, 8, 9, 10, 11])
    assert [(r["length"], bytes(r["ids"])) for r in got if r["doc_id"] == 3] == [(1, b"\0\0\0\0")]
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)


def test_no_rows(none):
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
