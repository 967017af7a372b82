"""Brute force for the audit of sources."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def by_hand(rows, least=30, top=50):
    seen, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((r["text"] or "", r["lang"] or "", r["source"] or "") for r in rows):
        terms = TERM.findall(text.translate(LOWER))
        seen[lang, source].update(terms)
        df[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        total = Counter()
        for s in sources:
            total.update({t: seen[lang, s][t] for t in kept})

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(seen[lang, s]) for s in sources}, share(total)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if seen[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def made(rows):
    return [dict(text=t, lang=a, source=s) for t, a, s in rows]


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_TERMS", 7)
    monkeypatch.setattr(divergence, "TEAMS", 3)


def test_equals_brute_force(spark, small_shards):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        lang = ("en", "de", None)[i % 3]
        words = [f"W{'abcdefghij'[w % 10]}é{'klmnop'[w % 6]}" for w in rng.zipf(1.4, 30) % 40]
        rows.append((" ".join(words) + ("" if i % 7 else "\x00tail_end 3rd"), lang, f"s{rng.integers(0, 11) ** 2 % 13}"))
    rows += [("", "fr", "only"), (None, "fr", "other"), ("x", "nl", "lone")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for least, top in ((30, 50), (5, 3)):
        assert rows_of(divergence.audit_sources(docs, least_documents=least, top=top)) == by_hand(made(rows), least, top)


def test_every_pair_meets_once():
    for teams in (2, 4, 6, 8, 10):
        around, met = teams - 1, Counter()
        for turn in range(around):
            for team in range(teams):
                other = (turn - team) % around
                opponent = turn * (teams // 2) % around if team == around else around if other == team else other
                met[frozenset((team, opponent))] += 1
        assert len(met) == teams * (teams - 1) // 2 and set(met.values()) == {2}


def test_opponents_as_columns(spark):
    for teams in (2, 4, 8):
        frame = spark.range(teams).withColumn("teams", F.lit(teams).cast("long"))
        for turn in range(teams):
            got = {r["id"]: r["o"] for r in frame.select("id", divergence.opponent(F.col("id"), F.col("teams"), turn).alias("o")).collect()}
            if turn == teams - 1:
                assert set(got.values()) == {None}
            else:
                assert all(got[got[i]] == i != got[i] for i in range(teams))


def test_shares_do_not_overflow():
    counts, total, terms = [0, 1, 7 * 10**14, 10**15], 3 * 10**15, 1000
    assert divergence.shares(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


def test_vectors_keep_their_counts():
    places, counts = np.array([0, 3, 4, 90]), np.array([5, 1, 2**40, 7])
    got = divergence.unpack(divergence.pack(places, counts), 100)
    assert got[places].tolist() == counts.tolist() and got.sum() == counts.sum()
    assert divergence.unpack(None, 3).tolist() == [0, 0, 0] and divergence.unpack(divergence.pack(places[:0], counts[:0]), 0).tolist() == []


def test_long_texts_are_cut_at_blanks():
    text = ("Añb " * 400_000 + "z" * 1_500_000 + " end").encode()
    assert sum((Counter(x) for x in divergence.terms_of(text)), Counter()) == Counter({"añb".encode(): 400_000, b"z" * 1_500_000: 1, b"end": 1})


def test_odd_rows(odd, none):
    rows = [r.asDict() for r in odd.collect()]
    assert rows_of(divergence.audit_sources(odd, least_documents=2)) == by_hand(rows, 2)
    assert divergence.audit_sources(none).collect() == []
