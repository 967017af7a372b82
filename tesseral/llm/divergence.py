"""How the words of each source differ from those of the others of its language, and from the language's.

A source's counts of the kept terms are cut into shards of terms; sums over terms are sums over shards, so no vector is longer than a shard.
Sources stand in teams. Teams stay where they are, in a persisted table dealt out by shard and team; in each round of a round-robin
tournament half of the teams send compressed copies of their vectors to the team they meet, and a meeting gives the values of all
pairs of sources for both directions at once. A team that stays ranks its sources' terms in heaps of its own.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.llm.common import fresh_path, stored, text_or_empty

#: A term is a run of ASCII letters and of anything beyond ASCII: in UTF-8, of bytes that this table does not make blanks.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are cut into terms at once; distinct terms, and bytes of text, of which a task counts before it hands counts on.
CHUNK, TERMS_HELD, BYTES_HELD = 1 << 20, 200_000, 64 << 20
#: Terms of a shard; sources of a team; teams of a language, if it has so many sources.
SHARD_TERMS, TEAM, TEAMS = 8_192, 64, 8


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """A UTF-8 text's terms in lists, each of about CHUNK bytes of text."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Counts:
    """Terms' occurrences and documents, by language and source."""

    def __init__(self) -> None:
        self.by: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        seen, documents = self.by.setdefault((lang, source), (Counter(), Counter()))
        before, own = len(seen), set()
        for words in terms_of(text):
            seen.update(words)
            own.update(words)
        documents.update(own)
        self.held += len(seen) - before
        self.bytes += len(text)

    def full(self) -> bool:
        return self.held > TERMS_HELD or self.bytes > BYTES_HELD

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row a term, and one of the empty term, without counts, for each language and source."""
        for (lang, source), (seen, documents) in self.by.items():
            seen[b""] = documents[b""] = 0
            terms = list(seen)
            step = 20_000
            for i in range(0, len(terms), step):
                part = terms[i : i + step]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()),
                        pa.array([seen[t] for t in part], pa.int64()),
                        pa.array([documents[t] for t in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "documents"],
                )
        self.__init__()


def count_terms(docs: DataFrame) -> DataFrame:
    """Rows lang, source, term, n, documents: how often and in how many documents of its language and source a term is found.
    Each language and source also has a row of the empty term, with zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts.add(lang, source, text.as_py())
                if counts.full():
                    yield from counts.batches()
        yield from counts.batches()

    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().cast("binary").alias("text"))
    found = rows.mapInArrow(count, "lang string, source string, term binary, n long, documents long")
    found = found.withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 5) / (total + 5 * terms)), by long division, so that no product leaves 64 bits below totals of 9 * 10 ** 15."""
    whole = total + 5 * terms
    rest, out = counts.astype(np.int64) + 5, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return out + 1


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts by place, compressed."""
    return zlib.compress(counts.astype(np.int64).tobytes() + np.diff(places, prepend=0).astype(np.int32).tobytes(), 1)


def unpack(packed: bytes | None, size: int) -> np.ndarray:
    """Counts at all `size` places; none are packed if there is nothing."""
    out = np.zeros(size, np.int64)
    if packed:
        raw = zlib.decompress(packed)
        n = len(raw) // 12
        out[np.cumsum(np.frombuffer(raw, np.int32, n, 8 * n))] = np.frombuffer(raw, np.int64, n)
    return out


def vectors(entries: DataFrame, top: int) -> DataFrame:
    """Rows lang, shard, source, vector, best: a source's counts in a shard, packed, and its `top` terms there above the language's share.

    entries: lang, shard, source, place, term, n, lang_n, total, lang_total, terms.
    """

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        one = {c: table.column(c)[0].as_py() for c in ("lang", "shard", "source", "total", "lang_total", "terms")}
        n = table.column("n").to_numpy()
        over = shares(n, one["total"], one["terms"]) - shares(table.column("lang_n").to_numpy(), one["lang_total"], one["terms"])
        names = table.column("term").to_pylist()
        best = heapq.nsmallest(top, ((-int(over[i]), names[i]) for i in np.flatnonzero(over > 0)))
        packed = pack(table.column("place").to_numpy(), n)
        kind = pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))
        return pa.table(
            [[one["lang"]], [one["shard"]], [one["source"]], pa.array([packed], pa.binary()), pa.array([[{"item": t, "value": -v} for v, t in best]], kind)],
            names=["lang", "shard", "source", "vector", "best"],
        )

    return entries.groupBy("lang", "shard", "source").applyInArrow(build, "lang string, shard long, source string, vector binary, best array<struct<item:string,value:long>>")


_PAIRS = "lang string, source string, item string, value long"


def _members(table: pa.Table) -> tuple[list[str], np.ndarray]:
    """The sources of a team and their shares of all terms of the shard, one row each."""
    rows = table.select(["source", "total", "terms", "size", "vector"]).to_pylist()
    return [r["source"] for r in rows], np.array([shares(unpack(r["vector"], r["size"]), r["total"], r["terms"]) for r in rows]).reshape(len(rows), -1)


def _told(lang: str, found: list[tuple[str, str, int]]) -> pa.Table:
    """Both directions of pairs of sources."""
    both = [x for a, b, v in found for x in ((lang, a, b, v), (lang, b, a, v))]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array([x[i] for x in both], k) for i, k in enumerate(kinds)], names=["lang", "source", "item", "value"])


def _at_home(table: pa.Table) -> pa.Table:
    """The pairs within a team."""
    names, p = _members(table)
    found = [(names[i], names[j], int(v)) for i in range(len(names)) for j, v in enumerate(np.abs(p[i + 1 :] - p[i]).sum(axis=1), i + 1)]
    return _told(table.column("lang")[0].as_py(), found)


def _meeting(residents: pa.Table, guests: pa.Table) -> pa.Table:
    """The pairs of a team and its guests."""
    if not residents.num_rows or not guests.num_rows:
        return _told("", [])
    own, p = _members(residents)
    other, q = _members(guests)
    found = [(own[i], other[j], int(v)) for i in range(len(own)) for j, v in enumerate(np.abs(q - p[i]).sum(axis=1))]
    return _told(residents.column("lang")[0].as_py(), found)


def opponent(team: Column, teams: Column, turn: int) -> Column:
    """Whom a team meets in a round of the tournament of `teams` teams, an even number; null once all have met.

    All but the last team stand on a circle; in round r teams whose numbers sum up to r meet, and the one left over meets the last.
    """
    around = teams - 1
    other = F.pmod(F.lit(turn) - team, around)
    last = F.pmod(F.lit(turn) * (teams / 2).cast("long"), around)
    met = F.when(team == around, last).when(other == team, around).otherwise(other)
    return F.when(F.lit(turn) < around, met)


def tournament(residents: DataFrame) -> DataFrame:
    """Rows lang, source, item, value: the sum of differences of two sources' shares over the terms of each shard, for every two sources of a language.

    residents: lang, shard, team, teams, source, total, terms, size, vector; each source in each shard of its language.
    """
    teams, cells = residents.select("lang", "shard", "team", "teams").distinct().agg(F.coalesce(F.max("teams"), F.lit(0)), F.count("*")).first()
    spark, key = residents.sparkSession, ["lang", "shard", "team"]
    parts = max(1, min(cells, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    at_home = residents.repartition(parts, *key).persist()
    path = fresh_path(spark, "meetings")
    at_home.groupBy(*key).applyInArrow(_at_home, _PAIRS).write.parquet(f"{path}/round=0")
    for turn in range(teams - 1):
        there = at_home.withColumn("_to", opponent(F.col("team"), F.col("teams"), turn))
        guests = there.where("team > _to").withColumn("team", F.col("_to"))
        met = there.where("team < _to").groupBy(*key).cogroup(guests.groupBy(*key)).applyInArrow(_meeting, _PAIRS)
        met.write.parquet(f"{path}/round={turn + 1}")
    at_home.unpersist()
    return spark.read.schema(_PAIRS).parquet(path)


def audit_sources(docs: DataFrame, *, least_documents: int = 30, top: int = 50) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part `pair`: item is another source of the language, value the summed differences of both sources' shares over all kept terms, all
    ranks. Part `term`: item is a kept term that the source has and of which its share is above the language's, value by how much, ranks up
    to `top`. Kept are the terms in `least_documents` documents of the language; shares are smoothed by 5 and in whole billionths.

    docs: text, lang, source; others are not read, so names don't clash. Nulls are empty texts and names. Repeated rows are documents of their own.
    Very long texts are counted whole, piece by piece. Groups without terms count nothing, and their shares are those of no
    occurrences. A language without kept terms has pairs of value 0. Ties go to the item that comes first in UTF-8. No documents give no rows.
    The sources of a language are numbered in one window, a short row each; everything larger is dealt out by term shard.
    """
    counts = stored(count_terms(docs), "counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("_d")).where(F.col("_d") >= least_documents).drop("_d"), "kept")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = counts.join(kept.select("lang", "term"), ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    groups = groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") / SHARD_TERMS)).cast("long"))
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("_at", F.row_number().over(by_lang.orderBy("source")) - 1).withColumn("_of", F.count("*").over(by_lang))
    a_team = F.least(F.lit(TEAM), F.ceil(F.col("_of") / TEAMS))
    groups = groups.withColumn("team", F.floor(F.col("_at") / a_team)).withColumn("_teams", F.ceil(F.col("_of") / a_team))
    groups = stored(groups.withColumn("teams", F.col("_teams") + F.col("_teams") % 2).drop("_at", "_of", "_teams"), "groups")

    # Terms have their shard, and their place in it, from the language's list of kept terms.
    shards = groups.select("lang", "shards").distinct()
    placed = kept.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).drop("shards")
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1)
    placed = stored(placed, "places")
    entries = counts.drop("documents").join(placed, ["lang", "term"]).join(groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    made = stored(vectors(entries, top), "vectors")

    sizes = placed.groupBy("lang", "shard").agg(F.count("*").alias("size"))
    places = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards", "lang_total")
    residents = places.join(sizes, ["lang", "shard"], "left").fillna(0, ["size"]).join(made.drop("best"), ["lang", "shard", "source"], "left")
    pairs = tournament(stored(residents, "residents")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = made.select("lang", "source", F.inline("best"))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked = both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
