"""A Merkle manifest of a table: leaves of rows, a tree for each group of rows, and a tree over the groups.

Digests are sha256. A node is the digest of its children's digests, written as lowercase hexadecimal text one after the other; every
`fanout` consecutive nodes of a level have a parent, and so have the fewer ones, even a single one, at a level's end, until one is left.

Levels are tables: nodes have an index, index div fanout is their parent's, and a group of at most `fanout` children is
sorted and hashed into it. The way back from the roots joins each level with the one above it and puts a node's siblings before
those of its parent; a level has a third of the rows of the one below, so all joins together move little more than the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.llm.common import pieces_of, stored

#: A part of a stored level holds about so many nodes.
NODES_PER_PART = 100_000
_PATH = "array<struct<left:binary,right:binary>>"


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(parts: Sequence[Column]) -> Column:
    """The digest, as binary, of texts or bytes one after the other."""
    return F.unhex(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256))


def field(value: Column) -> Column:
    """A value as bytes that no other value has: `-` for null, else its length in bytes, a colon and its UTF-8 text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest, as binary, of a row's fields in this order."""
    return digest_of([field(f) for f in fields])


def folded(node: Column, path: Column) -> Column:
    """The root that a node's digest and its siblings, level by level, lead to; binary."""
    up = lambda at, s: F.unhex(F.sha2(F.concat(hex_text(s["left"]), hex_text(at), hex_text(s["right"])), 256))
    return F.aggregate(path, node, up)


def proof_digest(path: Column) -> Column:
    """The digest, as hexadecimal text, of all siblings of a path, upwards and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hex_text(s["left"]), hex_text(s["right"]))), ""), 256)


def _numbered(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows with idx, their place from 0 among those of their key in this order, and n, how many the key has.

    Rows are dealt to ranges of (key, order), so that a key with very many rows lies in many of them; a row's place is its place in the range plus
    the rows of the key in earlier ranges. The ranges are kept in a stored table, as they need not come out alike when made again.
    """
    ranged = stored(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_rows"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("_rows").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(key, "_range", before.alias("_before"), F.sum("_rows").over(of_key).alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    placed = ranged.withColumn("_place", place).join(sizes, [key, "_range"])
    return placed.withColumn("idx", (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_range", "_before", "_place")


def _runs(nodes: DataFrame, fanout: int, more: Sequence[str] = ()) -> DataFrame:
    """Rows key, run, n, members (sorted, with the columns `more`), digest: each `fanout` consecutive nodes and their parent's digest."""
    member = F.struct("idx", "digest", *more)
    runs = nodes.groupBy("key", F.expr(f"idx div {fanout}").alias("run")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))
    text = F.array_join(F.transform("members", lambda m: hex_text(m["digest"])), "")
    return runs.withColumn("digest", F.unhex(F.sha2(text, 256)))


def _digests(members: Column) -> Column:
    """The digests of members, one after the other."""
    return F.unhex(F.array_join(F.transform(members, lambda m: hex_text(m["digest"])), ""))


class _Trees:
    """The trees over nodes with key, idx, n, digest, one for each key; `more` names columns that leaves carry."""

    def __init__(self, leaves: DataFrame, fanout: int, more: Sequence[str] = ()):
        self.fanout, self.more = fanout, list(more)
        self.leaves = stored(leaves.select("key", "idx", "n", "digest", *more), "leaves")
        self.levels: list[DataFrame] = []
        #: Rows key, level, digest: the root of each tree and the level it stands on.
        self.roots = self.leaves.where("n = 1").select("key", F.lit(0).alias("level"), "digest")
        nodes = self.leaves
        most, total = self.leaves.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
        while most > 1:
            total = total // fanout + 1 if total else 0
            most = -(-most // fanout)
            level = len(self.levels)
            runs = _runs(nodes.where("n > 1"), fanout, self.more if level == 0 else ())
            self.levels.append(stored(runs.coalesce(pieces_of(total, NODES_PER_PART)) if total < NODES_PER_PART else runs, "level"))
            nodes = self.levels[-1].select("key", F.col("run").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), "digest")
            self.roots = self.roots.unionByName(nodes.where("n = 1").select("key", F.lit(level + 1).alias("level"), "digest"))

    def paths(self, starts: DataFrame) -> DataFrame:
        """Rows key, subroot, path, digest and the carried columns, one for each leaf.

        starts: key, path; what a tree's paths go on with beyond its root.
        """
        roots = self.roots.join(starts, "key").select("key", "level", F.col("digest").alias("subroot"), "path")
        at = None
        for level in reversed(range(len(self.levels) + 1)):
            above, at = at, roots.where(F.col("level") == level).select("key", F.lit(0).cast("long").alias("idx"), "subroot", "path")
            if level == 0:
                alone = self.leaves.where("n = 1")
                at = at.join(alone.select("key", "digest", *self.more), "key").select("key", "subroot", "path", "digest", *self.more)
            if above is None:
                continue
            runs = self.levels[level].select("key", F.col("run").alias("idx"), "members").join(above, ["key", "idx"])
            each = runs.select("key", "subroot", "path", "members", F.posexplode("members").alias("p", "m"))
            each = each.withColumns({"_l": F.expr("slice(members, 1, p)"), "_r": F.expr("slice(members, p + 2, size(members))")})
            step = F.struct(_digests(F.col("_l")).alias("left"), _digests(F.col("_r")).alias("right"))
            path = F.concat(F.array(step), F.col("path")).cast(_PATH).alias("path")
            if level == 0:
                at = at.unionByName(each.select("key", "subroot", path, "m.digest", *[F.col("m." + c) for c in self.more]))
            else:
                at = at.unionByName(each.select("key", "m.idx", "subroot", path))
        return at


def manifest(docs: DataFrame, fields: Sequence[str], *, group: str, order: str, fanout: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """Rows `order`, leaf, subroot, root (binary), path and the columns of `carry`, one for each row of docs.

    Leaves are digests of `fields`; those of a group (a string column) ascend by `order`, null first, then by digest; groups' roots ascend by UTF-8
    bytes, the null group first. path holds, upwards, the siblings to the left and to the right of the way from leaf to root, digests
    one after the other; folded() follows it. `carry` is computed on docs in the pass that hashes them.

    A null field is told from any text, an empty text has length 0, very long texts are hashed whole. Repeated rows are leaves of their
    own with equal digests, next to each other. A lone leaf is its group's root, a lone group's root is the root. No documents
    give no rows. No other columns are read, so clashing names don't matter.
    """
    carry = dict(carry or {})
    # The null group sorts first and is told from the empty name.
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    own = {f"_c{i}": c for i, c in enumerate(carry.values())}
    rows = docs.select(key.alias("key"), F.col(order).alias("_order"), leaf([F.col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in own.items()])
    more = ["_order", *own]
    trees = _Trees(_numbered(stored(rows, "hashed"), "key", ["_order", "digest"]), fanout, more)
    subroots = trees.roots.select(F.lit("").alias("key"), F.col("key").alias("_group"), "digest")
    top = _Trees(_numbered(subroots, "key", ["_group"]), fanout, ["_group"])
    root = top.roots.select("digest").first()
    none = top.roots.select("key", F.array().cast(_PATH).alias("path"))
    starts = stored(top.paths(none).select(F.col("_group").alias("key"), "path"), "paths")
    out = trees.paths(starts)
    of_all = F.lit(bytes(root["digest"]) if root else None).cast("binary")
    return out.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", of_all.alias("root"), "path", *[F.col(n).alias(name) for n, name in zip(own, carry, strict=True)])
