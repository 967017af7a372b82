"""Line dedup by site-relative frequency: a line on too large a share of a site's pages is boilerplate.

Lines are told apart by two 64-bit hashes of the trimmed line, so counting moves 24 bytes a line and no text.
How many lines of one site can pass the ratio is bounded: pages hold L lines on average, so at
most L / ratio lines are on more than that share of them. The lines to drop are
therefore kept as one small array a site, and texts are filtered where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.llm.common import salt, stored

#: Beyond so many dropped lines in all, sites' arrays are joined by a shuffle instead of a broadcast.
BROADCAST_LINES = 500_000


def _key(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(11), trimmed).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, ratio: float, min_pages: int, *, host: str = "source", text: str = "text") -> DataFrame:
    """Rows host, line (its key), pages, total: lines on more than `ratio` of their host's pages and on at least `min_pages`."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _key))
    total = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("total"))
    seen = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.explode(keys).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    joined = counts.join(total.withColumnRenamed("host", "of"), F.equal_null("host", "of")).drop("of")
    return joined.where(F.col("pages") > F.lit(ratio) * F.col("total"))


def drop_boilerplate(docs: DataFrame, *, ratio: float = 0.02, min_pages: int = 5, host: str = "source", text: str = "text") -> DataFrame:
    """docs with the boilerplate lines gone from their texts, and lines_in, lines_dropped.

    A page is a row of docs, its lines are split at newlines and compared without spaces at their ends; a line
    counts once a page. Lines of spaces alone are never dropped. Lines that stay are joined by newlines as they were.
    Null texts stay null with 0 lines; a null host is a host of its own. Repeated rows are
    pages of their own. Other columns are kept; columns named lines_in and lines_dropped are replaced.
    """
    docs = docs.drop("lines_in", "lines_dropped")
    found = stored(boilerplate_lines(docs, ratio, min_pages, host=host, text=text).select("host", "line"), "boilerplate")
    sites = found.groupBy("host").agg(F.collect_list("line").alias("_bad")).withColumnRenamed("host", "_host")
    if found.count() <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(sites), F.equal_null(F.col(host), F.col("_host")), "left")
    else:
        parts = 64  # a site with most pages is dealt over so many tasks
        spread = sites.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = docs.withColumn("_deal", salt(parts, text))
        joined = dealt.join(spread, F.equal_null(F.col(host), F.col("_host")) & (F.col("_deal") == F.col("_part")), "left").drop("_deal", "_part")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_bad"), _key(x)) | (F.trim(x) == ""))
    kept = F.when(F.col("_bad").isNull(), lines).otherwise(kept)
    joined = joined.withColumn("_kept", kept)
    n_in, n_kept = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("_kept"), F.lit(0))
    n_in, n_kept = (F.when(F.col(text).isNull(), 0).otherwise(x) for x in (n_in, n_kept))
    cleaned = F.when(n_in == n_kept, F.col(text)).otherwise(F.array_join("_kept", "\n"))
    out = [cleaned.alias(text) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*out, n_in.cast("long").alias("lines_in"), (n_in - n_kept).cast("long").alias("lines_dropped"))
