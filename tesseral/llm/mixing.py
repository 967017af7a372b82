"""Mixing sources to target weights by entropy balancing.

Documents get rates r = min(limit, exp(t * z)), z being a document's size over its source's
mean size and t the source's multiplier: of all rates between 0 and the limit that meet the
source's token target, these lie nearest to 1 in Kullback-Leibler divergence. The multipliers maximise a
concave dual, which falls apart by sources: Newton's method, kept inside a shrinking bracket, finds them, all sources
side by side in one job. Everything but the last join works on the histogram (source, size) of the corpus, summed before it is
shuffled, so a source with a third of all rows is no larger a group than its distinct sizes.

The rates are then rounded into whole copies, size class by size class: within a class the
documents with the smallest hashes get the extra copy, and a few passes move single copies
until a source's sum can come no nearer to its target.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.llm.common import pieces_of, salt, stored

#: Words are runs of anything but a space or the characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """sizes (source, source_size) with each source's target.

    The sources, in code point order with null last, weigh `weights` in turn and divide
    share * sum(source_size). No target exceeds limit * source_size; what is above is shared
    again by weight among the rest. The fixed point of that is min(cap, level * weight), where
    the sources with the least cap / weight are those at their caps, found with running sums.

    One row a source; the window over them all is small as long as sources are named sites.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    rank = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    rows = rows.withColumn("full_at", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    rows = (
        rows.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("caps_before", F.sum("cap").over(by_level) - F.col("cap"))
        .withColumn("weights_from", F.sum("weight").over(whole) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("caps_before")) / F.col("weights_from"))
        # At the first source below its cap the level is right; sources behind it would give lower ones.
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def _named(**parts: Column) -> Column:
    return F.named_struct(*[x for name, value in parts.items() for x in (F.lit(name), value)])


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def balance(classes: Column, mean: Column, target: Column, limit: float, *, steps: int = 400, tolerance: float = 1e-9) -> Column:
    """The multiplier t of a source from its histogram, an array of (size, n): Newton steps over all its sizes until
    the expected words are the target but for `tolerance` of it.

    A source whose target is its cap, or which has no words, has no finite multiplier: its t is null. Each step either is
    Newton's or halves the bracket, which bounds how many are needed; fails if they did not suffice.
    """
    log_limit, far = math.log(limit), 1e12

    def sums(s: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            z = x["size"] / mean
            u = s["t"] * z
            free = u < log_limit
            rate = F.when(free, F.exp(F.least(u, F.lit(log_limit)))).otherwise(F.lit(float(limit)))
            return _with(x["n"] * z * rate, lambda words: _named(got=acc["got"] + words, slope=acc["slope"] + F.when(free, words * z).otherwise(0.0)))

        return F.aggregate(classes, _named(got=F.lit(0.0), slope=F.lit(0.0)), add)

    def moved(s: Column, m: Column) -> Column:
        miss = m["got"] - target / mean
        off = F.abs(miss) * mean / target
        low, high = F.when(miss < 0, s["t"]).otherwise(s["low"]), F.when(miss > 0, s["t"]).otherwise(s["high"])
        step = s["t"] - miss / F.nullif(m["slope"], F.lit(0.0))
        inside = F.coalesce((step > low) & (step < high), F.lit(False))
        halved = F.when(high >= far, F.greatest(s["t"] * 2, F.lit(1.0))).when(low <= -far, F.least(s["t"] * 2, F.lit(-1.0))).otherwise((low + high) / 2)
        t = F.when(off <= tolerance, s["t"]).when(inside, step).otherwise(halved)
        return _named(t=t, low=low, high=high, off=off)

    start = _named(t=F.lit(0.0), low=F.lit(-far), high=F.lit(far), off=F.lit(1.0))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s["off"] <= tolerance, s).otherwise(_with(sums(s), lambda m: moved(s, m))))
    open_ = (target > 0) & (target < mean * F.aggregate(classes, F.lit(0.0), lambda acc, x: acc + x["n"]) * float(limit))
    settled = _with(end, lambda s: F.when(s["off"] <= tolerance, s["t"]).otherwise(F.raise_error(F.lit("a source's multiplier did not settle")).cast("double")))
    return F.when(open_, settled)


def settled_copies(classes: Column, miss: Column, limit: int, *, passes: int = 2_000) -> Column:
    """How many copies of each of `classes`, an array of (size, n, taken), are taken in the end.

    Each pass moves copies of the one size that brings the source's sum nearest to its target, until none does; every
    pass brings it nearer. Fails if `passes` did not suffice.
    """

    def best(s: Column) -> Column:
        def move(x: Column, i: Column) -> Column:
            taken = F.get(s["taken"], i)
            room = F.when(s["miss"] > 0, limit * x["n"] - taken).otherwise(taken)
            k = F.least(room, F.floor(F.abs(s["miss"]) / x["size"] + 0.5)).cast("long")
            return _with(k, lambda k: _with(F.abs(F.abs(s["miss"]) - k * x["size"]), lambda left: F.when((k > 0) & (left < F.abs(s["miss"])), _named(left=left, size=x["size"], i=i, k=k))))

        return F.array_min(F.transform(classes, lambda x, i: F.when(x["size"] > 0, move(x, i))))

    def moved(s: Column, b: Column) -> Column:
        k = F.signum(s["miss"]).cast("long") * b["k"]
        taken = F.transform(s["taken"], lambda y, i: F.when(i == b["i"], y + k).otherwise(y))
        return F.when(b.isNull(), _named(taken=s["taken"], miss=s["miss"], over=F.lit(True))).otherwise(
            _named(taken=taken, miss=s["miss"] - k * b["size"], over=F.lit(False)))

    start = _named(taken=F.transform(classes, lambda x: x["taken"]), miss=miss, over=F.lit(False))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, lambda s, _: F.when(s["over"], s).otherwise(_with(best(s), lambda b: moved(s, b))))
    return _with(end, lambda s: F.when(s["over"], s["taken"]).otherwise(F.raise_error(F.lit("copies did not settle")).cast("array<bigint>")))


def plan_copies(hist: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """hist (source, size, n) and targets to rows source, size, copies, extra, source_size, target: each document of the
    class is taken `copies` times and `extra` of them once more.

    A source's histogram, which has no more rows than its longest text has words, meets in one row; sources are solved side by side.
    The fractions of the tilted rates are summed from the largest size down and rounded as a running sum; then whole copies are moved.
    """
    per = hist.groupBy("source").agg(F.collect_list(F.struct("size", "n")).alias("h"), F.sum("n").alias("docs")).hint("merge")
    per = targets.join(per.withColumnRenamed("source", "_of"), F.equal_null("source", "_of")).drop("_of")
    mean = F.col("source_size") / F.col("docs")
    # The multiplier goes into the array, so it is worked out once a source and not once a row.
    solved = _with(balance(F.col("h"), mean, F.col("target"), limit), lambda t: F.transform("h", lambda x: _named(size=x["size"], n=x["n"], t=t)))
    per = per.select("source", "source_size", "target", mean.alias("mean"), F.explode(solved).alias("c")).withColumn("t", F.col("c.t"))
    tilted = F.least(F.lit(float(limit)), F.exp(F.least(F.col("t") * F.col("c.size") / F.col("mean"), F.lit(math.log(limit)))))
    full = F.when(F.col("target") > 0, F.lit(float(limit))).otherwise(F.lit(0.0))
    rate = F.when(F.col("c.size") == 0, F.lit(1.0)).otherwise(F.coalesce(tilted, full))
    rates = per.select("source", "source_size", "target", "c.size", "c.n", rate.alias("rate"))

    part = F.col("n") * (F.col("rate") - F.floor("rate"))
    upto = F.sum(part).over(Window.partitionBy("source").orderBy(F.col("size").desc()))
    taken = F.col("n") * F.floor("rate") + F.least(F.col("n"), F.greatest(F.lit(0), F.floor(upto + 0.5) - F.floor(upto - part + 0.5)))
    rounded = rates.withColumn("taken", taken.cast("long"))
    got = rounded.groupBy("source", "source_size", "target").agg(F.collect_list(F.struct("size", "n", "taken")).alias("c"), F.sum(F.col("taken") * F.col("size")).alias("words"))
    final = got.withColumn("end", settled_copies(F.col("c"), F.col("target") - F.col("words"), limit))
    rows = final.select("source", "source_size", "target", F.explode(F.arrays_zip("c", "end")).alias("x"))
    return rows.select("source", F.col("x.c.size").alias("size"), F.expr("x.end div x.c.n").alias("copies"), (F.col("x.end") % F.col("x.c.n")).alias("extra"), "source_size", "target")


def mix_to_targets(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2, ranked_rows: int = 20_000) -> DataFrame:
    """docs with size, source_size, target (of its source) and copies: how often the mix takes the document.

    docs: doc_id, text, source and any others, all of which are kept; columns named like the four new
    ones are replaced. Null texts have size 0; null is a source of its own, the last. Documents
    of size 0 are taken once; very long ones are counted whole. Repeated rows are rows like any: which of a class get an extra copy is told by a hash of
    all columns (but maps), so only rows that are alike in all of them are interchangeable.
    No documents give no rows. Copies run from 0 to `limit` and are the same on each run.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    hashed = ["doc_id", "text", *[c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind]]
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = docs.withColumns({"_size": word_count("text"), "_tie": F.xxhash64(F.lit(3), *hashed), "_source": named})
    # What is counted and ranked before documents move: read from the texts once.
    narrow = stored(sized.select("source", "_source", "_size", "_tie"), "sizes")
    hist = stored(narrow.groupBy("source", F.col("_size").alias("size")).agg(F.count("*").alias("n")), "histogram")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    classes = stored(plan_copies(hist, capped_targets(sizes, weights, share, limit), limit), "classes")

    # Which of a class get the extra copy: the first by hash, ranked in parts as a class can be huge. The ranking and the
    # join with the classes have the same keys, without nulls, so documents cross the network once.
    keys = ["_source", "_size", "_part"]
    biggest = hist.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    part = salt(pieces_of(biggest, ranked_rows), "_tie")
    before = narrow.groupBy("_source", "_size", part.alias("_part")).agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("_source", "_size").orderBy("_part")) - F.col("_n"))
    classes = classes.select(named.alias("_source"), F.col("size").alias("_size"), "copies", "extra", "source_size", "target").hint("merge")
    before = before.join(classes, ["_source", "_size"]).drop("_n").hint("merge")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_tie", "doc_id")) - 1
    mixed = sized.withColumn("_part", part).withColumn("_place", place).join(before, keys)
    taken = (F.col("copies") + F.when(F.col("_before") + F.col("_place") < F.col("extra"), 1).otherwise(0)).cast("int")
    return mixed.select(*docs.columns, F.col("_size").alias("size"), "source_size", "target", taken.alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as its copies say."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_copy")
