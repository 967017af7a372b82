"""A training corpus from raw documents, in five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
in the shared folder and read again as the next one's docs. All stages but the last return the columns of
documents: doc_id, text, lang, source, n_chars, and any others that were there.

Every stage takes nulls in any column, empty, blank and very long texts, repeated rows and empty tables: a null text is an empty one, which the
quality classifier rejects, as it does blank ones; a null source is a source of its own; a null id is kept as it is. Repeated rows are pages and
documents of their own but for near-duplicates, of which one row stays. No documents give no rows in any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import lines, minhash, mixing, packing, quality
from tesseral.llm.common import small_batches, stored
from tesseral.llm.queries import tokenizer_path


def _apart(docs: DataFrame, names: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs) with the columns of docs, of which those named like columns that an operator adds keep their own values."""
    held = {c: f"_own_{c}" for c in docs.columns if c in names}
    return run(docs.withColumnsRenamed(held)).select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    small_batches(spark)
    return _apart(docs, ("quality", "posterior", "kept"), lambda own: quality.classify_quality(own).where("kept"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their sites; n_chars follows the text. No document goes."""
    n_chars = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _apart(docs, ("lines_in", "lines_dropped"), lambda own: lines.drop_boilerplate(own).withColumn("n_chars", n_chars))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    small_batches(spark)
    return minhash.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return _apart(docs, ("size", "source_size", "target", "copies"), lambda own: mixing.repeated(mixing.mix_to_targets(own)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each copy on its own, with their sequences and token ids."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(), 2048, with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier and a hashed search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
