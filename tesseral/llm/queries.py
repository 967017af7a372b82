"""Queries that apply each operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import divergence, language, lines, media, merkle, minhash, mixing, packing, quality, secrets, sharding, topk, toxicity
from tesseral.llm.common import small_batches
from tesseral.llm.sql import OP12, OP13


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), 24, is_stored=True)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return sharded.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_targets(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.media_table(_table(spark, sf_dir, "documents"))
    payload = F.col("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    only_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(text(only_base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "lines_in", "lines_dropped")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_classes(_table(spark, sf_dir, "documents")).drop("copy")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents")).select("doc_id", "posterior", "quality", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (toxicity.fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train_language(docs)
    told = language.predict_language(docs, model)
    return told.select("doc_id", (language.fold("doc_id") == language.HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in fields]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tested = F.when(even, merkle.leaf(changed)).otherwise(merkle.leaf([F.col(f) for f in fields]))
    made = merkle.manifest(docs, fields, group="source", order="doc_id", carry={"tested": tested})
    made = made.withColumn("_folded", merkle.folded(F.col("tested"), F.col("path")))
    digests = [merkle.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return made.select("doc_id", *digests, proof, merkle.hex_text(F.col("_folded")).alias("folded_root"), (F.col("_folded") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_order_minhash, op3_media_columns, op4_secret_scan, op5_line_dedup, op6_exact_top_k, op7_two_pass_shuffle, op8_entropy_mixing, op9_quality_classifier, op10_toxicity, op11_language_id, op12_source_divergence, op13_merkle_manifest)}

_OP5 = """
with cut as (
  select doc_id, source, text, string_split(text, chr(10)) as parts from documents
), pages as (
  select source, count(*) as total from documents group by source
), seen as (
  select d, source, line, any_value(1) from (
    select row_number() over () as d, source, parts from cut where text is not null
  ), unnest(list_transform(parts, lambda x: trim(x, ' '))) as u(line)
  where line <> '' group by d, source, line
), bad as (
  select s.source, list(s.line) as bad_lines from (
    select source, line, count(*) as pages from seen group by source, line having count(*) >= 5
  ) s join pages p on s.source is not distinct from p.source
  where s.pages > 0.02 * p.total group by s.source
)
select c.doc_id, c.source,
  case when text is null then null
       when bad_lines is null then text
       else array_to_string(list_filter(parts, lambda x: trim(x, ' ') = '' or not list_contains(bad_lines, trim(x, ' '))), chr(10)) end as text,
  case when text is null then 0 else len(parts) end::bigint as lines_in,
  case when text is null or bad_lines is null then 0
       else len(list_filter(parts, lambda x: trim(x, ' ') <> '' and list_contains(bad_lines, trim(x, ' ')))) end::bigint as lines_dropped
from cut c left join bad b on c.source is not distinct from b.source
"""

_OP6 = """
with q as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.v::double[], b.v::double[])::bigint as score
  from q a join q b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": _OP5, "op6_exact_top_k": _OP6, "op12_source_divergence": OP12, "op13_merkle_manifest": OP13}
