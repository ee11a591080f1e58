"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendgrid.llm import (
    context_tree,
    grace_dedup,
    kd_sharding,
    mixing,
    near_dedup,
    packing,
    periodic_runs,
    personal_data,
    range_join,
    suffix_dedup,
    token_blocks,
    toxicity,
    whitening,
)

TOKENIZERS = "/opt/tokenizers"


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_blocks.write_tokens(_read(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json", end_id=2)
    return token_blocks.read_tokens(segments)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(_read(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir), f"{TOKENIZERS}/word_bpe_49k.json", end_id=2, capacity=4096)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_repeats(_read(spark, sf_dir), length=400)


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard(_read(spark, sf_dir), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.exact_groups(_read(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_read(spark, sf_dir), words=2, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    found = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")), threshold=0.7)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op9_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.vector_groups(_read(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    return personal_data.find(docs, personal_data.fit(docs))


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(_read(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened_components(_read(spark, sf_dir, "embeddings"), wanted=8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_read(spark, sf_dir), repeat=True).drop("runs")


QUERIES = {f.__name__: f for f in (op1_token_blocks, op2_source_mix, op3_packing, op4_suffix_dedup, op5_kd_sharding, op6_exact_dedup, op7_near_dedup, op8_toxicity, op9_range_join, op10_personal_data, op11_context_tree, op12_whitening, op13_periodic_runs)}

SQL = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
