"""The registered query of each operator, over its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_polytope, decontaminate, html_crf, kd_shards, line_dedup, minhash, mixing, quality, token_store, toxicity
from .shared import table


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_store(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary``: the path of a tokenizer file; by default the installed byte-level one of 50k ids."""
    return token_store.round_trip(table(spark, sf_dir, "documents"), vocabulary or token_store.public_vocabulary(), end=0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_line_drops").alias("n_removed"), "text")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.shard(table(spark, sf_dir, "documents"), leaves=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.main_text(table(spark, sf_dir, "pages"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_quality_compression, op2_token_store, op3_decontamination, op4_line_dedup, op5_minhash_dedup, op6_source_mixing,
    op7_kd_sharding, op8_html_crf, op9_cross_polytope, op10_toxicity,
)}
ORACLES = {"op5_minhash_dedup": minhash.ORACLE, "op6_source_mixing": mixing.ORACLE, "op9_cross_polytope": cross_polytope.ORACLE}
