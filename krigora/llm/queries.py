"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, embedding_dedup, gam_quality, hard_negatives, hilbert, langid, line_dedup, mixing, packing, pii, quality_rules, simhash, vector_codes
from .common import fold, table


def op1_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs.where(fold("doc_id", 3) != 1)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(e.select("vec_id", moved.alias("label"), "embedding"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(table(spark, sf_dir, "documents"), byte_vocabulary())


def byte_vocabulary() -> tuple[str, str]:
    """Path of a public byte-level vocabulary and the pattern that parts texts for it."""
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies; workers have it at the same path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gam_quality": op1_gam_quality,
    "op2_quality_rules": op2_quality_rules,
    "op3_hilbert_sharding": op3_hilbert_sharding,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_source_mixing": op5_source_mixing,
    "op6_centroid_langid": op6_centroid_langid,
    "op7_line_dedup": op7_line_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_attention_lm": op13_attention_lm,
}

ORACLE_SQL: dict[str, str] = {"op5_source_mixing": mixing.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_vector_codes": vector_codes.ORACLE}
