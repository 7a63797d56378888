"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import alignment, bpe, decontaminate, exact_dedup, hard_negatives, language_id, mixing, ngram_join, pii, quality, secrets, token_store, toxicity
from onomast.llm.common import read, remainder, scratch_dir


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.TokenStore(spark, scratch_dir(spark, "tokens"))
    store.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return store.documents()


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links", F.col("n").cast("bigint").alias("n_shingles"))


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from the documents whose id's remainder is not 1 (null ids teach nothing)."""
    return language_id.train(docs.where(remainder("doc_id", 3) != 1))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return language_id.predict(rows, language_model(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_entropy")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder("doc_id", 4) != 2)
    model = toxicity.train(docs, labels)
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return toxicity.predict(rows, model).select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        decontaminate.n_hit().alias("n_hit"),
        F.size("dc_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("dc_items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.predict(docs, *quality.train(docs)).select("doc_id", "weak_label", "score", "keep")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_context")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), label=label)


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_ngram_join": op2_ngram_join,
        "op3_language_id": op3_language_id,
        "op4_secrets": op4_secrets,
        "op5_toxicity": op5_toxicity,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality": op7_quality,
        "op8_pii": op8_pii,
        "op9_bpe": op9_bpe,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_mix": op12_mix,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    from onomast.llm import oracles

    return oracles.SQL
