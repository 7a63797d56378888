"""A corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Defined results: documents with null or empty text, or without a letter, go in the first stage. Null ids are ids like any
other; rows that repeat the id but not the text are documents of their own; of rows that repeat id and text one stays (exact dedup). Of
equally good copies the least id stays, null ids last. Very long texts are read whole by every stage. All stages but the last keep the
columns that they are given, whatever their names; the last one returns doc_id, n_tokens, ids_sha256 and decoded_sha256. An empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join
from onomast.llm.common import others, read, unused, written
from onomast.llm.queries import language_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, or no letter) go."""
    clashing = [c for c in docs.columns if c not in others(docs.columns, "lang_pred", "score")]
    own = dict(zip(clashing, unused([*docs.columns, "lang_pred", "score"], *[f"{c}__own" for c in clashing]), strict=True))
    known = language_id.predict(docs.withColumnsRenamed(own), language_model(docs)).where("lang_pred <> 'und'")
    return known.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of texts that share their five-word shingles stays."""
    return ngram_join.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark's passages in a twentieth or more of their words go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's ids and of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), cache_bytes=TOKEN_CACHE)


#: Executors hold what earlier stages left behind, so the last stage remembers less.
TOKEN_CACHE = 34 << 20

STAGES = [("language id", language), ("exact dedup", exact), ("n-gram join", near), ("decontaminate", clean), ("bpe", tokens)]

#: Language models and BPE can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
