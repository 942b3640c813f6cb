"""Registered queries of this subpackage: name to a function of (spark, sf_dir)."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, mixing, oracles
from lattica.llm.embedding_dedup import embedding_components
from lattica.llm.language_model import language_model_scores
from lattica.llm.licenses import license_scan
from lattica.llm.ngram_join import ngram_components
from lattica.llm.passages import repeated_passages
from lattica.llm.quality import quality_scores
from lattica.llm.toxicity import toxicity_scores
from lattica.llm.transport import media_features


LANGUAGES = {"en": 5, "de": 2, "fr": 2, "es": 1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


@lru_cache(1)
def ranks() -> bpe.Ranks:
    return bpe.Ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), ranks())


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens: domains alike, half English, a fifth German and French each, a tenth Spanish; two epochs at most."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", mixing.domain_of(F.col("source")))
    domains = [f"d{k}" for k in range(3)]
    weights = {(d,): 1 for d in domains} | {(d, lang): w for d in domains for lang, w in LANGUAGES.items()}
    return mixing.mix(docs, 0.5, weights, 2).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_substring_dedup, op3_byte_level_bpe, op4_source_mixing, op5_language_model, op6_media_columns, op7_license_scan, op8_toxicity, op9_ngram_jaccard_join, op10_quality_classifier)}
#: The other queries hash, compress or learn in ways that SQL has no functions for; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": oracles.EMBEDDINGS,
    "op4_source_mixing": oracles.mixing(LANGUAGES, 3, "1 // 2", 2, mixing.SEED),
    "op9_ngram_jaccard_join": oracles.SHINGLES,
}
