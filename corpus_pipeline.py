"""Corpus cleaning in stages; each works on all rows that the one before it kept, and all but the last return documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, mixing, ngram_join, passages, quality
from lattica.llm.queries import ranks, table
from lattica.llm.tables import BROADCAST_ROWS, folder, release_executors


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their rows and columns; all of them if nothing can be learned."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, and of rows with that id and one text one. Rows without
    an id stay, as do rows of one id with other texts."""
    groups = ngram_join.ngram_components(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    out = without(docs, gone)
    twice = groups.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.limit(1).count():
        return out
    again = docs.join(with_size(twice), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return without(out, twice).unionByName(again)


def with_size(ids: DataFrame) -> DataFrame:
    """ids, broadcast in a join if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows of ids (doc_id)."""
    return docs.join(with_size(ids), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of passages that repeat; those of which nothing is left go, also if they were repeated rows."""
    return passages.without_repeats(docs, passages.repeated_passages(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of nine tenths of the tokens, in which large leaves weigh less than in proportion; no document occurs twice.
    Rows of leaves without any token go; null languages and sources are leaves of their own."""
    levels = (mixing.domain_of(F.col("source")), "lang", "source")
    return mixing.mix(docs, share=0.9, epochs=1, alpha=0.7, levels=levels, add=())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each document, and hashes of its ids and of what they decode to; a row for each row."""
    return bpe.token_digests(docs, ranks())


def released(stage: Callable) -> Callable:
    """stage, before which executors give back what the one before it left."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("quality", released(quality_filter)), ("near_copies", released(near_copies)), ("passages", released(repeated_passages)), ("mixing", released(mixed_sources)), ("tokens", released(tokens))]
#: Several stages cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
