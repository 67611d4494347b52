"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import discard, settle, short_batches, table


def _in_short_batches(stage):
    """Stages differ in what they leave to the write of their result, so the session's batches stay short after a stage."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_short_batches
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.good_quality(docs, table(spark, sf_dir, "labels"))


@_in_short_batches
def check_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.within_rules(docs)


@_in_short_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each(docs)


@_in_short_batches
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_personal_data(docs)


@_in_short_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", classify), ("quality rules", check_rules), ("n-gram Jaccard join", drop_near_duplicates), ("personal data", redact), ("best-fit packing", pack)]

#: SQL cannot fit the classifier; tests/llm holds the stages after it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
