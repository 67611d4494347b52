"""The queries of the ten operators and of the pipeline, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jaccard, licenses, lm, omh, packing, pii, quality, rules
from .common import fold, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = omh.edited(table(spark, sf_dir, "documents"))
    return e.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        omh.as_text(F.col("fingerprint")).alias("fingerprint"),
        omh.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        omh.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        omh.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_quality_classifier, op3_pii, op4_license_scan, op5_main_text, op6_quality_rules, op7_packing, op8_fingerprints, op9_ngram_jaccard, op10_byte_bpe, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": rules.sql()}
