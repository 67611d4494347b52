"""The stages of the corpus pipeline, each from documents to documents; all but the last keep the columns, whatever their names.

Inside a stage the columns are c0, c1, ... and get their names back at its end, so no name can clash with a result's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, packing, pii, quality, rules
from .common import discard, fold, settle, small

#: A text without one common word is 0.330 from the nearest reference; no labelled clean text of sf0.1 is beyond 0.259.
MAX_WORD_JS = 0.28


def _plain(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns numbered, and the new names of the given ones."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), [f"c{docs.columns.index(x)}" for x in names]


def good_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents that the quality classifier, fitted on their labelled ones, scores `least` or more.

    Null and empty texts are scored as empty; repeated rows share a fate; without labels all documents score 0.5.
    """
    model = quality.train(docs.select("doc_id", "text"), labels, fold("doc_id", 5) != 0)
    rows, (text,) = _plain(docs, "text")
    scored = quality.score(rows, model, rows.columns, text)
    return scored.where(F.col("score") >= least).select(*rows.columns).toDF(*docs.columns)


def within_rules(docs: DataFrame, max_word_js: float = MAX_WORD_JS) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail for their length; repeated rows share a fate."""
    rows, (text,) = _plain(docs, "text")
    # written first: a filter over the measures would be pushed below them, with all of their expressions copied into it
    judged = settle(rules.rules(rows, text, max_word_js=max_word_js).select(*rows.columns, "_kept"))
    return judged.where("_kept").select(*rows.columns).toDF(*docs.columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, null as the largest, and of rows that share it the first by text.

    A row in no group stays, whether or not it has an id of its own; so does each null or empty text.
    """
    plain, (id_, text) = _plain(docs, "doc_id", "text")
    rows, ids = plain.agg(F.count("*"), F.count_distinct(id_)).first()
    if rows == ids:
        found = settle(jaccard.near_duplicates(plain, id_, text).where(f"n_shingles > 0 AND component_id <> {id_}").select(id_))
        # those that go are fewer than those that stay
        return plain.join(small(found), id_, "left_anti").select(*plain.columns).toDF(*docs.columns)
    # ids that are null or repeated do not tell rows apart: numbers of the written rows do
    numbered = settle(plain.withColumn("row", F.monotonically_increasing_id()))
    found = jaccard.near_duplicates(numbered, "row", text)
    order = F.struct(F.col(id_).isNull(), id_, text, "row")
    first = numbered.join(found.where("n_shingles > 0"), "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    kept = settle(first.union(found.where("n_shingles = 0").select("row")))
    discard(found)
    return numbered.join(small(kept), "row", "left_semi").select(*plain.columns).toDF(*docs.columns)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars follows the text, where there is one."""
    rows, (text,) = _plain(docs, "text")
    out = pii.redact(rows, text)
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n, F.length(text).cast(rows.schema[n].dataType))
    return out.toDF(*docs.columns)


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 tokens; a null text is the end id alone."""
    return packing.pack(docs, tokenizer, capacity=2048, end_id=0)
