"""From retrieved rows to the context of an answer: projections, budgets on JSON text, references and the joined text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .ranking import budget_prefix, top_by, weighted_polling


def as_json(*columns: str) -> Column:
    """A compact JSON object of the columns, nulls left out."""
    return F.to_json(F.struct(*columns))


def within_tokens(df: DataFrame, by: list[str], order: list[Column], line: Column, budget: int) -> DataFrame:
    """Rows in order while the JSON lines fit the budget (a character a token), with `line`."""
    return budget_prefix(df.withColumn("line", line), by, order, F.length("line"), budget).drop("running")


def chunk_budget(total: Column, system: Column, graph: Column, question: Column, reserve: int = 200) -> Column:
    """What the chunks may take: the rest of the total, 0 at least."""
    return F.greatest(total - system - graph - question - reserve, F.lit(0))


def references(chunks: DataFrame, by: list[str], path: str, place: str) -> DataFrame:
    """(by, path, n, reference_id): paths by how many chunks have them, then by their first place; the unknown source has no id."""
    g = chunks.where(F.coalesce(path, F.lit("")) != "").groupBy(*by, path).agg(F.count("*").alias("n"), F.min(place).alias("_first"))
    known = F.col(path) != "unknown_source"
    w = Window.partitionBy(*by, known).orderBy(F.desc("n"), "_first")
    return g.select(*by, path, "n", F.when(known, F.row_number().over(w).cast("string")).otherwise("").alias("reference_id"))


def joined(lines: DataFrame, by: list[str], order: str, name: str = "context") -> DataFrame:
    """(by, name): the column `line` of rows that a budget has bounded, in order, a line each."""
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias(name))


def similar_chunks(owned: DataFrame, by: list[str], owner: str, place: str, question: Column, vector: Column, most: int, least: int = 1) -> DataFrame:
    """The chunks nearest to the question, half of `most` for each owner; where a vector is missing, weighted polling instead.

    owned has a row for each chunk, its owner numbered from 0 without gaps and its place from 1; the result has `picked`,
    'similar' or 'polled'.
    """
    w = Window.partitionBy(*by)
    df = owned.withColumn("_s", cosine(question, vector)).withColumn("_n", F.max(owner).over(w) + 1).withColumn("_all", F.count("_s").over(w) == F.count("*").over(w))
    ranked = top_by(df.where("_all"), by, [F.desc(F.round("_s", 6)), F.col(owner), F.col(place)], 1 << 30, "_r").where(F.col("_r") <= F.floor(F.lit(most) * F.col("_n") / 2))
    polled = weighted_polling(df.where("NOT _all"), by, owner, place, most, least).drop("round")
    keep = owned.columns
    return ranked.select(*keep, F.lit("similar").alias("picked")).union(polled.select(*keep, F.lit("polled")))


def lexical(question: pd.Series, text: pd.Series) -> pd.Series:
    """The rerank hook's default: the share of the question's words that the text has."""
    words = lambda s: set(str(s).lower().split())
    return pd.Series([len(words(q) & words(t)) / max(1, len(words(q))) for q, t in zip(question, text, strict=True)])


def reranked(df: DataFrame, question: str, text: str, score: Callable[[pd.Series, pd.Series], pd.Series] | None = lexical) -> DataFrame:
    """df with rerank_score, a batch at a time; without a model it is null, so that the order stays."""
    if score is None:
        return df.withColumn("rerank_score", F.lit(None).cast("double"))
    run = F.pandas_udf(lambda q, t: score(q, t), "double")
    return df.withColumn("rerank_score", run(F.col(question), F.col(text)))


def trace(source: Column, frequency: Column, place: Column) -> Column:
    """Where a chunk comes from: E, R or C, how often it was found, and its place there."""
    return F.concat(source, frequency.cast("string"), F.lit("/"), place.cast("string"))
