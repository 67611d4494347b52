"""Vector and lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .ranking import top_by

#: Query vectors that are broadcast, at most; more go through in blocks.
BLOCK = 4096


def matches(queries: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(query_id, item_id, score) of all items with a cosine of at least the threshold.

    queries (query_id, q) are a stated set, held against all items (item_id, v); beyond BLOCK queries each block of them
    is broadcast on its own, so what is sent has a bound. Lengths are worked out once for each vector.
    """
    long = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    queries, items = queries.withColumn("_nq", long("q")), items.withColumn("_nv", long("v"))
    n = queries.count()
    out = None
    for b in range(max(1, -(-n // BLOCK))):
        block = queries if n <= BLOCK else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK))) == b)
        score = F.round(F.try_divide(dot(F.col("q"), F.col("v")), F.col("_nq") * F.col("_nv")), 6)
        found = items.join(F.broadcast(block), F.lit(True)).select("query_id", "item_id", score.alias("score")).where(F.col("score") >= threshold)
        out = found if out is None else out.union(found)
    return out


def top_k(queries: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, item_id, score, rank) of the k nearest items with a cosine of at least the threshold."""
    return top_by(matches(queries, items, threshold), ["query_id"], [F.desc("score"), F.col("item_id")], k)
