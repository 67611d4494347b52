"""The retrieval modes as joins over the property graph, for any number of queries at once.

Everything is keyed by query_id and carries its place (pos, from 1), so that merging, budgets and quotas follow the
order in which things were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import adjacency
from .ranking import budget_prefix, round_robin, weighted_polling


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def seed_entities(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, name, pos): hits (query_id, name, rank) whose node exists, in the order of the hits."""
    return numbered(hits.join(nodes, "name", "left_semi"), ["query_id"], [F.col("rank")]).select("query_id", "name", "pos")


def entity_relations(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, src, tgt, pos): the edges at the seeds, each once, by the degrees of both ends, then by weight."""
    adj = adjacency(edges)
    at = seeds.select("query_id", F.col("name").alias("node"))
    near = adj.join(at, "node").select("query_id", F.least("node", "other").alias("src"), F.greatest("node", "other").alias("tgt")).distinct()
    ends = near.select(F.col("src").alias("node")).union(near.select("tgt")).distinct()
    # degrees of the ends alone, not of the whole graph
    deg = adj.join(ends, "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree"))
    ranked = near.join(edges, ["src", "tgt"]).join(deg.toDF("src", "ds"), "src").join(deg.toDF("tgt", "dt"), "tgt")
    order = [F.desc(F.col("ds") + F.col("dt")), F.desc(F.coalesce("weight", F.lit(1.0))), F.col("src"), F.col("tgt")]
    return numbered(ranked, ["query_id"], order).select("query_id", "src", "tgt", "pos")


def relation_entities(relations: DataFrame) -> DataFrame:
    """(query_id, name, pos): the ends of the relations, source before target, where they are seen first."""
    ends = relations.select("query_id", "pos", F.posexplode(F.array("src", "tgt")).alias("_side", "name"))
    first = ends.groupBy("query_id", "name").agg(F.min(F.struct("pos", "_side")).alias("_at"))
    return numbered(first, ["query_id"], [F.col("_at")]).select("query_id", "name", "pos")


def merged(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """Lists (query_id, *key, pos) merged by turns, each key once."""
    every = [df.select("query_id", *key, F.col("pos").alias("_place"), F.lit(i).alias("_source")) for i, df in enumerate(lists)]
    both = every[0]
    for df in every[1:]:
        both = both.unionByName(df)
    turns = round_robin(both.withColumn("_key", F.struct(*key)), ["query_id"], "_place", "_source", "_key")
    return turns.select("query_id", *key, F.col("pos").cast("long").alias("pos"))


def related_chunks(owners: DataFrame, lineage: DataFrame, most: int = 5, least: int = 1) -> DataFrame:
    """(query_id, chunk, n, round): chunks of owners (query_id, name, pos) by lineage (name, chunk).

    The first owner keeps a chunk; n is how many owners have it. Owners that keep none drop out before quotas are dealt.
    """
    held = owners.join(lineage.select("name", "chunk").distinct(), "name").groupBy("query_id", "chunk").agg(F.count("*").alias("n"), F.min("pos").alias("_own"))
    w = Window.partitionBy("query_id")
    held = held.withColumn("owner", F.dense_rank().over(w.orderBy("_own")) - 1)
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "owner").orderBy(F.desc("n"), "chunk")))
    return weighted_polling(held, ["query_id"], "owner", "place", most, least).select("query_id", "chunk", "n", "round")


def final_chunks(scored: DataFrame, by: list[str], order: list[Column], score: Column, floor: float, k: int, size: Column, budget: int) -> DataFrame:
    """Rows with a score of at least the floor (1 where it is missing; a floor of 0 lets all pass), the k first in order
    that fit the token budget, with ids DC1, DC2, ..."""
    kept = scored.where(F.coalesce(score, F.lit(1.0)) >= floor) if floor > 0 else scored
    top = numbered(kept, by, order).where(F.col("pos") <= k)
    return budget_prefix(top, by, [F.col("pos")], size, budget).withColumn("dc", F.concat(F.lit("DC"), F.col("pos").cast("string"))).drop("running")


def capped_bfs(levels: DataFrame, degrees: DataFrame, cap: int) -> DataFrame:
    """(node, depth, is_truncated): breadth-first levels (node, depth) cut to `cap` nodes, within a level by degree.

    The cut is by a global order, so it is taken by TakeOrdered and not by a window without a partition.
    """
    all_nodes = levels.join(degrees, "node", "left").withColumn("_d", F.coalesce("degree", F.lit(0)))
    top = all_nodes.orderBy("depth", F.desc("_d"), "node").limit(cap)
    total = levels.agg((F.count("*") > cap).alias("is_truncated"))
    return top.select("node", "depth").join(F.broadcast(total), F.lit(True))
