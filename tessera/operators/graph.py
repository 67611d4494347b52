"""Property-graph operators on an edge table (src, tgt, ...) with src < tgt."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("tgt").alias("other")).union(edges.select("tgt", "src"))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("node").agg(F.count("*").alias("degree"))


def edge_ranks(edges: DataFrame) -> DataFrame:
    """Edges with rank, the sum of the degrees of both ends."""
    d = degrees(edges)
    return edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("tgt"), F.col("degree").alias("dt")), "tgt").withColumn("rank", F.col("ds") + F.col("dt")).drop("ds", "dt")


def incident(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(src, tgt) of the edges at the seeds (node, ord), each once, at the first seed that it touches."""
    near = adjacency(edges).join(seeds, "node").select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("tgt"), "ord")
    return near.groupBy("src", "tgt").agg(F.min("ord").alias("ord"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(node, depth): breadth-first levels around the seeds (node), by frontier joins; each level is written, so lineage ends there.

    Edges are followed both ways, from source to target (out) or back (in); they and the levels are each written once.
    """
    ways = {"both": adjacency, "out": lambda e: e.select(F.col("src").alias("node"), F.col("tgt").alias("other")), "in": lambda e: e.select(F.col("tgt").alias("node"), F.col("src").alias("other"))}
    adj = written(ways[direction](edges))
    levels = [written(seeds.select("node").distinct())]
    for _ in range(depth):
        new = adj.join(levels[-1], "node").select(F.col("other").alias("node")).distinct()
        # of an undirected edge only the two levels before can hold the other end
        for old in levels[-2:] if direction == "both" else levels:
            new = new.join(old, "node", "left_anti")
        levels.append(written(new))
    return reduce(DataFrame.union, (df.withColumn("depth", F.lit(k)) for k, df in enumerate(levels)))


def written(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again; only a local session may lack that setting."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "tgt"), "tgt", "left_semi")


def merged_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after nodes (old) are merged into others (new): re-pointed, without self-loops, the largest weight of equals."""
    for side in ("src", "tgt"):
        m = mapping.select(F.col("old").alias(side), F.col("new").alias("_new"))
        edges = edges.join(m, side, "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
    return edges.where("src <> tgt").groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(F.max("weight").alias("weight"))


def majority(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Each group's most frequent value; among equals the one seen first."""
    c = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "seen", value)
    return c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(by, value, "n")
