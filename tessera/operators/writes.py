"""Writes to the property graph and to lineage as joins over immutable tables: each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_by


def upsert_attributes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key: a new value that is not null replaces the old one, other attributes stay; both have one row a key."""
    others = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return both.select(*keys, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in others))


def create(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with those new rows whose key is free, the new rows that were refused)."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True), new.join(old.select(*keys), keys, "left_semi")


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes (node) and the edges at them."""
    left = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "tgt"), "tgt", "left_anti")
    return nodes.join(gone, "node", "left_anti"), left


def without_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges without the pairs (a, b), in whichever direction they are named."""
    named = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt"))
    return edges.join(named, ["src", "tgt"], "left_anti")


def merged_values(strategy: str, value: Column, order: Column, sep: str = "<SEP>") -> Column:
    """An aggregate: concatenate, keep_first, keep_last, join_unique, join_unique_comma (sorted) or max; nulls and empty texts don't count."""
    kept = F.when(value.cast("string") != "", value)
    if strategy == "max":
        return F.max(kept)
    if strategy in ("keep_first", "keep_last"):
        at = F.struct(order.alias("o"), kept.alias("v"))
        return (F.min if strategy == "keep_first" else F.max)(F.when(kept.isNotNull(), at))["v"]
    listed = F.transform(F.sort_array(F.collect_list(F.when(kept.isNotNull(), F.struct(order.alias("o"), kept.cast("string").alias("v"))))), lambda x: x["v"])
    parts = lambda mark: F.array_distinct(F.filter(F.transform(F.flatten(F.transform(listed, lambda x: F.split(x, mark))), lambda x: F.trim(x)), lambda x: x != ""))
    if strategy == "concatenate":
        return F.array_join(listed, sep)
    if strategy == "join_unique":
        return F.array_join(parts(sep), sep)
    if strategy == "join_unique_comma":
        return F.array_join(F.array_sort(parts(",")), ",")
    raise ValueError(f"unknown strategy: {strategy}")


def ordered_union(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def ordered_difference(a: Column, b: Column) -> Column:
    """The elements of a that b lacks, in order and as often as they are there."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def with_delta(held: Column, old: Column, new: Column) -> Column:
    """What is held, without what an update takes away, and with what it adds at the end."""
    gone = F.array_except(old, new)
    added = F.array_except(F.array_except(new, old), held)
    return F.concat(F.filter(held, lambda x: ~F.array_contains(gone, x)), added)


def capped(ids: Column, most: int, keep: str = "KEEP") -> Column:
    """At most so many ids: the first (KEEP) or the last (FIFO)."""
    return F.slice(ids, 1, most) if keep == "KEEP" else F.slice(ids, F.greatest(F.size(ids) - most, F.lit(0)) + 1, F.lit(most))


def purge(lineage: DataFrame, gone: DataFrame, key: str, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Of lineage (key, source) without the gone sources: (what is left, key and action of each key that lost some).

    A key without sources is to be deleted, another to be rebuilt from those that it still has.
    """
    left = lineage.join(gone.select(source), source, "left_anti")
    touched = lineage.join(gone.select(source), source, "left_semi").select(key).distinct()
    rest = left.join(touched, key, "left_semi").groupBy(key).agg(F.count("*").alias("rest"))
    return left, touched.join(rest, key, "left").select(key, F.when(F.col("rest").isNull(), "delete").otherwise("rebuild").alias("action"), F.coalesce("rest", F.lit(0)).alias("rest"))


def rebuilt(records: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """(key, kind, description) of keys to rebuild, from the cached records (key, kind, description, ord) of their remaining sources.

    The kind is the most frequent one (the first seen among equals); descriptions are distinct, in order. A key
    without any description gets one from its name.
    """
    own = records.join(touched.select(key), key, "left_semi")
    kinds = first_by(own.groupBy(key, "kind").agg(F.count("*").alias("n"), F.min("ord").alias("o")), [key], [F.desc("n"), F.col("o")]).select(key, "kind")
    texts = own.where("description <> ''").groupBy(key, "description").agg(F.min("ord").alias("o")).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "description"))), lambda x: x["description"]), "<SEP>").alias("description"))
    return kinds.join(texts, key, "left").withColumn("description", F.coalesce("description", F.concat(F.lit("Entity "), F.col(key))))
