"""Key-value and document-status operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_by


def multi_get(requests: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """requests (pos, key) with the store's columns, null where the key is missing; pos gives the order."""
    return requests.join(store, key, "left")


def missing_keys(requests: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return requests.join(store, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: Column) -> DataFrame:
    """Last write wins: the new rows over the old ones, among new rows of a key the latest version."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both, key, [F.desc("_new"), version.desc()]).drop("_new")


def status_counts(status: DataFrame, every: list[str], column: str = "status") -> DataFrame:
    """Counts of all statuses, 0 where there is none, and of all rows."""
    spark = status.sparkSession
    names = spark.createDataFrame([(s,) for s in every], f"{column} string")
    counted = names.join(status.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    return counted.union(status.agg(F.count("*").alias("n")).select(F.lit("all"), "n"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    size = max(10, min(200, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
