"""Order-sensitive operators: every order is total, ties are broken by an id, and no window is without a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(df: DataFrame, by: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows in order while the running sum of sizes stays within the budget; nothing for a budget of 0 or less."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where((F.col("running") <= budget) & F.lit(budget > 0))


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_by(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def round_robin(df: DataFrame, by: list[str], place: str, source: str, key: str) -> DataFrame:
    """Merge lists by taking turns: place 1 of each source, then place 2; a key counts where it is seen first."""
    first = first_by(df, [*by, key], [F.col(place), F.col(source)])
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(place, source)))


def weighted_polling(df: DataFrame, by: list[str], owner: str, place: str, most: int, least: int) -> DataFrame:
    """Quotas fall in a line from `most` for the first owner to `least` for the last; what owners leave over goes to
    the remaining rows by owner and place. Owners are numbered from 0 without gaps, places from 1."""
    w = Window.partitionBy(*by)
    n = (F.max(owner).over(w) + 1).cast("int")
    quota = F.when(n == 1, F.lit(most)).otherwise(F.bround(F.lit(most) - F.col(owner) / (n - 1) * F.lit(most - least)).cast("int"))
    rows = df.withColumn("_quota", quota).withColumn("_taken", F.col(place) <= F.col("_quota"))
    size = F.count("*").over(Window.partitionBy(*by, owner))
    rows = rows.withColumn("_left", F.sum(F.when((F.col(place) == 1), F.greatest(F.col("_quota") - size, F.lit(0)))).over(w))
    rest = F.row_number().over(Window.partitionBy(*by, "_taken").orderBy(owner, place))
    rows = rows.withColumn("_rest", rest)
    return rows.where(F.col("_taken") | (F.col("_rest") <= F.coalesce("_left", F.lit(0)))).withColumn("round", F.when(F.col("_taken"), 1).otherwise(2)).drop("_quota", "_taken", "_left", "_rest")
