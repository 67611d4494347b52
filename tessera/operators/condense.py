"""Descriptions of one key condensed into one text, by a model where joining them is not enough."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .graph import written

Summarize = Callable[[list[str]], str]


def groups(texts: Iterator[tuple[object, str]], context: int) -> Iterator[tuple[object, list[str]]]:
    """(key, texts) of runs within `context` characters, from (key, text) with equal keys side by side.

    A run takes two texts at least, however long, while its key has them; no more than one run is held.
    """
    key, own, size = None, [], 0
    for k, t in texts:
        over = size + len(t) > context
        if own and (k != key or (over and len(own) > 1)):
            yield key, own
            own, size, over = [], 0, False
        key, size = k, size + len(t)
        own.append(t)
        if over and len(own) == 2:
            yield key, own
            own, size = [], 0
    if own:
        yield key, own


def condensed(fragments: DataFrame, key: str, order: str, text: str, summarize: Summarize, context: int = 12000, most: int = 1200, least: int = 8, mark: str = "<SEP>") -> DataFrame:
    """(key, text, used): one text for each key; used says whether the model had a part in it. A character is a token.

    A lone description stays; fewer than `least` of less than `most` characters are joined; up to `context` characters,
    or two, go to the model at once. More are cut into runs that are condensed by themselves, and their summaries are
    looked at again, each round written. Runs come from a stream sorted by key, so no task holds all fragments of a key.
    Null texts are left out; ties in order go by text.
    """
    kind = fragments.schema[key].dataType.simpleString()
    key_type = to_arrow_type(fragments.schema[key].dataType)
    left = written(fragments.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"), F.lit(False).alias("used")))
    done, first = [], True

    def shorten(batches):
        for b in batches:
            said = [summarize(x) if ask else None for x, ask in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], names=["k", "t"])

    def fold(batches):
        rows = ((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for n, (k, own) in enumerate(groups(rows, context)):
            yield pa.RecordBatch.from_arrays([pa.array([k], key_type), pa.array([n], pa.int64()), pa.array([summarize(own) if len(own) > 1 else own[0]], pa.string())], names=["k", "o", "t"])

    while True:
        sums = left.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("size"), F.bool_or("used").alias("was"))
        lone = F.col("n") == 1 if first else F.lit(False)
        ready = lone | (F.col("size") <= context) | (F.col("n") <= 2)
        state = written(sums.select("k", "was", ready.alias("ready"), (~lone & ~((F.col("n") < least) & (F.col("size") < most))).alias("ask")))
        same = F.col("s.k").eqNullSafe(F.col("l.k"))
        final = left.alias("l").join(state.where("ready").alias("s"), same).groupBy("l.k", "was", "ask").agg(F.sort_array(F.collect_list(F.struct("o", "t"))).alias("f"))
        final = final.select("k", "was", "ask", F.transform("f", lambda x: x["t"]).alias("texts"))
        done.append(written(final.where("NOT ask").select("k", F.array_join("texts", mark).alias("t"), F.col("was").alias("used"))))
        done.append(written(final.where("ask").select("k", "texts", "ask").mapInArrow(shorten, f"k {kind}, t string").withColumn("used", F.lit(True))))
        if state.where("NOT ready").isEmpty():
            break
        rest = left.alias("l").join(state.where("NOT ready").alias("s"), same).select("l.k", "t", "o")
        dealt = rest.repartition("k").sortWithinPartitions("k", "o", "t").select("k", "t")
        left, first = written(dealt.mapInArrow(fold, f"k {kind}, o long, t string").withColumn("used", F.lit(True))), False
    return reduce(DataFrame.union, done).select(F.col("k").alias(key), F.col("t").alias(text), "used")
