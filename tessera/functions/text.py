"""Scalar text and id functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def hashed_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(c.cast("binary")))


def summary(c: Column, size: int = 250) -> Column:
    """The first `size` characters and three dots, or the trimmed text if it is no longer."""
    t = trimmed(c)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size), F.lit("...")))


def without_thoughts(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def chunk_id(doc: Column, order: Column) -> Column:
    return F.format_string("%s-chunk-%03d", doc.cast("string"), order.cast("int"))


def pair_key(a: Column, b: Column, sep: str = "<SEP>") -> Column:
    """Both ends in order, so that either direction has the same key."""
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))
