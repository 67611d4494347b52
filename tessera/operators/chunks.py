"""Chunkers whose windows SQL can express."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .chunkers import limited


def windows(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk_order, tokens, content): overlapping windows, a character a token; windows start while text is left."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    cut = docs.select(id_col, F.col(text_col).alias("_t"), F.posexplode(starts).alias("chunk_order", "_s"))
    part = F.substring(F.col("_t"), F.col("_s") + 1, F.lit(size))
    return cut.select(id_col, "chunk_order", F.length(part).alias("tokens"), trimmed(part).alias("content"))


def split_lines(docs: DataFrame, id_col: str, text_col: str, mark: str = "\n") -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, mark)).alias("chunk_order", "_p")).select(id_col, "chunk_order", trimmed(F.col("_p")).alias("content")).where("content <> ''")


def split_windows(docs: DataFrame, id_col: str, text_col: str, mark: str, size: int, overlap: int, only: bool = False) -> DataFrame:
    """(id, chunk_order, tokens, content): parts between marks, those beyond `size` in overlapping windows; with `only` such a part is an error.

    Empty parts are chunks of no tokens, the empty text is one such part, and a null text has none.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(size - overlap)), lambda s: F.substring(p, s + 1, F.lit(size)))
    if only:
        cut = lambda p: F.array(F.raise_error(F.format_string(f"a part has %d tokens, the limit is {size}", F.length(p))).cast("string"))
    parts = F.transform(F.split(text_col, re.escape(mark)), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p)))
    every = docs.select(id_col, F.posexplode(F.flatten(parts)).alias("chunk_order", "_p"))
    return every.select(id_col, "chunk_order", F.length("_p").alias("tokens"), trimmed(F.col("_p")).alias("content"))


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, unit_order, content): the sentences of the paragraphs, trimmed; blank ones are left out."""
    found = F.flatten(F.transform(F.split(text_col, "\n\n"), lambda p: F.split(p, "(?<=[。！？；.!?])")))
    found = F.filter(F.transform(found, trimmed), lambda u: u != "")
    return docs.select(id_col, F.posexplode(found).alias("unit_order", "content"))


def within_limit(cut: DataFrame, id_col: str, size: int) -> DataFrame:
    """Chunks (id, chunk_id, chunk_order, content) of which none is longer than `size`, before they are embedded.

    (id, chunk_id, content, tokens, split_part, split_total): a chunk that was cut has -s01, -s02, ... behind its chunk_id;
    for others the last two are null. Blank chunks are left out. The order of a document is that of (chunk_order, split_part).
    """
    kinds = {c: cut.schema[c].dataType.simpleString() for c in (id_col, "chunk_id", "chunk_order")}

    def run(batches):
        for b in batches:
            at, content, part, total = [], [], [], []
            for i, t in enumerate(b.column(3)):
                pieces = limited(t.as_py(), size)
                whole = len(pieces) == 1 and pieces[0] == t.as_py()
                for k, p in enumerate(pieces, 1):
                    at.append(i), content.append(p), part.append(None if whole else k), total.append(None if whole else len(pieces))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(3)), pa.array(content, pa.string()), pa.array(part, pa.int32()), pa.array(total, pa.int32())], names=[*kinds, "content", "split_part", "split_total"])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    out = cut.select(*kinds, "content").mapInArrow(run, f"{schema}, content string, split_part int, split_total int")
    named = F.when(F.col("split_part").isNull(), F.col("chunk_id")).otherwise(F.format_string("%s-s%02d", F.col("chunk_id"), F.col("split_part")))
    return out.select(id_col, named.alias("chunk_id"), "chunk_order", "content", F.length("content").alias("tokens"), "split_part", "split_total")
