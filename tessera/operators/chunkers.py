"""Chunkers that are folds over one text: recursive, semantic, sentence packing and paragraph blocks.

Each takes a text and returns its pieces; `apply` runs one over a table, a batch at a time, so a task holds no more than
a batch and a long text stays with its own row. Size is counted by a function, by default one code point a token.
Null and empty texts have no chunks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Paragraph, line, CJK sentence ends, space, then single characters.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*(?=\S)|\n+")
#: Ends of a sentence where a chunk is too long to embed.
_STOP = re.compile(r"(?<=[。！？；.!?])")

Counter = Callable[[str], int]


def _parts(text: str, size: int, separators: tuple[str, ...], count: Counter) -> Iterator[str]:
    """Parts of at most `size`, in order and without loss, cut at the coarsest separator that does it."""
    if count(text) <= size:
        yield text
        return
    at = next((i for i, s in enumerate(separators) if s and s in text), None)
    if at is None:
        step = size if count is len else 1
        yield from (text[i : i + step] for i in range(0, len(text), step))
        return
    mark = separators[at]
    for i, part in enumerate(text.split(mark)):
        part = part if i == 0 else mark + part
        if part:
            # the mark leads its part, so that the part alone is cut by finer ones
            yield from _parts(part, size, separators[at + 1 :], count)


def recursive(text: str | None, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, count: Counter = len) -> list[str]:
    """Parts packed greedily up to `size`; a chunk begins with the last parts of the one before, up to `overlap`."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    out, own, sizes = [], [], []
    for part in _parts(text or "", size, separators, count):
        n = count(part)
        if own and sum(sizes) + n > size:
            out.append("".join(own))
            while own and (sum(sizes) > overlap or sum(sizes) + n > size):
                own.pop(0), sizes.pop(0)
        own.append(part), sizes.append(n)
    if own:
        out.append("".join(own))
    return [s for s in (c.strip() for c in out) if s]


def sentences(text: str | None) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text or "")) if s]


def packed(units: list[str], size: int, count: Counter = len, mark: str = " ") -> list[str]:
    """Units joined greedily while they fit; one that is too long by itself is cut by the recursive chunker."""
    out, own = [], ""
    for u in units:
        for piece in recursive(u, size, count=count) if count(u) > size else [u]:
            joined = own + mark + piece if own else piece
            if own and count(joined) > size:
                out.append(own)
                joined = piece
            own = joined
    return [*out, own] if own else out


def limited(text: str | None, size: int) -> list[str]:
    """The text itself, or pieces of at most `size` characters of its own: sentences, or windows of one that is too long.

    Sentences of a piece are joined by a blank line, which does not count. Blank texts have no pieces.
    """
    if not (text or "").strip() or len(text) <= size:
        return [text] if (text or "").strip() else []
    units = [u for p in text.split("\n\n") for u in (x.strip() for x in _STOP.split(p.strip())) if u]
    out, own, used = [], [], 0
    for u in units:
        if own and used + len(u) > size:
            out.append("\n\n".join(own))
            own, used = [], 0
        if len(u) > size:
            out += [p for p in (u[i : i + size].strip() for i in range(0, len(u), size)) if p]
        else:
            own.append(u)
            used += len(u)
    return [*out, "\n\n".join(own)] if own else out


def hashed_words(texts: list[str], width: int = 256) -> np.ndarray:
    """A vector for each text from its words alone: the model hook's default."""
    out = np.zeros((len(texts), width))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            out[i, zlib.crc32(w.encode()) % width] += 1
    return out


def limit(distances: np.ndarray, kind: str = "percentile", amount: float | None = None) -> float:
    """The distance above which a break falls: percentile (95), standard_deviation (3), interquartile (1.5) or gradient (95)."""
    if kind == "percentile":
        return float(np.percentile(distances, 95 if amount is None else amount))
    if kind == "standard_deviation":
        return float(distances.mean() + (3 if amount is None else amount) * distances.std())
    if kind == "interquartile":
        low, high = np.percentile(distances, [25, 75])
        return float(distances.mean() + (1.5 if amount is None else amount) * (high - low))
    if kind == "gradient":
        return float(np.percentile(np.gradient(distances), 95 if amount is None else amount))
    raise ValueError(f"unknown kind of limit: {kind}")


def semantic(text: str | None, size: int, embed: Callable[[list[str]], np.ndarray] | None = hashed_words, kind: str = "percentile", amount: float | None = None, window: int = 1, count: Counter = len) -> list[str]:
    """Sentences are grouped between large changes of meaning; groups beyond `size` are cut by the recursive chunker.

    Without an embedding function the text goes to the recursive chunker as a whole.
    """
    if embed is None:
        return recursive(text, size, count=count)
    units = sentences(text)
    if len(units) < 3:
        return recursive(text, size, count=count)
    v = embed([" ".join(units[max(0, i - window) : i + window + 1]) for i in range(len(units))])
    norm = np.linalg.norm(v, axis=1)
    norm[norm == 0] = 1
    v = v / norm[:, None]
    d = 1 - (v[:-1] * v[1:]).sum(axis=1)
    over = limit(d, kind, amount)
    held = np.gradient(d) if kind == "gradient" and len(d) > 1 else d
    cuts = [0, *(np.flatnonzero(held > over) + 1).tolist(), len(units)]
    groups = [" ".join(units[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    return [c for g in groups for c in recursive(g, size, count=count)]


def row_groups(sizes: list[int], ideal: int, most: int) -> list[tuple[int, int]]:
    """Table rows dealt into even runs (start, end): as many as the ideal and the largest size ask for, a row each at least."""
    total = sum(sizes)
    if not sizes or total <= most:
        return [(0, len(sizes))] if sizes else []
    wanted = min(len(sizes), max(math.ceil(total / ideal), math.ceil(total / most)))
    out, start, seen = [], 0, 0
    for i, n in enumerate(sizes):
        seen += n
        left_rows, left_runs = len(sizes) - i - 1, wanted - len(out) - 1
        if left_runs and (seen >= total * (len(out) + 1) / wanted or left_rows == left_runs):
            out.append((start, i + 1))
            start = i + 1
    return [*out, (start, len(sizes))]


def windows_to_end(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows (start, end) that stop once the end is reached; the overlap is held below the size."""
    step = size - min(overlap, size - 1)
    out = []
    for a in range(0, n, step):
        out.append((a, min(a + size, n)))
        if a + size >= n:
            break
    return out


def greedy_bins(sizes: list[int], budget: int, least: int = 2) -> list[list[int]]:
    """Indices of fragments in bins within the budget, though each bin but the last takes `least` of them."""
    out, own, used = [], [], 0
    for i, n in enumerate(sizes):
        if len(own) >= least and used + n > budget:
            out.append(own)
            own, used = [], 0
        own.append(i)
        used += n
    return [*out, own] if own else out


def apply(docs: DataFrame, id_col: str, text_col: str, chunker: Callable[[str | None], list[str]]) -> DataFrame:
    """(id, chunk_order, tokens, content) of all texts, with the id's own type."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, order, content = [], [], []
            for i, t in enumerate(b.column(1)):
                for k, c in enumerate(chunker(t.as_py())):
                    at.append(i), order.append(k), content.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(order, pa.int32()), pa.array([len(c) for c in content], pa.int32()), pa.array(content, pa.string())], names=[id_col, "chunk_order", "tokens", "content"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, chunk_order int, tokens int, content string")
