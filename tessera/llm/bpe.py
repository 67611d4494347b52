"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at boundaries where the split pattern always begins a new match (one blank between two
characters that are no white space), so each call sees a bounded text. A single match that is longer than
LONG_MATCH bytes is merged with a heap, in n log n steps.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters per library call, at least; texts are cut at the next safe boundary after these.
CUT = 1 << 16
#: Bytes of one pattern match beyond which the heap merge is used.
LONG_MATCH = 1 << 14
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class ByteBpe:
    def __init__(self, rank_file: str, pattern: str):
        import regex
        import tiktoken

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= CUT:
            return self._piece(text)
        ids: list[int] = []
        for part in safe_parts(text):
            ids += self._piece(part)
        return ids

    def _piece(self, text: str) -> list[int]:
        if len(text) <= LONG_MATCH // 4:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        start = done = 0
        # white-space matches right before the present one; how the pattern splits them depends on what follows
        blanks: list[str] = []
        for m in self.pattern.finditer(text):
            own = m.group()
            if len(own) > LONG_MATCH // 4 and len(word := own.encode()) > LONG_MATCH:
                stop = m.start() - sum(map(len, blanks))
                ids += self.encoding.encode_ordinary(text[start:stop]) if start < stop else []
                for x in blanks:
                    ids += self.match(x.encode())
                ids += self.merge(word)
                start, blanks = m.end(), []
            elif own.isspace():
                blanks.append(own)
            elif blanks:
                blanks = []
            done = m.end()
        return ids + (self.encoding.encode_ordinary(text[start:done]) if start < done else [])

    def match(self, word: bytes) -> list[int]:
        """Ids of one match, which may be a token as a whole."""
        return [self.ranks[word]] if word in self.ranks else self.merge(word)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one match: always the lowest-ranked adjacent pair first, the leftmost among equals."""
        n, ranks = len(word), self.ranks
        nxt, prev, alive, end = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j], nxt[i] = stop, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def safe_parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > CUT and (m := _SAFE.search(text, start + CUT)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


@functools.cache
def codec(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ids (array of int). A null text counts as empty and has no ids."""

    def run(batches):
        own = codec(rank_file, pattern)
        for b in batches:
            ids = [own.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"{id_col} {kept.schema[0].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id column, bytes (binary). Null ids count as none."""

    def run(batches):
        own = codec(rank_file, pattern)
        for b in batches:
            out = [own.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    kept = rows.select(id_col, "ids")
    return kept.mapInArrow(run, f"{id_col} {kept.schema[0].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens, ids_sha256 (decimal ids joined by blanks), decoded_sha256 (bytes of the decoded ids).

    Encoding and decoding run in one pass, so ids never leave the worker. A null text counts as empty; an empty
    text has no ids and the digests of nothing. Rows with the same id are handled one by one.
    """

    def run(batches):
        own = codec(rank_file, pattern)
        sha = hashlib.sha256
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for t in b.column(1):
                ids = own.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(sha(str(ids)[1:-1].replace(", ", " ").encode()).hexdigest())
                out_sha.append(sha(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"{id_col} {kept.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
