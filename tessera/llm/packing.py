"""Best-fit packing of token pieces into fixed-length sequences by a configuration linear program.

Texts are tokenised on the executors and cut into pieces of at most `capacity` tokens. The driver sees the
histogram of piece lengths alone (at most `capacity` numbers). The covering program over configurations (which
lengths share a sequence) is solved by multiplicative weights: lengths that are covered least get the highest
prices, a knapsack by dynamic programming finds the best-priced configuration, and so on; the mix is then rounded
down to whole copies of configurations, and what is left is packed largest-fit first, a configuration at a time.
The plan has a few thousand runs at most, whatever the number of documents. A piece finds its place by its rank
among the pieces of its length; ranks come from counts per task and length, so no task sorts a whole length.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, held

#: Entries of a worker's word cache, about 0.25 KB each; when it is full the first KEPT stay, among them nearly all frequent words.
CACHE, KEPT = 600_000, 300_000
#: Words that one tokeniser call gets, joined by blanks.
JOINED = 2_000


#: Combining marks compose before the tokeniser lowers letters, and "<|" may begin a special token, whose case counts.
_MARKS = re.compile("[\u0300-\u036f]|<\\|")
#: Letters and digits after which a comma or full stop is a token of its own, whatever the tokeniser does to them before.
_ENDS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _plain(text: str) -> str:
    """A-Z in lower case, as the tokeniser does later, in texts where that changes nothing."""
    return text if _MARKS.search(text) else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class WordIds:
    """Ids of blank-separated chunks as little-endian bytes, remembered between calls.

    The tokeniser drops white space and never merges across it, so a text's ids are its chunks' ids in a row. Special
    tokens (no one has white space) are found in texts as the tokeniser itself does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = dict(itertools.islice(self.known.items(), KEPT))
        known = self.known
        split = [_plain(t).replace("\n", " ").split(" ") for t in texts]
        missing = {w for ws in split for w in ws if w not in known}
        ended = [w for w in missing if w[-1] in ",." and len(w) > 1 and w[-2] in _ENDS]
        new = list((missing.difference(ended) | {w[:-1] for w in ended} | {",", "."}).difference(known))
        for i in range(0, len(new), JOINED):
            self._learn(new[i : i + JOINED])
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1]]
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def _learn(self, words: list[str]) -> None:
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        enc = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.asarray(enc.ids, "<u4")
        at = np.asarray([a for a, _ in enc.offsets], np.int64)
        cuts = np.searchsorted(at, starts)
        for w, a, b in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.known[w] = ids[a:b].tobytes()


PIECES = "pid int, doc_id {id}, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (pid, doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut every `capacity` ids.

    pid is the task that read the row. Null texts count as empty and have the end id alone.
    """
    kept = docs.select(id_col, text_col)
    kind = kept.schema[0].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")
    step, key = 4 * capacity, ("word ids", tokenizer)

    def run(batches):
        ids_of, pid = held(key, lambda: WordIds(tokenizer)), TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(ids_of([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for k, p in enumerate(range(0, len(ids), step)):
                        cut = ids[p : p + step]
                        row.append(i), piece.append(k), start.append(p // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(row), pa.int32()), part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names=["pid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return kept.mapInArrow(frugal(run, keeps=key), PIECES.format(id=kind))


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of the highest value that fits (each size any number of times)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        k = np.searchsorted(sizes, c, "right")
        got = best[c - sizes[:k]] + values[:k]
        j = int(got.argmax())
        if got[j] > best[c - 1]:
            best[c], choice[c] = got[j], j
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return counts


def multiplicative_weights(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, eta: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """A mix of configurations that covers the demand about evenly: (configuration, copies, not whole)."""
    weight, covered, mix = np.ones(len(sizes)), np.zeros(len(sizes)), {}
    for _ in range(rounds):
        config = knapsack(sizes, weight / demand, capacity)
        step = (demand[config > 0] / config[config > 0]).min()
        mix[tuple(config)] = mix.get(tuple(config), 0.0) + step
        gain = config * step / demand
        covered += gain
        weight *= np.exp(-eta * gain)
        weight /= weight.max()
    scale = 1 / max(covered.max(), 1e-12)  # no length beyond its demand
    return [(np.array(c), x * scale) for c, x in mix.items()]


def plan(histogram: dict[int, int], capacity: int, classes: int = 96, rounds: int = 300) -> list[tuple[list[int], int]]:
    """Configurations, each a list of lengths, with whole copies; together they hold each piece exactly once.

    The program has at most `classes` sizes: neighbouring lengths share the largest of them. Within a configuration
    the rounding takes the longest pieces of a class that are left, and its free tail goes to the largest that fit.
    """
    left = {n: k for n, k in histogram.items() if k > 0}
    out: list[tuple[list[int], int]] = []
    if left.get(capacity):
        out.append(([capacity], left.pop(capacity)))
    for _ in range(2):
        lengths = np.array(sorted(left), np.int64)
        if len(lengths) < 2:
            break
        counts = np.array([left[n] for n in lengths.tolist()], np.float64)
        group = np.minimum((np.cumsum(counts) - counts / 2) * classes // counts.sum(), classes - 1).astype(int)
        keys = np.unique(group)
        members = [lengths[group == g].tolist() for g in keys]
        sizes, demand = np.array([m[-1] for m in members]), np.array([counts[group == g].sum() for g in keys])
        mix = multiplicative_weights(sizes, demand, capacity, rounds)
        for config, copies in sorted(mix, key=lambda x: -x[1]):
            _take(config, int(copies), members, left, capacity, out)
    while left:
        config, room, lengths = [], capacity, sorted(left, reverse=True)
        for n in lengths:
            k = min(left[n], room // n)
            config += [n] * k
            room -= n * k
        _use(config, min(left[n] // config.count(n) for n in set(config)), left, out)
    return out


def _use(config: list[int], copies: int, left: dict[int, int], out: list) -> None:
    out.append((config, copies))
    for n in set(config):
        left[n] -= copies * config.count(n)
        if not left[n]:
            del left[n]


def _take(config: np.ndarray, copies: int, members: list[list[int]], left: dict[int, int], capacity: int, out: list) -> None:
    """Place up to `copies` of a configuration of classes with the lengths that are left, as runs of equal sequences."""
    while copies > 0:
        taken: dict[int, int] = {}
        for g in np.nonzero(config)[0][::-1].tolist():
            need = int(config[g])
            for n in reversed(members[g]):
                k = min(need, left.get(n, 0) - taken.get(n, 0))
                if k > 0:
                    taken[n] = taken.get(n, 0) + k
                    need -= k
                if not need:
                    break
            if need:
                return
        room = capacity - sum(n * k for n, k in taken.items())
        for n in sorted(left, reverse=True) if room else ():
            if n <= room and (k := min(room // n, left[n] - taken.get(n, 0))) > 0:
                taken[n] = taken.get(n, 0) + k
                room -= n * k
                if not room:
                    break
        k = min(copies, *(left[n] // x for n, x in taken.items()))
        _use([n for n in sorted(taken, reverse=True) for _ in range(taken[n])], k, left, out)
        copies -= k


def runs(planned: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies, first sequence, offset): ranks of a length in a row go to sequences in a row."""
    out, seen, sequence = [], {}, 0
    for config, copies in planned:
        offset = 0
        for n in config:
            out.append((n, seen.get(n, 0), copies, sequence, offset))
            seen[n] = seen.get(n, 0) + copies
            offset += n
        sequence += copies
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one a piece; pieces of a sequence lie gapless from 0.

    Null texts count as empty: a piece of the end id. Equal rows are packed each. An empty table gives no rows.
    """
    from .common import settle

    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    by_task = cut.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = runs(plan(histogram, capacity))
    by_length: dict[int, tuple] = {}
    for n, first, copies, sequence, offset in placed:
        by_length.setdefault(n, []).append((first, copies, sequence, offset))
    by_length = {n: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for n, v in by_length.items()}
    plan_of = spark.sparkContext.broadcast(by_length)
    # where the ranks of each task begin, per length: a running sum over the tasks
    before = F.sum("n").over(_window("length", "pid")) - F.col("n")
    starts = by_task.select("pid", "length", before.alias("before"))
    ranked = cut.join(starts, ["pid", "length"]).select("*", (F.row_number().over(_window(["pid", "length"], ["doc_id", "piece", "start", "ids_crc32"])) - 1 + F.col("before")).alias("rank"))

    @frugal
    def place(batches):
        table = plan_of.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, at = np.unique(length[order], return_index=True)
            for n, rows in zip(values.tolist(), np.split(order, at[1:]), strict=True):
                first, _, seq, off = table[n]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = seq[k] + rank[rows] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start")] + [b.column("length").cast(pa.int64()), b.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _window(by, order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order)
