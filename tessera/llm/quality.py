"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Each passage has dense features of its own characters and words
(never of its label, language, source or id), an encoder maps them to a hidden vector, gated attention weighs the
passages, and a logistic unit scores the weighted vector. Only document labels are needed. The model is fitted on
the driver from at most `max_train` labelled documents (smallest hashes of the id first); every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal

PASSAGE = 64
#: Bytes of the longest part of a text that is taken whole, and of the texts that the feature arrays are made for at once; the arrays take tens of times as much.
SLICE, GROUP = 1 << 21, 1 << 18
#: Labelled documents that the model is fitted on, at most, with all of their passages.
MAX_TRAIN = 6000

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&^~", "<>|{}[]\\/=_", "!?", ".,;:", "\"'()-", "\n"]
N_CLASS = len(_CLASSES) + 3
_LOOKUP = np.full(256, len(_CLASSES) + 1, np.int8)
for _i, _cs in enumerate(_CLASSES):
    _LOOKUP[[ord(c) for c in _cs]] = _i
_LOOKUP[[32, 9, 11, 12, 13]] = len(_CLASSES)
_LOOKUP[128:] = len(_CLASSES) + 2
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(7)
_BYTE, _PLACE = (_RNG.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1) for n in (256, 64))
N_FEATURES = N_CLASS + 13


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of texts of about GROUP bytes; a text longer than SLICE comes in parts that end at a blank where there is one."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        at = 0
        while True:
            end = len(b) if len(b) - at <= SLICE else (b.rfind(b" ", at + 1, at + SLICE) + 1 or at + SLICE)
            rows.append(i), parts.append(b[at:end])
            size, at = size + end - at, end
            if size >= GROUP:
                yield rows, parts
                rows, parts, size = [], [], 0
            if at >= len(b):
                break
    if rows:
        yield rows, parts


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x N_FEATURES, float32) and the row of each. A text without words has one passage of zeros."""
    found = [_features(r, p) for r, p in _slices(texts)]
    x, row = np.concatenate([f for f, _ in found]), np.concatenate([r for _, r in found])
    # what only the whole document knows: its passages
    n = np.bincount(row, minlength=len(texts))
    x[:, -1] = np.log1p(n[row]) / 5
    return x, row


def _features(rows: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    sizes = np.array([len(p) + 1 for p in parts])
    part_end = np.cumsum(sizes)
    space = _SPACE[buf]
    word = ~space
    start = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    stop = np.flatnonzero(space & np.concatenate(([False], word[:-1])))
    owner = np.searchsorted(part_end, start, "right")
    n_words = np.bincount(owner, minlength=len(parts))
    first_word = np.cumsum(n_words) - n_words
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    first_pass = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    pass_part = np.repeat(np.arange(len(parts)), n_pass)
    x = np.zeros((total, N_FEATURES), np.float32)
    row = np.asarray(rows)[pass_part]
    if not len(start):
        return x, row
    within = np.arange(len(start)) - first_word[owner]
    word_pass = first_pass[owner] + within // PASSAGE
    size = np.bincount(word_pass, minlength=total).astype(np.float64)
    length = stop - start
    # bytes belong to the passage of the word they are in or follow
    cell = np.repeat(word_pass, np.diff(np.append(start, len(buf))))
    cell *= N_CLASS
    cell += _LOOKUP[buf[start[0] :]]
    hist = np.bincount(cell, minlength=total * N_CLASS).reshape(total, N_CLASS)
    del cell  # as long as all bytes, eight times as wide
    n_bytes = np.maximum(hist.sum(1, keepdims=True), 1)
    x[:, :N_CLASS] = hist / n_bytes
    mean = lambda v: np.bincount(word_pass, v, minlength=total) / np.maximum(size, 1)
    m = mean(length)
    head = buf[start]
    upper = (head >= 65) & (head <= 90)
    place = (np.arange(len(buf)) - np.repeat(np.append(0, start), np.diff(np.concatenate(([0], start, [len(buf)]))))) & 63
    hashes = _BYTE[buf]
    hashes *= _PLACE[place]
    hashes[space] = 0
    hashes = np.add.reduceat(hashes, start)
    slot = within % PASSAGE
    grid = np.zeros((total, PASSAGE), np.uint64)
    grid[word_pass, slot] = hashes
    grid.sort(axis=1)
    distinct = ((grid[:, 1:] != grid[:, :-1]) & (grid[:, 1:] != 0)).sum(1) + (grid[:, 0] != 0)
    same = lambda k: np.concatenate((np.zeros(k, bool), (hashes[k:] == hashes[:-k]) & (owner[k:] == owner[:-k])))[: len(hashes)]
    own = [np.log1p(size) / 4.2, m / 10, np.sqrt(np.maximum(mean(length.astype(float) ** 2) - m**2, 0)) / 10, distinct / np.maximum(size, 1), mean(same(1)), mean(same(2)), mean(length <= 3), mean(length >= 12), mean(upper), mean(length == 1), np.bincount(word_pass[np.isin(buf[np.maximum(stop - 1, 0)], [33, 46, 63])], minlength=total) / np.maximum(size, 1), mean(same(8))]
    x[:, N_CLASS : N_CLASS + len(own)] = np.stack(own, 1)
    return x, row


class AttentionMil:
    """h = tanh(xW + b); weights = softmax over the bag of u . (tanh(hV) * sigmoid(hG)); score = sigmoid(c . sum(weights * h) + d)."""

    def __init__(self, n_in: int = N_FEATURES, hidden: int = 24, gate: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        new = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": new(n_in, hidden), "b": np.zeros(hidden, np.float32), "V": new(hidden, gate), "G": new(hidden, gate), "u": new(gate), "c": new(hidden), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(n_in, np.float32), np.ones(n_in, np.float32)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        a = (t * g) @ p["u"]
        n = np.diff(np.append(starts, len(x)))
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), n))
        w = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(h * w[:, None], starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return s, (x, h, t, g, w, z, n)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        s, (x, h, t, g, w, z, n) = self.forward(x, starts)
        ds = (s - y) / len(y)
        dz = ds[:, None] * p["c"]
        dz_row = np.repeat(dz, n, axis=0)
        dw = (dz_row * h).sum(1)
        da = w * (dw - np.repeat(np.add.reduceat(w * dw, starts), n))
        dtg = da[:, None] * p["u"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh = (dz_row * w[:, None] + dt @ p["V"].T + dg @ p["G"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "G": h.T @ dg, "u": (t * g).T @ da, "c": z.T @ ds, "d": np.array([ds.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, size: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 1) -> AttentionMil:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), size):
                k = order[i : i + size]
                part = [bags[j] for j in k]
                starts = np.cumsum([0] + [len(b) for b in part[:-1]])
                step += 1
                for name, grad in self.gradients(np.concatenate(part), starts, y[k]).items():
                    grad = grad + decay * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.999 * v[name] + 0.001 * grad**2
                    fall = rate * (1 - epoch / epochs) / (1 - 0.9**step)
                    self.p[name] = (self.p[name] - fall * m[name] / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, row = passages(texts)
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        return self.forward(x, starts)[0].astype(np.float64)


def bags_of(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Per row: the kept columns and bag, the features of all passages as little-endian float32."""

    @frugal
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x, row = passages(part.column(0).to_pylist())
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                bags = [x[a:z].astype("<f4").tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(1, 1 + len(keep))), pa.array(bags, pa.binary())], names=[*keep, "bag"])

    kept = docs.select(text_col, *keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema[1:])
    return kept.mapInArrow(run, f"{schema}, bag binary")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, max_train: int = MAX_TRAIN, id_col: str = "doc_id", label: str = "quality", text_col: str = "text") -> AttentionMil:
    """Fit on documents with a label 0 or 1, only from ids for which `allowed` (over the id column) holds.

    Of several labels for one id the largest counts. Null ids and null labels are left out. Without any labelled
    document of both classes the untrained model is returned with the share of ones as its constant score.
    """
    own = labels.select(F.col(id_col), F.col(label).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1) & allowed)
    own = own.groupBy(id_col).agg(F.max("label").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(max_train)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(own.select(F.col(id_col).alias("_id"), "label")), "_id")
    # of repeated rows of an id the least text, so that the sample keeps its bound; the order makes the fit repeatable
    texts = texts.groupBy("_id", "label").agg(F.min("_text").alias("_text"))
    rows = bags_of(texts, "_text", ("_id", "label")).orderBy(F.xxhash64("_id"), "_id").collect()
    model = AttentionMil()
    y = np.array([r.label for r in rows], np.float32)
    if len(rows) and 0 < y.sum() < len(y):
        model.fit([np.frombuffer(r.bag, "<f4").reshape(-1, N_FEATURES) for r in rows], y)
    else:
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        model.p |= {"c": np.zeros_like(model.p["c"]), "d": np.array([np.log(share / (1 - share))], np.float32)}
    return model


def score(docs: DataFrame, model: AttentionMil, columns: list[str], text_col: str = "text") -> DataFrame:
    """The given columns and `score` (0 to 1). A null text counts as empty; an empty text has one empty passage.

    Rows are scored one by one: repeated rows give repeated scores, an empty table none. Other columns may have any names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    # a text that is among the columns is sent once
    place = columns.index(text_col) if text_col in columns else len(columns)
    kept = docs.select(*columns, *([F.col(text_col).alias("_text_")] if place == len(columns) else []))

    @frugal
    def run(batches):
        own = shared.value
        for b in batches:
            out = [own.score(b.column(place).slice(at, 1000).to_pylist()) for at in range(0, b.num_rows, 1000)]
            if out:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(columns))), pa.array(np.concatenate(out))], names=[*columns, "score"])

    schema = docs.select(*columns).schema.add("score", "double")
    return kept.mapInArrow(run, schema)
