"""A gated recurrent language model in numpy, trained data-parallel and scored on whole documents.

Tokens are white-space words with A-Z lower-cased, and one end token a document. The model knows the most frequent
words; any other word is the rare symbol, followed by a smoothed unigram choice among all other words, so each token
sequence has a proper probability. The output softmax is factored into classes of words of similar frequency.
Training is truncated backpropagation over streams of documents: every task reads its share of the documents, starts
from the shared parameters, and the parameters are averaged by tokens in a tree of small groups, for each of a few
rounds that split the documents among them. Scoring carries the state from window to window, so a document's score
is its complete log-likelihood, whatever its length.

Counts cover all training documents. Workers get the counts of at most DICTIONARY frequent words; those of all other
words are joined.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Words whose counts are sent to the workers, at most, and the bytes of one of them.
DICTIONARY, LONGEST = 1 << 18, 64
#: Words that the recurrent model knows, with the end and the rare symbol; classes of the output; sizes of the layers.
VOCABULARY, CLASSES, EMBED, HIDDEN = 2048, 24, 16, 16
#: Streams that advance together, steps of a window, and tokens that are laid out at once.
STREAMS, WINDOW, LAID_OUT = 256, 32, 4_000_000
END, RARE = 0, 1
#: The largest exponent.
MOST = np.float32(60)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n long) over all rows; the end token is the empty word. Null texts count as empty."""

    def run(batches):
        from collections import Counter

        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                counts.update(words_of(t.as_py()))
            counts[b""] += b.num_rows
            if len(counts) > 400_000:
                yield _rows(counts)
                counts.clear()
        yield _rows(counts)

    def _rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Statistics:
    """Corpus totals, and the frequent words: ids 2 and up are the model's words, larger ids have counts alone."""

    n: int
    v: int
    threshold: int
    words: list[bytes]
    counts: np.ndarray
    end_count: int

    @property
    def model_size(self) -> int:
        return min(VOCABULARY, len(self.words) + 2)

    def model_counts(self) -> np.ndarray:
        known = self.counts[: self.model_size - 2]
        return np.array([self.end_count, self.n - self.end_count - known.sum(), *known], np.float64) + 1

    @property
    def rare_total(self) -> float:
        """What the counts plus one of all words but the model's, and one unknown word, add up to."""
        known = self.counts[: self.model_size - 2]
        rare_words = self.v - (self.end_count > 0) - len(known)
        return float(self.n - self.end_count - known.sum() + rare_words + 1)

    @property
    def base_total(self) -> float:
        return float(self.n + self.v + 1)


def statistics(counts: DataFrame, most: int = DICTIONARY) -> Statistics:
    """Totals, and the words from a count on that at most `most` words reach (a histogram of counts finds it)."""
    step = F.floor(F.log2("n") * 16).cast("int")
    short = (F.length("word") > 0) & (F.length("word") <= LONGEST)
    histogram = counts.groupBy(step.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(short).alias("short"), F.min("n").alias("least"), F.max(F.when(F.length("word") == 0, F.col("n"))).alias("ends")).collect()
    room, threshold = most, 1 << 62
    for r in sorted(histogram, key=lambda r: -r.k):
        if r.short > room:
            break
        room, threshold = room - r.short, min(threshold, r.least)
    frequent = counts.where(short & (F.col("n") >= threshold)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return Statistics(sum(r.n for r in histogram), sum(r.v for r in histogram), threshold, frequent.word.map(bytes).tolist(), frequent.n.to_numpy(np.int64), max((r.ends or 0 for r in histogram), default=0))


class GatedModel:
    """Parameters in one flat vector, with named views; words are ordered by class."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        v = len(counts)
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(np.sqrt(counts[order])) / np.sqrt(counts).sum()
        group = np.minimum((mass * CLASSES).astype(int), CLASSES - 1)
        # classes of at most 64 words; the rare symbol and the end stand alone
        starts, size = [0], 0
        for i in range(1, v):
            size += 1
            if group[i] != group[i - 1] or size >= 64 or order[i] in (END, RARE) or order[i - 1] in (END, RARE):
                starts.append(i)
                size = 0
        self.starts = np.array([*starts, v])
        self.place = np.empty(v, np.int64)
        self.place[order] = np.arange(v)
        self.class_of = np.searchsorted(self.starts, np.arange(v), "right") - 1
        c = len(self.starts) - 1
        shapes = {"E": (v, EMBED), "Wx": (EMBED, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "Wc": (HIDDEN, c), "bc": (c,), "Wo": (v, HIDDEN), "bo": (v,)}
        self.shapes = shapes
        rng = np.random.default_rng(seed)
        scale = {"E": 0.3, "Wx": EMBED**-0.5, "U": HIDDEN**-0.5, "Wc": 0.05, "Wo": 0.05}
        flat = [(rng.standard_normal(s) * scale[k]).ravel() if k in scale else np.zeros(s).ravel() for k, s in shapes.items()]
        self.theta = np.concatenate(flat).astype(np.float32)
        # the output starts as the unigram model
        ranked = counts[order]
        mass_of = np.add.reduceat(ranked, self.starts[:-1])
        self.view()["bc"][:] = np.log(mass_of / mass_of.sum())
        self.view()["bo"][:] = np.log(ranked / mass_of[self.class_of])

    def view(self, theta: np.ndarray | None = None) -> dict[str, np.ndarray]:
        theta, out, at = self.theta if theta is None else theta, {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = theta[at : at + n].reshape(s)
            at += n
        return out

    def recur(self, p: dict, inputs: np.ndarray, resets: np.ndarray, h: np.ndarray, keep: bool) -> tuple:
        """States after each step of a window; inputs and resets are steps x streams, h the state before."""
        steps, n = inputs.shape
        x = (p["E"][inputs.ravel()] @ p["Wx"] + p["b"]).reshape(steps, n, -1)
        hs, kept = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            if resets[t].any():
                h = h * (~resets[t])[:, None]
            u = h @ p["U"]
            g = 1 / (1 + np.exp(-(x[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
            r, z = g[:, :HIDDEN], g[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            if keep:
                kept.append((h, u, r, z, c))
            h = c + z * (h - c)
            hs[t] = h
        return hs, h, kept

    def output(self, p: dict, hs: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple:
        """Natural log-probabilities of the targets (places in class order), and the gradient for hs if asked for."""
        rows = np.arange(len(hs))
        cls = self.class_of[targets]
        # exponents stay in range by clipping; row sums go through a product, which is faster than a reduction
        logits = np.minimum(hs @ p["Wc"] + p["bc"], MOST)
        e = np.exp(logits)
        total = e @ np.ones(e.shape[1], np.float32)
        lp = logits[rows, cls] - np.log(total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grads["Wc"] += hs.T @ e
            grads["bc"] += np.ones(len(e), np.float32) @ e
            dh = e @ p["Wc"].T
        order = np.argsort(cls, kind="stable")
        ends = np.cumsum(np.bincount(cls, minlength=len(self.starts) - 1))
        lo = 0
        for k, hi in enumerate(ends.tolist()):
            a, b = self.starts[k], self.starts[k + 1]
            if hi > lo and b - a > 1:
                at = order[lo:hi]
                own, y = hs[at], targets[at] - a
                q = np.minimum(own @ p["Wo"][a:b].T + p["bo"][a:b], MOST)
                f = np.exp(q)
                s = f @ np.ones(b - a, np.float32)
                i = np.arange(hi - lo)
                lp[at] += q[i, y] - np.log(s)
                if grads is not None:
                    f /= s[:, None]
                    f[i, y] -= 1
                    grads["Wo"][a:b] += f.T @ own
                    grads["bo"][a:b] += np.ones(len(f), np.float32) @ f
                    dh[at] += f @ p["Wo"][a:b]
            lo = hi
        return lp, dh

    def learn(self, p: dict, inputs: np.ndarray, resets: np.ndarray, targets: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict]:
        """The state after the window, and the gradient of its mean negative log-likelihood, back to its start."""
        steps, n = inputs.shape
        grads = self.view(np.zeros_like(self.theta))
        hs, last, kept = self.recur(p, inputs, resets, h, True)
        flat = np.flatnonzero(valid.ravel())
        lp, dflat = self.output(p, hs.reshape(-1, HIDDEN)[flat], targets.ravel()[flat], grads)
        dhs = np.zeros((steps * n, HIDDEN), np.float32)
        dhs[flat] = dflat
        dhs = dhs.reshape(steps, n, HIDDEN)
        dx = np.empty((steps, n, 3 * HIDDEN), np.float32)
        carry = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            before, u, r, z, c = kept[t]
            d = dhs[t] + carry
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (before - c) * z * (1 - z)
            dr = dc * u[:, 2 * HIDDEN :] * r * (1 - r)
            dx[t, :, :HIDDEN], dx[t, :, HIDDEN : 2 * HIDDEN], dx[t, :, 2 * HIDDEN :] = dr, dz, dc
            du = np.concatenate((dr, dz, dc * r), 1)
            grads["U"] += before.T @ du
            carry = d * z + du @ p["U"].T
            if resets[t].any():
                carry *= (~resets[t])[:, None]
        flat_dx = dx.reshape(-1, 3 * HIDDEN)
        ids = inputs.ravel()
        grads["b"] += np.ones(len(flat_dx), np.float32) @ flat_dx
        grads["Wx"] += p["E"][ids].T @ flat_dx
        de = flat_dx @ p["Wx"].T
        grads["E"] += np.stack([np.bincount(ids, de[:, j], minlength=len(p["E"])) for j in range(EMBED)], 1)
        return last, {"sum": lp.sum(), "n": len(flat), "grads": grads}


class Streams:
    """Documents laid end to end in streams of about the same length, the longest stream first."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs = docs
        sizes = np.array([len(d) for d in docs])
        many = max(1, min(STREAMS, len(docs)))
        heap, own = [(0, s) for s in range(many)], [[] for _ in range(many)]
        for i in np.argsort(-sizes, kind="stable").tolist():
            total, s = heapq.heappop(heap)
            own[s].append(i)
            heapq.heappush(heap, (total + int(sizes[i]), s))
        own.sort(key=lambda s: -int(sizes[s].sum()))
        self.order = [i for s in own for i in s]
        self.lengths = np.array([sizes[s].sum() for s in own])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.targets = np.concatenate([docs[i] for i in self.order])
        self.doc_begins = np.cumsum(sizes[self.order]) - sizes[self.order]
        self.resets = np.zeros(len(self.targets), bool)
        self.resets[self.doc_begins] = True
        self.inputs = np.concatenate(([END], self.targets[:-1]))
        self.inputs[self.doc_begins] = END

    def windows(self):
        """(flat places, valid) of each window, steps x streams that are not over."""
        t, longest = 0, int(self.lengths[0])
        while t < longest:
            n = int(np.searchsorted(-self.lengths, -t, "left"))
            step = np.arange(t, min(t + WINDOW, longest))[:, None]
            valid = step < self.lengths[:n]
            yield np.minimum(self.begins[:n] + step, len(self.targets) - 1), valid
            t += WINDOW


def score_documents(model: GatedModel, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document's model tokens; the state goes on from window to window."""
    if not docs:
        return np.zeros(0)
    s, p = Streams(docs), model.view()
    places = model.place[s.targets]
    lp = np.zeros(len(s.targets))
    h = np.zeros((len(s.lengths), HIDDEN), np.float32)
    for at, valid in s.windows():
        n = at.shape[1]
        hs, h, _ = model.recur(p, s.inputs[at], s.resets[at], h[:n], False)
        flat = at[valid]
        lp[flat] = model.output(p, hs[valid], places[flat])[0]
    out = np.empty(len(docs))
    out[s.order] = np.add.reduceat(lp, s.doc_begins) / np.log(10)
    return out


def train_documents(model: GatedModel, docs: list[np.ndarray], state: np.ndarray, rate: float = 0.15) -> int:
    """One pass of truncated backpropagation (Adagrad) over the documents; returns the tokens used. `state` is kept by the caller."""
    s, p = Streams(docs), model.view()
    places = model.place[s.targets]
    h = np.zeros((len(s.lengths), HIDDEN), np.float32)
    for at, valid in s.windows():
        n = at.shape[1]
        h, got = model.learn(p, s.inputs[at], s.resets[at], places[at], valid, h[:n])
        g = np.concatenate([x.ravel() for x in got["grads"].values()]) / max(got["n"], 64)
        state += g * g
        model.theta -= rate * g / (np.sqrt(state) + 1e-6)
    return len(s.targets)


class Lookup:
    def __init__(self, stats: Statistics):
        self.get = {w: i + 2 for i, w in enumerate(stats.words)}.get
        self.model_size = stats.model_size

    def ids(self, words: list[bytes]) -> np.ndarray:
        """0 for words beyond the dictionary; model ids are 2 and up."""
        return np.fromiter(map(self.get, words, repeat(0)), np.int32, len(words))

    def model_ids(self, ids: np.ndarray) -> np.ndarray:
        return np.append(np.where((ids < 2) | (ids >= self.model_size), RARE, ids), END)


def train(docs: DataFrame, stats: Statistics, text_col: str = "text", split: Column | None = None, rounds: int = 2) -> GatedModel:
    """Each round trains on its part of the rows (split, a number from 0 to rounds - 1) and averages by tokens."""
    spark = docs.sparkSession
    model = GatedModel(stats.model_counts())
    if split is None:
        split = F.pmod(F.xxhash64(text_col), F.lit(rounds))
    shared_stats = spark.sparkContext.broadcast(stats)
    for k in range(rounds):
        start = spark.sparkContext.broadcast(model.theta)

        def run(batches, start=start):
            own_stats = shared_stats.value
            own, lookup = GatedModel(own_stats.model_counts()), Lookup(own_stats)
            own.theta[:] = start.value
            state, part, size, used = np.full_like(own.theta, 1e-3), [], 0, 0
            for b in batches:
                for t in b.column(0):
                    part.append(lookup.model_ids(lookup.ids(words_of(t.as_py()))))
                    size += len(part[-1])
                    if size >= LAID_OUT:
                        used += train_documents(own, part, state)
                        part, size = [], 0
            if part:
                used += train_documents(own, part, state)
            if used:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([used], pa.int64()), pa.array([(own.theta - start.value).tobytes()], pa.binary())], names=["slot", "n", "delta"])

        moved = _tree(docs.where(split == k).select(text_col).mapInArrow(run, "slot int, n long, delta binary")).collect()
        total = sum(r.n for r in moved)
        if total:
            model.theta = (model.theta + sum(np.frombuffer(r.delta, np.float32) * (r.n / total) for r in moved)).astype(np.float32)
    return model


def _tree(deltas: DataFrame, fan: int = 16) -> DataFrame:
    """Token-weighted means of the rows, level by level in groups of `fan` slots, until at most `fan` rows are left."""

    def mean(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        out = None
        for k, d in zip(n, table.column("delta"), strict=True):
            one = np.frombuffer(d.as_py(), np.float32) * np.float64(k / n.sum())
            out = one if out is None else out + one
        return pa.table({"slot": pa.array([table.column("slot")[0].as_py() // fan], pa.int32()), "n": [int(n.sum())], "delta": [out.astype(np.float32).tobytes()]})

    slots = deltas.rdd.getNumPartitions()
    while slots > fan:
        deltas = deltas.groupBy(F.floor(F.col("slot") / fan)).applyInArrow(mean, "slot int, n long, delta binary")
        slots = -(-slots // fan)
    return deltas


def score(docs: DataFrame, counts: DataFrame, stats: Statistics, model: GatedModel, columns: list[str], text_col: str = "text") -> DataFrame:
    """Per row: the given columns, n_tokens, n_known, base_score (smoothed unigram) and score (the model), both log10.

    Workers hold the counts of the dictionary. A row's other words go out with their numbers, meet the counts in a
    join, and return to their row by its number; rows are told apart by that number, so repeated ids stay apart.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((stats, model))
    kept = docs.select(*columns, F.col(text_col).alias("_text"))
    own_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    names = ["word", "rid", "n", *columns, "n_tokens", "n_known", "base", "model"]

    def run(batches):
        from collections import Counter

        own_stats, own = shared.value
        lookup = Lookup(own_stats)
        weight = np.concatenate(([0.0, 0.0], np.log10(own_stats.counts + 1.0)))
        end_weight, end_known = np.log10(own_stats.end_count + 1.0), int(own_stats.end_count > 0)
        pid, serial = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            texts, at = b.column(len(columns)), 0
            while at < b.num_rows:
                first, size, docs_, plain, open_ = at, 0, [], [], []
                while at < b.num_rows and size < LAID_OUT:
                    ws = words_of(texts[at].as_py())
                    ids = lookup.ids(ws)
                    missing = np.flatnonzero(ids == 0)
                    open_.append(Counter([ws[i] for i in missing.tolist()]))
                    docs_.append(lookup.model_ids(ids))
                    rare = (ids >= own_stats.model_size)
                    w = weight[ids]
                    plain.append((len(ids) + 1, len(ids) - len(missing) + end_known, w.sum() + end_weight, w[rare].sum(), int(rare.sum()) + len(missing)))
                    size += len(docs_[-1])
                    at += 1
                n_tokens, n_known, base, rare_sum, n_rare = (np.array(c) for c in zip(*plain, strict=True))
                model_score = score_documents(own, docs_) + rare_sum - n_rare * np.log10(own_stats.rare_total)
                rid = pid + serial + np.arange(len(docs_))
                serial += len(docs_)
                yield pa.RecordBatch.from_arrays([pa.array([b" %d" % r for r in rid.tolist()], pa.binary()), pa.array(rid), pa.array(np.zeros(len(rid), np.int32)), *(b.column(i).slice(first, at - first) for i in range(len(columns))), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base - n_tokens * np.log10(own_stats.base_total)), pa.array(model_score)], names=names)
                words = [(w, r, k) for r, c in zip(rid.tolist(), open_, strict=True) for w, k in c.items()]
                if words:
                    ws, rs, ks = zip(*words, strict=True)
                    n = len(words)
                    yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array(rs, pa.int64()), pa.array(ks, pa.int32()), *(pa.nulls(n, b.column(i).type) for i in range(len(columns))), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names=names)

    rows = kept.mapInArrow(run, f"word binary, rid long, n int, {own_schema}, n_tokens long, n_known long, base double, model double")
    others = counts.where((F.length("word") > 0) & ((F.col("n") < stats.threshold) | (F.length("word") > LONGEST))).select("word", F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    added = F.sum(F.col("n") * F.log10(c + 1))
    # a doc's columns stand in one of its rows alone
    return (
        rows.join(others, "word", "left")
        .groupBy("rid")
        .agg(*(F.max(x).alias(x) for x in columns), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"), (F.max("base") + added).alias("base_score"), (F.max("model") + added).alias("score"))
        .drop("rid")
    )


def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out and score all: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts count as empty: the end token alone. Without any training rows all scores rest on the smoothing.
    """
    learning = docs.where(~held_out).select(text_col)
    counts = settle(count_tokens(learning, text_col))
    stats = statistics(counts)
    model = train(learning, stats, text_col)
    scored = score(docs.select(F.col(id_col), held_out.alias("held_out"), text_col), counts, stats, model, [id_col, "held_out"], text_col)
    return scored.select(id_col, "held_out", "n_tokens", "n_known", F.lit(stats.n).cast("long").alias("train_tokens"), "base_score", "score")
