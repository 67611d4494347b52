"""N-gram Jaccard join by vertical partitioning, and the components of its links.

A document is the set of its 5-word shingles (64-bit hashes). All shingles have one global order: rare first, by counts
over the whole corpus in 2^18 bins. The order is cut into fragments of equal mass; a pair's overlap is counted in each
fragment on its own and summed.

Documents with equal sets form classes, and classes alone are compared. Two linked sets share a shingle among the first
n - ceil(0.8 n) + 1 of each, so candidates meet in the buckets of those. To find the components no group needs all of
its pairs: each class is first compared with the first class of one of its buckets, then one pair for each two
components that a bucket's first class joins, and only classes of a bucket that are then still in different components,
and not all in the largest, meet each other, through exact filters on lengths, positions and parity bitmaps. No bucket
is capped and no pair that could join two components is skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, components, discard, frugal, rows, settle, small

WORDS = 5
BINS = 18
FRAGMENTS = 4
#: 64-bit words of a parity bitmap, at least, and of the one that is compared inside buckets.
PARITY, FOLDED = 16, 4
#: From this size on a bucket is taken for a family of copies, and all its classes are compared with its first.
FAMILY = 8

_hash = xxhash.xxh3_64_intdigest
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle, no words none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash, words), np.uint64, n)
    k = min(n, WORDS)
    x = h[: n - k + 1] * _ODD[0]
    for j in range(1, k):
        x += h[j : n - k + 1 + j] * _ODD[j]
    if n < WORDS:
        x += np.uint64(n)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return np.unique(x)


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BINS)).astype(np.int64)


def bin_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many documents' shingles fall in each of 2^BINS hash ranges, over all documents."""

    @frugal
    def run(batches):
        total = np.zeros(1 << BINS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                found = [shingles(t.as_py()) for t in b.column(0).slice(at, 500)]
                total += np.bincount(_bin(np.concatenate(found)), minlength=1 << BINS)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["k", "n"])

    got = docs.select(text_col).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BINS, np.int64)
    out[got.k.to_numpy()] = got.n.to_numpy()
    return out


def pivots(counts: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Bin counts at which the global order is cut, so that each fragment has about the same number of shingles."""
    order = np.sort(counts)
    mass = np.cumsum(order)
    return order[np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments)]


def parity(h: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of shingles falls on them: a power of two, and at least two for a shingle.

    Of two bitmaps the longer one becomes as long as the other when its halves are XORed.
    """
    size = max(64 * PARITY, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64 * PARITY
    bits = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


SIGNATURE = "key long, d long, n int, set binary, prefix array<long>, parity array<long>, folded array<long>"


def signatures(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, key (for its text), d (unique), n, set (128-bit name of the shingle set), prefix (rare first), parity, folded."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("_text"))
    kind = kept.schema[0].dataType.simpleString()

    @frugal
    def run(batches):
        rare, pid, serial = shared.value, TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, name, prefix, odd, folded = [], [], [], [], []
                for t in part.column(2):
                    h = shingles(t.as_py())
                    k = len(h)
                    n.append(k)
                    name.append(xxhash.xxh3_128_digest(h.tobytes()) if k else None)
                    first = np.argsort(rare[_bin(h)], kind="stable")[: k + (-4 * k // 5) + 1 if k else 0]
                    prefix.append(h[first].view(np.int64))
                    odd.append(parity(h))
                    folded.append(np.bitwise_xor.reduce(odd[-1].reshape(-1, FOLDED), axis=0))
                # an odd factor modulo 2^64 keeps row numbers apart and makes their order a random one
                d = (np.arange(pid + serial, pid + serial + part.num_rows, dtype=np.uint64) * _ODD[0]).view(np.int64)
                serial += part.num_rows
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d), pa.array(n, pa.int32()), pa.array(name, pa.binary()), pa.array(prefix, longs), pa.array(odd, longs), pa.array(folded, longs)], names=["id", "key", "d", "n", "set", "prefix", "parity", "folded"])

    return kept.mapInArrow(run, f"id {kind}, {SIGNATURE}")


def segments(docs: DataFrame, counts: np.ndarray, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, fragment, part): the shingles of the rows with the given (key, set, d), cut by the global order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((counts, pivots(counts)))
    texts = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("_text")).join(wanted, "key").select("_text", "d", "set")

    @frugal
    def run(batches):
        rare, cuts = shared.value
        for b in batches:
            d, fragment, part = [], [], []
            for t, own, name in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = shingles(t.as_py())
                if xxhash.xxh3_128_digest(h.tobytes()) != name:
                    continue  # another row whose key has the same hash
                at = np.searchsorted(cuts, rare[_bin(h)], "left")
                for f in np.unique(at).tolist():
                    d.append(own), fragment.append(f), part.append(h[at == f].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(fragment, pa.int32()), pa.array(part, pa.list_(pa.int64()))], names=["d", "fragment", "part"])

    return texts.mapInArrow(run, "d long, fragment int, part array<long>")


def _apart(a: Column, b: Column) -> Column:
    """Odd bits of two parity bitmaps of which one is at most twice as long as the other: no more than the sets differ by."""
    size = F.least(F.size(a), F.size(b))
    one = lambda p, j: F.when(F.size(p) > size, F.get(p, j).bitwiseXOR(F.get(p, j + size))).otherwise(F.get(p, j))
    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda s, j: s + F.bit_count(one(a, j).bitwiseXOR(one(b, j))))


def _may_link(na: Column, nb: Column, pa_: Column, pb: Column) -> Column:
    """100 * overlap >= 80 * union means 9 * difference <= na + nb; lengths and parity bitmaps bound the difference from below."""
    return (9 * F.abs(na - nb) <= na + nb) & (9 * _apart(pa_, pb) <= na + nb)


def _reach(na: Column, nb: Column, ia: Column, ib: Column) -> Column:
    """Lengths allow a link, and so do the places of the shingle if it is the first in order that both sets hold.

    Two linked sets meet this at their first shared shingle, whose bucket has them both; in other buckets they may fail.
    """
    return (9 * F.abs(na - nb) <= na + nb) & (9 * F.least(na - ia, nb - ib) >= 4 * (na + nb))


class Join:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.id, self.text = docs, id_col, text_col
        self.counts = bin_counts(docs, text_col)
        self.every = settle(signatures(docs, self.counts, id_col, text_col))
        rep = F.min(F.struct("d", "key", "n"))
        sets = self.every.where("n > 0").groupBy("set").agg(F.min("id").alias("first"), F.count("*").alias("rows"), rep.alias("r"))
        #: One row for each set: set, first (the smallest id), rows, and d, key and n of one of its rows.
        self.sets = settle(sets.select("set", "first", "rows", "r.*"), several=F.count_if(F.col("rows") > 1))
        #: Whether rows of one id and text, and so of one key, occur.
        self.twice = self.every.select("key").distinct().count() < rows(self.every)

    def classes(self, *columns: str) -> DataFrame:
        """The given columns of one row of each set; only the names of sets that have several rows are joined."""
        several = self.sets.where("rows > 1").select("set", F.col("d").alias("_own"))
        if self.sets.settled["several"] <= BROADCAST:
            several = F.broadcast(several)
        full = self.every.where("n > 0").select("set", *{*columns, "d"} - {"set"})
        return full.join(several, "set", "left").where("_own IS NULL OR _own = d").select(*columns)

    def buckets(self) -> DataFrame:
        """(t, d, n, i, c, lead, nl, il): classes by shared prefix shingle, its place in the prefix, and the bucket's first class.

        Shingles that stand in one prefix alone go out by their counts; sums and joins do all, so a bucket may be of any size.
        """
        every = self.classes("d", "n", "prefix").select("d", "n", F.posexplode("prefix").alias("i", "t"))
        counted = every.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
        met = settle(every.join(counted, "t").select("t", "d", "n", "i", "c"))
        # another first class in each bucket of a family, so that its members meet many of each other
        first = settle(met.groupBy("t").agg(F.min(F.struct(F.xxhash64("d", "t").alias("h"), "d", "n", "i")).alias("f")).select("t", F.col("f.d").alias("lead"), F.col("f.n").alias("nl"), F.col("f.i").alias("il")))
        out = settle(met.join(first, "t").select("t", "d", "n", "i", "c", "lead", "nl", "il"))
        discard(met, first)
        return out

    def likely(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb) of the pairs (a, b) of classes that lengths and parity bitmaps let link, settled."""
        pairs = settle(pairs)
        # the classes of the pairs alone travel, not all that there are
        own = settle(self.classes("d", "n", "parity").join(_ends(pairs), "d", "left_semi"))
        a, b = (own.select(F.col("d").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
        out = settle(pairs.join(a, "a").join(b, "b").where(_may_link(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"))).select("a", "b", "na", "nb"))
        discard(own, pairs)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, na, nb), settled, those that link, with their overlap, settled: partial counts by fragment, summed."""
        wanted = self.sets.select("key", "set", "d").join(_ends(pairs), "d", "left_semi")
        if 2 * rows(pairs) <= BROADCAST:
            wanted = F.broadcast(wanted)
        parts = segments(self.docs, self.counts, wanted, self.id, self.text)
        cut = settle(parts.dropDuplicates(["d", "fragment"]) if self.twice else parts)
        left = cut.select(F.col("d").alias("a"), "fragment", F.col("part").alias("x"))
        right = cut.select(F.col("d").alias("b"), "fragment", F.col("part").alias("y"))
        partial = left.join(small(pairs), "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("o"))
        out = settle(partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap")).where("9 * overlap >= 4 * (na + nb)").select("a", "b", "overlap"))
        discard(cut)
        return out

    def pairs(self) -> DataFrame:
        """(a, b, overlap) of every pair of classes that link, whatever their components: as many rows as there are links."""
        every = self.classes("d", "n", "prefix").select("d", "n", F.posexplode("prefix").alias("i", "t"))
        x, y = (every.select("t", *(F.col(c).alias(f"{c}{s}") for c in ("d", "n", "i"))) for s in "xy")
        on = (F.col("dx") > F.col("dy")) & _reach(F.col("nx"), F.col("ny"), F.col("ix"), F.col("iy"))
        met = x.join(y.withColumnRenamed("t", "ty"), (F.col("t") == F.col("ty")) & on)
        return self.verified(self.likely(met.select(F.col("dx").alias("a"), F.col("dy").alias("b")).distinct()))

    def labels(self) -> DataFrame:
        """(d, label) of the classes that have a link."""
        at = self.buckets()
        near = _reach(F.col("n"), F.col("nl"), F.col("i"), F.col("il")) | ((F.col("c") >= FAMILY) & (9 * F.abs(F.col("n") - F.col("nl")) <= F.col("n") + F.col("nl")))
        stars = at.where(F.col("d") != F.col("lead")).where(near).select(F.col("d").alias("a"), F.col("lead").alias("b")).distinct()
        stars = settle(stars)
        one = self.likely(stars.groupBy("a").agg(F.min("b").alias("b")))
        links = self.verified(one).select("a", "b")
        label = components(links)
        # of the other pairs with a first class only those that may join two components are looked at
        stars, old = self.likely(_between(stars, label).select("a", "b")), stars
        links, label = self.joined(links, label, stars, True)
        rest = settle(self.likely(self.open_pairs(at, label)).union(stars))
        links, label = self.joined(links, label, rest, True)
        links, label = self.joined(links, label, rest, False)
        discard(at, old, stars, rest, one, links)
        return label

    def joined(self, links: DataFrame, label: DataFrame, pairs: DataFrame, one: bool) -> tuple[DataFrame, DataFrame]:
        """(links, label) when those of the pairs that are between different components have been checked, or one for each two components."""
        rest = _between(pairs, label)
        if one:
            rest = rest.groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.min(F.struct("a", "b", "na", "nb")).alias("p")).select("p.*")
        rest = settle(rest.select("a", "b", "na", "nb"))
        found = self.verified(rest) if rows(rest) else rest
        if rows(found):
            links, old = settle(links.union(found.select("a", "b"))), (links, label)
            label = components(links)
            discard(*old)
        discard(rest, found)
        return links, label

    def open_pairs(self, at: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs of a bucket, without its first class, whose components differ. In a family one of the two is not in the largest component."""
        few = at.where((F.col("c") > 2) & (F.col("c") < FAMILY) & (F.col("d") != F.col("lead")))
        x, y = (few.select("t", *(F.col(c).alias(f"{c}{s}") for c in ("d", "n", "i"))) for s in "xy")
        on = (F.col("dx") < F.col("dy")) & _reach(F.col("nx"), F.col("ny"), F.col("ix"), F.col("iy"))
        met = x.join(y.withColumnRenamed("t", "ty"), (F.col("t") == F.col("ty")) & on).select(F.col("dy").alias("a"), F.col("dx").alias("b")).distinct()
        return _between(met, label).select("a", "b").union(self.family_pairs(at, label)).distinct()

    def family_pairs(self, at: DataFrame, label: DataFrame) -> DataFrame:
        labelled = at.where((F.col("c") >= FAMILY) & (F.col("d") != F.col("lead"))).join(label, "d", "left").select("t", "d", "n", "i", F.coalesce("label", "d").alias("l"))
        labelled = settle(labelled)
        sizes = labelled.groupBy("t", "l").agg(F.count("*").alias("k"))
        largest = sizes.groupBy("t").agg(F.max(F.struct("k", "l")).alias("top"), F.count("*").alias("many")).where("many > 1").select("t", F.col("top.l").alias("top"))
        open_ = settle(labelled.join(settle(largest), "t").join(self.classes("d", "folded"), "d"))
        x, y = (part.select("t", *(F.col(c).alias(f"{c}{s}") for c in ("d", "n", "i", "l", "folded", "top"))) for s, part in (("x", open_.where("l <> top")), ("y", open_)))
        on = (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("topy")) | (F.col("dx") < F.col("dy"))) & _reach(F.col("nx"), F.col("ny"), F.col("ix"), F.col("iy")) & _may_link(F.col("nx"), F.col("ny"), F.col("foldedx"), F.col("foldedy"))
        return x.join(y.withColumnRenamed("t", "ty"), (F.col("t") == F.col("ty")) & on).select(F.greatest("dx", "dy").alias("a"), F.least("dx", "dy").alias("b"))

    def result(self) -> DataFrame:
        """Per row: id, n_shingles, component_id (the smallest id of the component; its own id for an empty set)."""
        label = self.labels()
        named = settle(label.join(self.sets.select("set", "d", "first"), "d").select("set", "label", "first"))
        least = settle(named.groupBy("label").agg(F.min("first").alias("least")))
        linked = named.join(small(least), "label").select("set", "least")
        by_set = settle(self.sets.select("set", "first").join(linked, "set", "left").select("set", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")))
        members = self.every.select("id", "n", "set")
        full = members.where("n > 0").join(by_set, "set").select(F.col("id").alias(self.id), F.col("n").cast("long").alias("n_shingles"), "component_id")
        empty = members.where("n = 0").select(F.col("id").alias(self.id), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
        out = settle(full.union(empty))
        discard(label, named, least, by_set)
        self.close()
        return out

    def close(self) -> None:
        discard(self.every, self.sets)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link between different shingle sets: a, b (the smallest id of each set) and overlap.

    Rows with equal sets are one class and give one end of a link. `near_duplicates` gives the components of these
    links without looking at all of them; here a family of k near copies gives all of its pairs.
    """
    join = Join(docs, id_col, text_col)
    a, b = (join.sets.select(F.col("d").alias(x), F.col("first").alias(f"_{x}")) for x in "ab")
    return join.pairs().join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "overlap")


def _between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with la and lb."""
    a, b = (label.select(F.col("d").alias(x), F.col("label").alias(f"_{x}")) for x in "ab")
    named = pairs.join(a, "a", "left").join(b, "b", "left")
    return named.select(*pairs.columns, F.coalesce("_a", "a").alias("la"), F.coalesce("_b", "b").alias("lb")).where("la <> lb")


def _ends(pairs: DataFrame) -> DataFrame:
    """(d): the classes of settled pairs, marked for broadcast if they are few."""
    ids = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct()
    return F.broadcast(ids) if 2 * rows(pairs) <= BROADCAST else ids


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id. Null and empty texts have no shingles and are linked with nothing.

    Rows with the same id and different texts are compared as documents of their own; a null id is larger than any
    other and stands as component_id only where no other id is in the component. Other columns of docs are not read.
    """
    return Join(docs, id_col, text_col).result()
