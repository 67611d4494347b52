"""Order MinHash fingerprints, in DataFrame functions alone.

A text is a sequence of words, long words cut every LONG characters. Each k-mer of neighbouring words carries its
occurrence number, so repeated k-mers differ. The hash range is cut into `bins`; each bin takes the two smallest k-mers
from its start on (around the end of the range, where it or the next ones have none of their own), puts them in text
order, and hashes the pair. Two texts agree in a bin when the same k-mers are smallest there in the same order, so moved
or edited text lowers the likeness, however short the texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = 16


def fingerprints(docs: DataFrame, texts: dict[str, str], k: int = 2, bins: int = 64) -> DataFrame:
    """docs with one more column per entry of texts (output -> text column): array<bigint>, one per bin (its number above 48 bits of hash).

    Null and empty texts, and texts of white space alone, have an empty array. A text of fewer than k words has one
    k-mer of all its words; a text of one k-mer has that one in every bin.
    """
    out = docs
    for name, text in texts.items():
        out = _one(out, name, text, k, bins)
    return out


def _one(docs: DataFrame, name: str, text: str, k: int, bins: int) -> DataFrame:
    keep = [F.col(c) for c in docs.columns]
    kind = "array<struct<h:bigint,i:int>>"
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % LONG), 0)
    df = docs.withColumn("_w", words)
    n = F.size("_w")
    grams = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(k))))).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", "_w")))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, grams.alias("_g"))
    df = df.select(*keep, F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("h"), i.alias("i")))).alias("_s"), (F.size(F.array_distinct("_g")) < F.size("_g")).alias("_twice"))
    # occurrence numbers: within the sorted k-mers a run of equals counts up from its start
    heads = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.coalesce(F.get("_s", i - 1)["h"] != F.get("_s", i)["h"], F.lit(True)))
    df = df.select(*keep, "_s", "_twice", F.when(F.col("_twice"), heads).alias("_heads"))
    end = lambda r: F.coalesce(F.get("_heads", r + 1), F.size("_s")) - 1
    numbered = F.flatten(F.transform("_heads", lambda a, r: F.transform(F.slice("_s", a + 1, end(r) - a + 1), lambda x, j: F.struct(F.when(j == 0, x["h"]).otherwise(F.xxhash64(x["h"], j)).alias("h"), x["i"].alias("i")))))
    df = df.select(*keep, F.when(F.col("_twice"), F.sort_array(numbered)).otherwise(F.col("_s")).cast(kind).alias("_s"))
    # bins are ranges of the hash, so each lies together; its first two are the smallest
    shift = 64 - (bins.bit_length() - 1)
    bin_of = lambda x: F.shiftright(x["h"], shift).cast("int") + bins // 2
    first = F.filter("_s", lambda x, p: F.coalesce(bin_of(F.get("_s", p - 2)) != bin_of(x), F.lit(True)))
    df = df.select(*keep, first.alias("_f"))
    mask = F.lit((1 << 48) - 1)
    # a bin's pair is its first k-mer, or the first one after it, with the k-mer that follows that one
    after = lambda p: F.coalesce(F.get("_f", p + 1), F.get("_f", F.lit(0)))
    pair = lambda x, y: F.when(F.size("_f") < 2, F.xxhash64(x["h"])).when(y["i"] > x["i"], F.xxhash64(x["h"], y["h"])).otherwise(F.xxhash64(y["h"], x["h"]))
    before = lambda p: F.coalesce(bin_of(F.get("_f", p - 1)), F.lit(-1))
    heads = F.filter(F.transform("_f", lambda x, p: F.when(before(p) != bin_of(x), F.struct((before(p) + 1).alias("a"), bin_of(x).alias("z"), pair(x, after(p)).bitwiseAND(mask).alias("h")))), lambda r: r.isNotNull())
    df = df.select(*keep, heads.alias("_f"))
    runs = F.when(F.size("_f") > 0, F.concat("_f", F.array(F.struct((F.element_at("_f", -1)["z"] + 1).alias("a"), F.lit(bins - 1).alias("z"), F.get("_f", F.lit(0))["h"].alias("h"))))).otherwise(F.col("_f"))
    entry = lambda b, h: F.shiftleft(b.cast("long"), 48).bitwiseOR(h)
    filled = F.transform(F.filter(runs, lambda r: r["a"] <= r["z"]), lambda r: F.transform(F.sequence(r["a"], r["z"]), lambda b: entry(b, r["h"])))
    return df.select(*keep, F.flatten(filled).alias(name))


def as_text(fingerprint: Column) -> Column:
    """The entries in hexadecimal, joined by blanks; the empty fingerprint is the empty string."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among the bins that either fills; 1 for two empty fingerprints, null if one is null."""
    both = F.size(F.array_intersect(a, b))
    bin_of = lambda x: F.shiftright(x, 48)
    bins = F.size(F.array_union(F.transform(a, bin_of), F.transform(b, bin_of)))
    return F.when(bins > 0, both / bins).when(bins == 0, F.lit(1.0))


#: Ranges of the order, at most, and sampled values for each bound between them.
RANGES, SAMPLED = 1 << 16, 32
_STEP = 256


def _longs(values: list[int | None]) -> Column:
    """An array of longs as one literal, however many there are."""
    return F.from_json(F.lit(str(["null" if v is None else v for v in values]).replace("'", "")), "array<bigint>")


def with_next(docs: DataFrame, order: str, columns: list[str], per_bucket: int = 1000, most: int = RANGES) -> DataFrame:
    """docs with `next_<c>` of the following row in descending order of the integer column `order` (nulls last).

    Ties are in order of the columns; the last row is followed by the first, a lone row by itself. Rows are cut into
    ranges of about per_bucket rows (at most `most` ranges, whose bounds come from a sample of the order by hash). The
    first rows of a range are also sent, marked as copies, to the range before it, where a window finds them behind its
    last row: one shuffle, and no task sees all rows.
    """
    n = docs.count()
    if not n:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    cuts = min(most, -(-n // per_bucket))
    # descending without overflow; null for null
    ranged = docs.withColumn("_o", F.bitwise_not(F.col(order).cast("long")))
    share = min(1 << 20, -(-(SAMPLED * cuts << 20) // n))
    sample = sorted(r["_o"] for r in ranged.where(F.col("_o").isNotNull() & (F.pmod(F.xxhash64("_o"), F.lit(1 << 20)) < share)).select("_o").distinct().collect()) if cuts > 1 else []
    bounds = sorted({sample[i * len(sample) // cuts] for i in range(1, cuts)}) if sample else []
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("_o")))
    # first among every 256th bound, then among those up to the next
    coarse = below(_longs(bounds[_STEP - 1 :: _STEP])) * _STEP
    ranged = ranged.withColumn("_bucket", F.when(F.col("_o").isNull(), len(bounds) + 1).otherwise(coarse + below(F.slice(_longs(bounds), coarse + 1, _STEP))) if bounds else F.when(F.col("_o").isNull(), 1).otherwise(0))
    firsts = sorted((r["_bucket"], r["o"]) for r in ranged.groupBy("_bucket").agg(F.min("_o").alias("o")).collect())
    first_of = [None] * (len(bounds) + 2)
    before = [0] * (len(bounds) + 2)
    for k, (b, o) in enumerate(firsts):
        first_of[b], before[b] = o, firsts[k - 1][0]
    head = F.col("_o").eqNullSafe(F.get(_longs(first_of), F.col("_bucket")))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy"))
    copy = F.struct(F.get(_longs(before), F.col("_bucket")).cast("int").alias("b"), F.lit(1).alias("copy"))
    sent = ranged.withColumn("_to", F.explode(F.when(head, F.array(own, copy)).otherwise(F.array(own))))
    w = Window.partitionBy("_to.b").orderBy(F.col("_to.copy"), F.asc_nulls_last("_o"), *(F.asc_nulls_first(c) for c in columns))
    looked = sent.withColumn("_next", F.lead(F.struct(*columns)).over(w)).where(F.col("_to.copy") == 0)
    return looked.select(*docs.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, bins: int = 64) -> DataFrame:
    """Per row: id, n_chars, edited_text, fingerprint, edited_fingerprint, next_fingerprint.

    The edited text has the last third of the code points (rounded down) replaced by as many from the start of the
    next text in descending order of the id, or by all of it if it is shorter. Null texts count as empty.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = fingerprints(base, {"fingerprint": "_t"}, k, bins)
    pairs = with_next(base, "_id", ["_t", "fingerprint"])
    n = F.length("_t")
    cut = F.floor(n / 3).cast("int")
    pairs = pairs.select(F.col("_id").alias(id_col), n.cast("long").alias("n_chars"), "fingerprint", F.col("next_fingerprint"), F.concat(F.substring(F.col("_t"), F.lit(1), n - cut), F.substring(F.col("next__t"), F.lit(1), cut)).alias("edited_text"))
    return fingerprints(pairs, {"edited_fingerprint": "edited_text"}, k, bins)
