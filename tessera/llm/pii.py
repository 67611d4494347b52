"""Personal data: base expressions, and identifiers that bootstrapped context patterns find beside them.

Base spans seed the search. The words around a span make its context patterns; patterns and the values that stand
in them form a graph. In each round a pattern is as good as the share of its values that are known, and a value that
stands in patterns which many different known values support, and hardly any unknown value contradicts, becomes known
itself. So new values bring in new patterns, until nothing changes. The patterns that are good in the end mark the
values of the same form as identifiers of their kind.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, settle, small

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit run is entered at its start alone: that finds the same leftmost matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_EDGE = " \n\t\r\x0b\x0c"
_RIGHT = re.compile(rf"[^{_EDGE}]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        after = at + 1
        if m := _DOMAIN.match(text, after):
            lo = at
            while lo > done and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                out.append((lo, m.end()))
                done = after = m.end()
        at = text.find("@", after)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted, in code points; kinds by their place in KINDS."""
    out = [(a, 0, z) for a, z in _emails(text)]
    if text.count(".") > 2:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def _fits(value: str) -> list[int]:
    """Kinds whose form a value that is no base span may have."""
    digits = sum(c in "0123456789" for c in value)
    rest = value.translate(_NO_DIGITS)
    out = []
    if "@" in value[1:-1]:
        out.append(0)
    if digits >= 4 and rest in ("...", ":::", "......"):
        out.append(1)
    if 12 <= digits <= 19 and not rest.strip("-"):
        out.append(2)
    if 7 <= digits <= 15 and not rest.strip("+-.()/"):
        out.append(3)
    return out


_WRAP = ".,;:!?\"'()[]<>"
_NO_DIGITS = str.maketrans("", "", "0123456789")


def _tokens(text: str, taken: list[tuple[int, int, int]]):
    """Blank-separated tokens with a digit or @ that touch no base span, without punctuation at their ends."""
    k, at = 0, 0
    for m in iter(lambda: _MARK.search(text, at), None):
        lo = m.start()
        while lo > at and text[lo - 1] not in _EDGE:
            lo -= 1
        end = _RIGHT.match(text, m.start()).end()
        at = end
        while k < len(taken) and taken[k][2] <= lo:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        token = text[lo:end].rstrip(_WRAP)
        left = len(token) - len(token.lstrip(_WRAP))
        token = token[left:]
        if token:
            yield lo + left, lo + left + len(token), token


def _words(text: str, at: int, n: int, back: bool) -> list[str]:
    """The n whole words before (or from) a place, fewer at the text's ends; the stretch that is read doubles until they are in it."""
    reach = 48
    while True:
        part = text[max(0, at - reach) : at] if back else text[at : at + reach]
        words = part.lower().split()
        if len(words) > n or (reach >= at if back else at + reach >= len(text)):
            return (words[-n:] if back else words[:n]) if words else []
        reach *= 2


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns around a span: the two words before it, and the word before with the word after; digits read as 0."""
    left, right = _words(text, start, 2, True), _words(text, end, 1, False)
    squash = lambda w: re.sub(r"[0-9]+", "0", w)
    out = [f"{' '.join(map(squash, left))} _"] if left else []
    if left and right:
        out.append(f"{squash(left[-1])} _ {squash(right[0])}")
    return out


FOUND = "rid long{own}, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, seen array<struct<kind:int,start:int,end:int,value:string,seed:int,patterns:array<string>>>"
_SEEN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seed", pa.int32()), ("patterns", pa.list_(pa.string()))]))


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def find(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """Per row: a row number, the given columns as c0, c1, ..., counts and digest of the base spans, and the occurrences for the graph."""
    names = [f"c{k}" for k in range(len(columns))]
    # a text that is among the columns is sent once
    place = columns.index(text_col) if text_col in columns else len(columns)
    own = [F.col(c).alias(x) for c, x in zip(columns, names, strict=True)]
    kept = docs.select(*own, *([F.col(text_col).alias("_text")] if place == len(columns) else []))

    @frugal
    def run(batches):
        pid, n = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                counts, lines, shas, seen = [], [], [], []
                for t in part.column(place):
                    text = t.as_py() or ""
                    spans = base_spans(text)
                    counts.append([sum(k == j for _, k, _ in spans) for j in range(4)])
                    lines.append(_line(spans))
                    shas.append(hashlib.sha256(lines[-1].encode()).hexdigest())
                    here = [(k, a, z, text[a:z], 1, contexts(text, a, z)) for a, k, z in spans]
                    here += [(k, a, z, w, 0, contexts(text, a, z)) for a, z, w in _tokens(text, spans) for k in _fits(w)]
                    seen.append([dict(zip(("kind", "start", "end", "value", "seed", "patterns"), x, strict=True)) for x in here])
                rid = [pid + n + i for i in range(part.num_rows)]
                n += part.num_rows
                c = list(zip(*counts, strict=True)) if counts else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), *(part.column(i) for i in range(len(columns))), *(pa.array(x, pa.int64()) for x in c), pa.array(lines, pa.string()), pa.array(shas, pa.string()), pa.array(seen, _SEEN)], names=["rid", *names, "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "seen"])

    own = "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept.schema[: len(columns)])
    return kept.mapInArrow(run, FOUND.format(own=own))


def confident(found: DataFrame, rounds: int = 8, support: int = 4, least: float = 0.8) -> DataFrame:
    """(kind, pattern, score), settled, of the patterns that at least `support` different known values support with score >= least.

    The score is the share of known values among all values of a pattern, half a value added to the whole. In each
    round the values of such patterns become known, at most `rounds` times; it ends when a round adds none.
    """
    edges = settle(found.select(F.explode("seen").alias("s")).select("s.kind", "s.value", "s.seed", F.explode("s.patterns").alias("pattern")).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("known")))
    good, before = None, -1
    for _ in range(rounds):
        scored = edges.groupBy("kind", "pattern").agg(F.sum("known").alias("k"), (F.sum("known") / (F.count("*") + F.lit(0.5))).alias("score"))
        if good is not None:
            discard(good)
        good = settle(scored.where((F.col("k") >= support) & (F.col("score") >= least)).select("kind", "pattern", "score"))
        known = edges.agg(F.sum("known")).first()[0]
        if known == before:
            break
        before = known
        promoted = settle(edges.where("known = 0").join(small(good.select("kind", "pattern"), good), ["kind", "pattern"], "left_semi").select("kind", "value").distinct())
        new = settle(edges.join(small(promoted.withColumn("_new", F.lit(1)), promoted), ["kind", "value"], "left").select("kind", "pattern", "value", F.greatest("known", F.coalesce("_new", F.lit(0))).alias("known")))
        discard(edges, promoted)
        edges = new
    discard(edges)
    return good


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(rid, more): the spans that a confident pattern marks beside the base spans, as struct(start, kind, end)."""
    open_ = found.select("rid", F.explode(F.filter("seen", lambda s: s["seed"] == 0)).alias("s")).select("rid", "s.kind", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    marked = open_.join(small(patterns.select("kind", "pattern"), patterns), ["kind", "pattern"], "left_semi")
    # one kind for a place: the first as listed
    one = marked.groupBy("rid", "start", "end").agg(F.min("kind").alias("kind"))
    return one.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))


def _as_spans(line: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    part = lambda x, i: F.split(x, ":")[i]
    return F.transform(F.filter(F.split(line, ","), lambda x: x != ""), lambda x: F.struct(part(x, 1).cast("int").alias("start"), (F.array_position(names, part(x, 0)) - 1).cast("int").alias("kind"), part(x, 2).cast("int").alias("end")))


def detect(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """Per row: the given columns, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans (all of them).

    A null text counts as empty: no spans, and the digest of the empty text. Repeated rows give repeated results, an
    empty table none. Columns of docs may have any names; those that are asked for come first.
    """
    found = settle(find(docs, columns, text_col))
    patterns = confident(found)
    more = settle(discovered(found, patterns))
    discard(patterns)
    names = F.array(*map(F.lit, KINDS))
    line = F.array_join(F.transform(F.sort_array(F.concat(_as_spans(F.col("base")), F.col("more"))), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    own = [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]
    return found.join(small(more), "rid", "left").select(*own, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.when(F.col("more").isNull(), F.col("base")).otherwise(line).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets; null texts stay null.

    Overlapping spans are replaced as one, under the name of the first. Columns may have any names, repeated rows stay
    repeated, and an empty table stays empty.
    """
    columns = docs.columns
    found = detect(docs, columns, text_col)
    # by place, for the columns of docs may be named as those of detect are
    spans = found.toDF(*(f"c{k}" for k in range(len(found.columns))))
    place, last = columns.index(text_col), len(found.columns) - 1

    @frugal
    def run(batches):
        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = [masked(t, s) for t, s in zip(b.column(place).to_pylist(), b.column(len(columns)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else b.column(i) for i in range(len(columns))], names=columns)

    return spans.select(*(f"c{k}" for k in range(len(columns))), f"c{last}").mapInArrow(run, docs.schema)


def masked(text: str | None, line: str) -> str | None:
    if text is None or not line:
        return text
    out, done = [], 0
    for kind, a, z in sorted(((k, int(a), int(z)) for k, a, z in (x.split(":") for x in line.split(","))), key=lambda x: (x[1], KINDS.index(x[0]))):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, z)
    return "".join(out) + text[done:]
