"""Quality rules by distribution divergence, in DataFrame functions alone.

Each text has two histograms: its characters by class, and its words by a list of common words. Both are held
against the references of some languages by the Jensen-Shannon distance (base 2, so 0 to 1); the nearest language
counts. Texts too short for a histogram are kept on that ground. Two plain rules on words come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rough shares of lower-case letters, upper-case letters, digits, other ASCII signs, characters beyond ASCII and white
#: space, and of common words, in running text of a language (fixed values, in per mille).
REFERENCES = {
    "en": ([790, 25, 5, 20, 2, 158], {"the": 62, "of": 36, "and": 28, "to": 26, "in": 22, "a": 22, "is": 15, "that": 12, "for": 10, "it": 10, "on": 9, "was": 9}),
    "de": ([770, 55, 5, 20, 15, 135], {"der": 35, "die": 34, "und": 30, "in": 18, "den": 13, "zu": 12, "das": 12, "von": 11, "ist": 10, "mit": 10, "des": 9, "nicht": 8}),
    "fr": ([755, 25, 5, 25, 30, 160], {"de": 48, "la": 30, "et": 25, "le": 24, "les": 21, "des": 18, "en": 15, "un": 12, "que": 11, "est": 11, "du": 11, "pour": 8}),
    "es": ([770, 25, 5, 20, 20, 160], {"de": 55, "la": 38, "que": 28, "el": 27, "en": 25, "y": 24, "los": 16, "del": 12, "se": 11, "las": 10, "un": 10, "por": 9}),
}

_WS = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
#: The classes in the order in which they are taken out of a text, most frequent first, and their places in REFERENCES.
_CLASSES = [(0, "[a-z]+"), (5, f"{_WS}+"), (1, "[A-Z]+"), (2, "[0-9]+"), (3, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"), (4, r"[^\x00-\x7F]+")]


def _js(counts: Column, total: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance (root of the divergence, base 2) of an array of counts, with their sum, to reference shares."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(F.transform(counts, lambda c: c / F.greatest(total, F.lit(1))), F.array(*map(F.lit, shares)), lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _char_js and _word_js.

    A null text counts as empty: all counts 0, distances 0. Distances of texts without characters or words are 0.
    """
    common = sorted({w for _, ws in REFERENCES.values() for w in ws})
    text = F.coalesce(F.col(text_col), F.lit(""))
    # each class is taken out of what the ones before it left, so that the later ones read little
    base = docs.withColumn("_r0", text)
    for k, (_, chars) in enumerate(_CLASSES):
        base = base.withColumn(f"_r{k + 1}", F.regexp_replace(f"_r{k}", chars, ""))
        if k == 1:
            base = base.withColumn("_n_symbols", F.length(F.regexp_replace("_r2", r"[^#*$%&|<>]+", "")).cast("long"))
    left = [F.length(f"_r{k}") for k in range(len(_CLASSES) + 1)]
    base = base.select(*docs.columns, F.col("_r0").alias("_text"), "_n_symbols", *((left[k] - left[k + 1]).alias(f"_c{at}") for k, (at, _) in enumerate(_CLASSES)))
    inner = F.btrim("_text", F.lit(_BLANKS))
    base = base.withColumn("_words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{_WS}+")))
    n = F.size("_words")
    # a window is known by the hash of its three words
    grams = F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        *docs.columns,
        n.cast("long").alias("_n_words"),
        (F.length("_text") - F.col("_c5")).cast("long").alias("_word_chars"),
        "_n_symbols",
        grams.alias("_grams"),
        lines.alias("_lines"),
        F.filter("_words", lambda w: (F.octet_length(w) <= max(map(len, common))) & F.lower(w).isin(common)).alias("_common"),
        *(f"_c{i}" for i in range(6)),
    )
    counted = counted.withColumn("_common", F.transform("_common", F.lower))
    # windows found again: sorted by hash and place, a window's equals are its neighbours
    repeats = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.col("_grams")).otherwise(F.slice("_grams", 1, 0))
    counted = counted.withColumn("_placed", F.sort_array(F.transform(repeats, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    same = lambda x, k: F.coalesce(F.get("_placed", k)["g"] == x["g"], F.lit(False))
    again = F.filter("_placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    counted = counted.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    # words covered: each window adds what the one before it leaves uncovered
    covered = F.aggregate(F.transform("_again", lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get("_again", k - 1), F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    # one array of counts, not an expression for each word: generated code beyond 8,000 bytes is never compiled by the JVM
    hits = F.transform(F.array(*map(F.lit, common)), lambda w: F.size("_common") - F.size(F.array_remove("_common", w)))
    counted = counted.select(*docs.columns, "_n_words", "_word_chars", "_n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"), covered.alias("_n_repeat_words"), *(F.col(f"_c{i}") for i in range(6)), hits.alias("_hits"))
    n_words = F.col("_n_words")
    own = {k: [F.get("_hits", F.lit(common.index(w))) for w in ws] for k, (_, ws) in REFERENCES.items()}
    counted = counted.select("*", F.array(*(F.col(f"_c{i}") for i in range(6))).alias("_chars"), sum((F.col(f"_c{i}") for i in range(1, 6)), F.col("_c0")).alias("_total"), *(F.array(*c, (n_words - sum(c[1:], c[0])).cast("int")).alias(f"_ws_{k}") for k, c in own.items()))
    char_js = [_js(F.col("_chars"), F.col("_total"), [c / sum(chars) for c in chars]) for chars, _ in REFERENCES.values()]
    word_js = [_js(F.col(f"_ws_{k}"), n_words, [*(x / 1000 for x in ws.values()), 1 - sum(ws.values()) / 1000]) for k, (_, ws) in REFERENCES.items()]
    return counted.select(*docs.columns, "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", F.when(F.col("_total") > 0, F.least(*char_js)).otherwise(0.0).alias("_char_js"), F.when(n_words > 0, F.least(*word_js)).otherwise(0.0).alias("_word_js"))


def rules(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat: float = 50, min_chars: int = 200, min_histogram: int = 100, max_char_js: float = 0.30, max_word_js: float = 0.55) -> DataFrame:
    """docs with the columns of `measures`, _base_failed and _kept.

    A text fails the base rules with fewer than min_words words, or with more than max_repeat percent of its words in
    repeated windows. The method rejects a text whose characters (from min_chars word characters on) or words (from
    min_histogram words on) are too far from every reference.
    """
    m = measures(docs, text_col)
    failed = (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > max_repeat * F.col("_n_words"))
    far = ((F.col("_word_chars") >= min_chars) & (F.col("_char_js") > max_char_js)) | ((F.col("_n_words") >= min_histogram) & (F.col("_word_js") > max_word_js))
    return m.withColumn("_base_failed", failed).withColumn("_kept", ~failed & ~far)


def _sql_js(counts: list[str], total: str, shares: list[float]) -> str:
    half = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    parts = []
    for c, q in zip(counts, shares, strict=True):
        p, q = f"({c}::DOUBLE / greatest({total}, 1))", f"{q!r}::DOUBLE"
        mid = f"(({p} + {q}) / 2)"
        parts += [half(p, mid), half(q, mid)]
    return f"sqrt(greatest(({' + '.join(parts)}) / 2, 0))"


def sql(table: str = "documents", min_words: int = 50, max_repeat: float = 50, min_chars: int = 200, min_histogram: int = 100, max_char_js: float = 0.30, max_word_js: float = 0.55) -> str:
    """The same verdicts in DuckDB SQL: windows are unnested and counted, and all else is said by lists and patterns."""
    chars = {at: p for at, p in _CLASSES}
    common = sorted({w for _, ws in REFERENCES.values() for w in ws})
    char_js = [_sql_js([f"c{i}" for i in range(6)], "(c0 + c1 + c2 + c3 + c4 + c5)", [c / sum(cs) for c in cs]) for cs, _ in REFERENCES.values()]
    word_js = []
    for _, ws in REFERENCES.values():
        own = [f"hits[{common.index(w) + 1}]" for w in ws]
        word_js.append(_sql_js([*own, f"(n_words - {' - '.join(own)})"], "n_words", [*(x / 1000 for x in ws.values()), 1 - sum(ws.values()) / 1000]))
    names = ", ".join(f"'{w}'" for w in common)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
listed AS (SELECT *, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM listed))),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE k > 1) GROUP BY r),
counted AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    {", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS c{at}" for at, p in sorted(chars.items()))},
    list_transform([{names}], lambda w: len(list_filter(words, lambda x: lower(x) = w))) AS hits
  FROM listed),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    n_words < {min_words} OR 100 * coalesce(repeated.n, 0) > {max_repeat} * n_words AS base_failed,
    least({", ".join(char_js)}) AS char_js, least({", ".join(word_js)}) AS word_js
  FROM counted LEFT JOIN repeated USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((word_chars >= {min_chars} AND char_js > {max_char_js}) OR (n_words >= {min_histogram} AND word_js > {max_word_js})) AS kept
FROM judged"""
