"""Cleaning of texts, names and model output as column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import trimmed

#: Full-width letters, digits and signs, and what they become (fixed values).
_WIDE = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A))) + "－＋／＊（）—　"
_NARROW = "".join(chr(c - 0xFEE0) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A))) + "-+/*()- "
_HAN = r"[\u4e00-\u9fa5]"
_LATIN = r"[a-zA-Z0-9()\[\]@#$%!&*\-=+_]"
#: Pairs of quotation marks that are taken off when they enclose a name and do not stand inside it (fixed values).
QUOTES = [('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》")]
#: Characters of which an entity type may have none (fixed values).
FORBIDDEN = "'()<>|/\\"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f uses it: nested uses would double the expression each time."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def sanitized(c: Column, entities: bool = True) -> Column:
    """Trimmed, with character references decoded and control characters and non-characters left out."""
    t = _unescaped(trimmed(c)) if entities else trimmed(c)
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"[\uFFFE\uFFFF]", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def _unquoted(a: str, z: str) -> Callable[[Column], Column]:
    def run(c: Column) -> Column:
        inner = F.substring(c, F.lit(2), F.length(c) - 2)
        return F.when((F.length(c) >= 2) & c.startswith(a) & c.endswith(z) & ~inner.contains(a) & ~inner.contains(z), inner).otherwise(c)

    return run


def normalized_name(c: Column, inner_quotes: bool = False) -> Column:
    """Paragraph and line-break tags out, full-width signs narrow, no blanks beside Han characters, no enclosing quotes.

    With inner_quotes also curly quotes, quotes beside Han characters and no-break blanks go. Numbers of one or two
    digits, and digits with dots shorter than six characters, become empty.
    """
    t = F.regexp_replace(F.regexp_replace(c, r"(?i)</?p\s*>|<p/>", ""), r"(?i)</?br\s*>|<br/>", "")
    t = F.translate(t, _WIDE, _NARROW)
    t = F.regexp_replace(t, rf"(?<={_HAN})\s+(?={_HAN}|{_LATIN})|(?<={_LATIN})\s+(?={_HAN})", "")
    for a, z in QUOTES:
        t = bound(t, _unquoted(a, z))
    if inner_quotes:
        t = F.regexp_replace(t, "[“”‘’]", "")
        t = F.regexp_replace(t, rf"['\"]+(?={_HAN})|(?<={_HAN})['\"]+", "")
        t = F.regexp_replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), r"(?<=[^\d])\u202F", " ")
    short = lambda x: ((F.length(x) < 3) & x.rlike(r"^[0-9]+$")) | ((F.length(x) < 6) & x.rlike(r"^[0-9.]*\.[0-9.]*$"))
    return bound(trimmed(t), lambda x: F.when(short(x), "").otherwise(x))


def cleaned(c: Column, inner_quotes: bool = False, entities: bool = True) -> Column:
    return normalized_name(sanitized(c, entities), inner_quotes)


def shortened(c: Column, chars: int = 256, size: int = 512) -> Column:
    """The longest start of at most `chars` characters and `size` UTF-8 bytes."""
    size_of = lambda x: F.aggregate(
        F.split(x, ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")),
        lambda s, y: F.struct(F.when(s["b"] + F.octet_length(y) <= size, s["n"] + F.length(y)).otherwise(s["n"]).alias("n"), (s["b"] + F.octet_length(y)).alias("b")),
        lambda s: s["n"],
    )
    return bound(F.substring(c, 1, chars), lambda x: F.when(F.octet_length(x) <= size, x).otherwise(F.substring(x, F.lit(1), size_of(x))))


def _damaged(core: str) -> list[str]:
    """Damaged forms of the field mark <|core|>, in the order in which they are mended (fixed values)."""
    k = re.escape(core)
    return [
        rf"<\|{k}\|*?{k}\|>",
        rf"<\|\\{k}\|>",
        r"<\|+>",
        rf"<.?\|{k}\|.?>",
        rf"<\|?{k}\|?>",
        rf"<[^|]{k}\|>|<\|{k}[^|]>",
        rf"<\|{k}\|+(?!>)",
        rf"<\|{k}:(?!>)",
        rf"<\|+{k}>",
        r"<\|\|(?!>)",
        rf"(?<!<)\|{k}\|>",
        rf"<\|{k}\|>\|",
        rf"\|\|{k}\|\|",
    ]


def mended(c: Column, core: str = "#") -> Column:
    """Damaged field marks become <|core|>."""
    for pattern in _damaged(core):
        c = F.regexp_replace(c, pattern, f"<|{core}|>".replace("\\", "\\\\").replace("$", "\\$"))
    return c


def unfenced(c: Column) -> Column:
    """The inside of a code fence that encloses the text."""
    pattern = r"(?s)^\s*```(?:json|JSON)?\s*\n?(.*?)\n?\s*```\s*$"
    return bound(c, lambda x: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(x))


def without_marks(c: Column, tags: tuple[str, ...] = ("drawing", "table", "equation")) -> Column:
    """Texts of tables and formulas without their tags, drawings as a whole out."""
    c = F.regexp_replace(c, rf"(?is)<{tags[0]}\b[^>]*/>|<{tags[0]}\b[^>]*>.*?</{tags[0]}>", "")
    return F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(tags[1:])})\b[^>]*>", "")


def heading_path(parents: Column, heading: Column) -> Column:
    """Trimmed headings without empty ones, joined by arrows."""
    every = F.concat(F.coalesce(parents, F.array().cast("array<string>")), F.array(heading))
    return F.array_join(F.filter(F.transform(every, trimmed), lambda x: F.coalesce(x, F.lit("")) != ""), " → ")


def base_name(path: Column, unknown: str = "unknown_source") -> Column:
    """The last part of a path of either kind of slash; a missing or empty one is the unknown source."""
    name = F.regexp_extract(trimmed(path), r"([^/\\]+)[/\\]*$", 1)
    return F.when(F.coalesce(name, F.lit("")) == "", unknown).otherwise(name)


def is_number(c: Column) -> Column:
    return c.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")
