"""Model output to entity and relation records: delimited lines, JSON, and keyword payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import FORBIDDEN, bound, cleaned, is_number, mended, shortened, unfenced
from ..functions.text import trimmed, without_thoughts

MARK, END = "<|#|>", "<|COMPLETE|>"


def _split(c: Column, *marks: str) -> Column:
    """Trimmed, non-empty parts between any of the literal marks."""
    return F.filter(F.transform(F.split(c, "|".join(map(re.escape, marks))), trimmed), lambda x: x != "")


def records(output: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, ord, fields): one row a record. Records that follow a field mark instead of a line break are cut there, damaged marks mended.

    A record with five fields and the prefix of an entity is a relation.
    """
    prefixed = lambda x, kind: F.when(x.startswith("entity") | x.startswith("relation"), x).otherwise(F.concat(F.lit(kind + MARK), x))
    lines = _split(text, "\n", END, END.lower())
    ents = F.flatten(F.transform(lines, lambda x: F.transform(_split(x, f"{MARK}entity{MARK}"), lambda y: prefixed(y, "entity"))))
    both = F.flatten(F.transform(ents, lambda x: F.transform(_split(x, f"{MARK}relationship{MARK}", f"{MARK}relation{MARK}"), lambda y: prefixed(y, "relation"))))
    rows = output.select(*keys, F.posexplode(both).alias("ord", "_record"))
    rows = rows.select(*keys, "ord", _split(mended(F.col("_record")), MARK).alias("fields"))
    # cut here, so that the mended fields are worked out once for all uses below
    rows = rows.select(*keys, "ord", F.explode(F.array("fields")).alias("fields"))
    head = F.lower(F.get("fields", F.lit(0)))
    wrong = (F.size("fields") == 5) & head.contains("entity") & ~head.contains("relation")
    return rows.withColumn("fields", F.when(wrong, F.concat(F.array(F.lit("relation")), F.slice("fields", 2, 4))).otherwise(F.col("fields")))


def _field(i: int) -> Column:
    return F.get("fields", F.lit(i))


def entities(recs: DataFrame, keys: list[str], unescape: bool = True) -> DataFrame:
    """(keys, ord, name, kind, description) of the valid entity records: four fields, none empty, a kind without forbidden signs."""
    c = lambda i, inner: cleaned(_field(i), inner, unescape)
    rows = recs.where((F.size("fields") == 4) & _field(0).contains("entity")).select(*keys, "ord", c(1, True).alias("name"), c(2, True).alias("kind"), c(3, False).alias("description"))
    return valid_entities(rows)


def valid_entities(rows: DataFrame) -> DataFrame:
    first = F.get(F.filter(F.transform(F.split("kind", ","), trimmed), lambda x: x != ""), F.lit(0))
    allowed = ~F.col("kind").rlike("[" + re.escape(FORBIDDEN) + "]")
    rows = rows.where((F.col("name") != "") & allowed & (F.col("description") != "")).withColumn("kind", F.lower(F.replace(first, F.lit(" "), F.lit(""))))
    return rows.where("kind IS NOT NULL").withColumn("name", shortened(F.col("name")))


def relations(recs: DataFrame, keys: list[str], unescape: bool = True) -> DataFrame:
    """(keys, ord, src, tgt, keywords, description, weight) of the valid relation records: five fields, two different ends, a description.

    The weight is the last field if that is a number, else 1.
    """
    c = lambda i, inner: cleaned(_field(i), inner, unescape)
    last = F.regexp_replace(_field(4), "^[\"']+|[\"']+$", "")
    rows = recs.where((F.size("fields") == 5) & _field(0).contains("relation")).select(*keys, "ord", c(1, True).alias("src"), c(2, True).alias("tgt"), c(3, True).alias("keywords"), c(4, False).alias("description"), F.when(is_number(last), last.try_cast("double")).otherwise(1.0).alias("weight"))
    return valid_relations(rows)


def valid_relations(rows: DataFrame) -> DataFrame:
    rows = rows.where((F.col("src") != "") & (F.col("tgt") != "") & (F.col("src") != F.col("tgt")) & (F.col("description") != ""))
    return rows.withColumns({"keywords": F.translate("keywords", "，", ","), "src": shortened(F.col("src")), "tgt": shortened(F.col("tgt"))})


def repaired(text: str | None) -> str | None:
    """JSON from nearly-JSON: single quotes, missing quotes of keys, trailing commas, missing ends; None if that is not enough."""
    if text is None or not re.search(r"[{\[]", text):
        return None
    for attempt in (text, _repair(text)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _repair(text: str) -> str:
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=0)
    out, closers, inside = [], [], ""
    i = start
    while i < len(text):
        ch = text[i]
        if inside:
            if ch == "\\":
                out.append(text[i : i + 2])
                i += 2
                continue
            if ch == inside:
                out.append('"')
                inside = ""
            else:
                out.append('\\"' if ch == '"' else "\\n" if ch == "\n" else ch)
        elif ch in "\"'":
            inside = ch
            out.append('"')
        elif ch in "{[":
            closers.append("}" if ch == "{" else "]")
            out.append(ch)
        elif ch in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            while closers and closers[-1] != ch:
                out.append(closers.pop())
            if closers:
                out.append(closers.pop())
            if not closers:
                break
        elif m := re.compile(r"[A-Za-z_]\w*").match(text, i):
            word = m.group()
            known = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null"}
            out.append(known.get(word, json.dumps(word)))
            i = m.end()
            continue
        else:
            out.append(ch)
        i += 1
    if inside:
        out.append('"')
    while closers:
        while out and (out[-1].isspace() or out[-1] == ","):
            out.pop()
        out.append(closers.pop())
    return "".join(out)


def as_json(c: Column, repair: Callable[[str | None], str | None] | None = repaired) -> Column:
    """The text without a code fence, mended where it is no JSON; without a repair function such texts are as they are."""
    inner = unfenced(c)
    if repair is None:
        return inner

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(repair)

    return run(inner)


_JSON = "struct<entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,keywords:string,description:string>>>"


def from_json(output: DataFrame, keys: list[str], text: Column, unescape: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of model output in JSON, with the same checks as for lines; what cannot be read gives none."""
    parsed = output.select(*keys, F.from_json(as_json(text), _JSON).alias("_j"))
    part = lambda c, inner: cleaned(F.coalesce(c, F.lit("")), inner, unescape)
    e = parsed.select(*keys, F.posexplode("_j.entities").alias("ord", "_e")).select(*keys, "ord", part(F.col("_e.name"), True).alias("name"), part(F.col("_e.type"), True).alias("kind"), part(F.col("_e.description"), False).alias("description"))
    r = parsed.select(*keys, F.posexplode("_j.relationships").alias("ord", "_r")).select(*keys, "ord", part(F.col("_r.source"), True).alias("src"), part(F.col("_r.target"), True).alias("tgt"), part(F.col("_r.keywords"), True).alias("keywords"), part(F.col("_r.description"), False).alias("description"), F.lit(1.0).alias("weight"))
    return valid_entities(e), valid_relations(r)


def keywords(c: Column, field: str, repair: Callable[[str | None], str | None] | None = repaired) -> Column:
    """Trimmed, non-empty keywords of one field of a payload: a list as it is, a string cut at line breaks, commas and semicolons."""
    value = F.get_json_object(as_json(without_thoughts(c), repair), f"$.{field}")
    one = bound(value, lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.split(v, r"[\n,;]+")))
    return F.coalesce(F.filter(F.transform(one, trimmed), lambda x: x != ""), F.array().cast("array<string>"))


def fallback_keywords(high: Column, low: Column, question: Column, limit: int = 50) -> Column:
    """The low keywords; without any keyword a question shorter than `limit` stands for itself, a longer one has none."""
    none = (F.size(high) == 0) & (F.size(low) == 0)
    return F.when(none & (F.length(question) < limit), F.array(question)).otherwise(low)
