"""Queries of the chunkers and of the condensing of descriptions; folds over a text are recursive in their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import chunk_id
from ..operators import chunkers, chunks, condense
from .queries import TRIM, _t, query

_WINDOW = "substr(part, (s + 1)::INT, 80)"


def _md5():
    return F.md5(F.col("content").cast("binary")).alias("content_md5")


@query(
    "WITH p AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM (SELECT doc_id, string_split(text, '. ') AS parts FROM documents)), "
    "w AS (SELECT doc_id, i, part, unnest(CASE WHEN length(part) <= 80 THEN [0] ELSE range(0, length(part), 65) END) AS s FROM p) "
    f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1)::INT AS chunk_order, length({_WINDOW})::INT AS tokens, md5({TRIM.format(_WINDOW)}) AS content_md5 FROM w"
)
def chunk_split_windows(spark, sf_dir):
    return chunks.split_windows(_t(spark, sf_dir, "documents"), "doc_id", "text", ". ", 80, 15).select("doc_id", "chunk_order", "tokens", _md5())


@query(
    "WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS s FROM documents) "
    "SELECT doc_id, (s // 450)::INT AS chunk_order, length(substr(text, (s + 1)::INT, 500))::INT AS tokens, md5(substr(text, (s + 1)::INT, 500)) AS content_md5 FROM w WHERE s = 0 OR s + 50 < length(text)"
)
def chunk_to_end(spark, sf_dir):
    cut = lambda t: [t[a:z] for a, z in chunkers.windows_to_end(len(t or ""), 500, 50)]
    return chunkers.apply(_t(spark, sf_dir, "documents"), "doc_id", "text", cut).select("doc_id", "chunk_order", "tokens", _md5())


_UNITS = "string_split(regexp_replace(regexp_replace({0}, '\n\n', chr(1), 'g'), '([。！？；.!?])', '\\1' || chr(1), 'g'), chr(1))"


@query(
    f"WITH u AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, {TRIM.format('unnest(parts)')} AS content FROM (SELECT doc_id, {_UNITS.format('text')} AS parts FROM documents)) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS unit_order, md5(content) AS content_md5 FROM u WHERE content <> ''"
)
def sentence_units(spark, sf_dir):
    return chunks.units(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "unit_order", _md5())


_CUT = TRIM.format("substr(text, (k * 1100 + 1)::INT, 1200)")


@query(
    f"WITH RECURSIVE c AS (SELECT doc_id, k, {_CUT} AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1099) // 1100)) AS k FROM documents)), "
    f"parts AS (SELECT doc_id, k, {_UNITS.format('content')} AS parts FROM c WHERE length(content) > 300), "
    f"raw AS (SELECT doc_id, k, generate_subscripts(parts, 1) AS i, {TRIM.format('unnest(parts)')} AS u FROM parts), "
    "units AS MATERIALIZED (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS i, u, length(u) AS n FROM raw WHERE u <> ''), "
    "fold AS (SELECT doc_id, k, i, n, 1 AS g, n AS used FROM units WHERE i = 1 UNION ALL "
    "SELECT x.doc_id, x.k, x.i, x.n, f.g + (f.used + x.n > 300)::INT, CASE WHEN f.used + x.n > 300 THEN x.n ELSE f.used + x.n END FROM fold f JOIN units x ON x.doc_id = f.doc_id AND x.k = f.k AND x.i = f.i + 1), "
    "own AS (SELECT doc_id, k, g, string_agg(u, chr(10) || chr(10) ORDER BY i) AS t, max(n) AS longest FROM fold JOIN units USING (doc_id, k, i, n) GROUP BY ALL), "
    f"cut AS (SELECT doc_id, k, g, s, {TRIM.format('CASE WHEN longest > 300 THEN substr(t, (s + 1)::INT, 300) ELSE t END')} AS t FROM (SELECT *, unnest(CASE WHEN longest > 300 THEN range(0, longest, 300) ELSE [0] END) AS s FROM own)), "
    "named AS (SELECT doc_id, k, t, row_number() OVER (PARTITION BY doc_id, k ORDER BY g, s) AS part, count(*) OVER (PARTITION BY doc_id, k) AS total FROM cut WHERE t <> '') "
    "SELECT doc_id, doc_id || '-chunk-' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INT, '0') || '-s' || lpad(part::VARCHAR, greatest(2, length(part::VARCHAR))::INT, '0') AS chunk_id, length(t)::INT AS tokens, part::INT AS split_part, total::INT AS split_total, md5(t) AS content_md5 FROM named "
    "UNION ALL SELECT doc_id, doc_id || '-chunk-' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INT, '0'), length(content)::INT, NULL, NULL, md5(content) FROM c WHERE length(content) BETWEEN 1 AND 300"
)
def chunk_hard_fallback(spark, sf_dir):
    cut = chunks.windows(_t(spark, sf_dir, "documents"), "doc_id", "text", 1200, 100)
    cut = cut.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_order")))
    return chunks.within_limit(cut, "doc_id", 300).select("doc_id", "chunk_id", "tokens", "split_part", "split_total", _md5())


@query(
    "SELECT p_brand || '/' || p_size % 10 AS entity, CASE WHEN count(*) = 1 OR (count(*) < 8 AND sum(length(p_name)) < 1200) THEN string_agg(p_name, '<SEP>' ORDER BY p_partkey) ELSE count(*) || ': ' || max(p_name) END AS description, "
    "NOT (count(*) = 1 OR (count(*) < 8 AND sum(length(p_name)) < 1200)) AS used FROM part GROUP BY ALL"
)
def condense_descriptions(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size") % 10).alias("entity"), "p_partkey", F.col("p_name").alias("description"))
    return condense.condensed(p, "entity", "p_partkey", "description", lambda texts: f"{len(texts)}: {max(texts)}", context=1 << 30)
