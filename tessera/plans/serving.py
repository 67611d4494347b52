"""Queries of sources, status, cache and context, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context
from ..operators.ranking import first_by, top_by
from ..sources import files
from .queries import _status, _t, query


@query("WITH j AS (SELECT p_brand, p_partkey, '{\"p_name\":\"' || p_name || '\",\"p_type\":\"' || p_type || '\"}' AS line FROM part), b AS (SELECT *, sum(length(line)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS r FROM j) SELECT p_brand, string_agg(line, chr(10) ORDER BY p_partkey) AS context FROM b WHERE r <= 400 GROUP BY p_brand")
def context_string(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_type")
    return context.joined(context.within_tokens(p, ["p_brand"], [F.col("p_partkey")], context.as_json("p_name", "p_type"), 400), ["p_brand"], "p_partkey")


@query("SELECT p_brand, p_partkey FROM (SELECT *, sum(length('{\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}')) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS r FROM part) WHERE r <= 300")
def truncated_json(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return context.within_tokens(p, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], context.as_json("p_name", "p_size"), 300).select("p_brand", "p_partkey")


@query("SELECT conv_id, greatest(30000 - 1000 - sum(length(text)) - max(length(role)) - 200, 0)::BIGINT AS budget FROM conversations GROUP BY conv_id")
def dynamic_budget(spark, sf_dir):
    g = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("kg"), F.max(F.length("role")).alias("q"))
    return g.select("conv_id", context.chunk_budget(F.lit(30000), F.lit(1000), F.col("kg"), F.col("q")).cast("long").alias("budget"))


@query("WITH c AS (SELECT lang, CASE WHEN source = 'src1' THEN 'unknown_source' ELSE source END AS file_path, doc_id FROM documents), g AS (SELECT lang, file_path, count(*) AS n, min(doc_id) AS f FROM c GROUP BY ALL) SELECT lang, file_path, n, CASE WHEN file_path = 'unknown_source' THEN '' ELSE (row_number() OVER (PARTITION BY lang, file_path = 'unknown_source' ORDER BY n DESC, f))::VARCHAR END AS reference_id FROM g")
def references_per_question(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("lang", "doc_id", F.when(F.col("source") == "src1", "unknown_source").otherwise(F.col("source")).alias("file_path"))
    return context.references(d, ["lang"], "file_path", "doc_id")


@query("SELECT p_partkey, p_name AS entity_name, CASE WHEN p_size > 25 THEN p_type ELSE 'UNKNOWN' END AS entity_type, 'unknown_source' AS file_path, '' AS created_at FROM part")
def result_projection(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_type")).alias("kind"))
    return p.select("p_partkey", F.col("p_name").alias("entity_name"), F.coalesce("kind", F.lit("UNKNOWN")).alias("entity_type"), F.lit("unknown_source").alias("file_path"), F.lit("").alias("created_at"))


OWN = "own AS (SELECT label AS q, vec_id, dense_rank() OVER (PARTITION BY label ORDER BY vec_id % 3) - 1 AS owner, row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) AS place, embedding FROM embeddings WHERE label % 2 = 0), s AS (SELECT own.*, round(list_cosine_similarity(own.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS s, max(owner) OVER (PARTITION BY q) + 1 AS n FROM own, (SELECT embedding FROM embeddings WHERE vec_id = 0) e)"


@query(f"WITH {OWN} SELECT q, vec_id, 'similar' AS picked FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, owner, place) AS r FROM s) WHERE r <= floor(5 * n / 2)")
def similarity_pick(spark, sf_dir):
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "embeddings")
    own = e.where("label % 2 = 0").select(F.col("label").alias("q"), "vec_id", "embedding", (F.dense_rank().over(Window.partitionBy("label").orderBy(F.col("vec_id") % 3)) - 1).alias("owner"), F.row_number().over(Window.partitionBy("label", F.col("vec_id") % 3).orderBy("vec_id")).alias("place"))
    asked = own.join(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("question"))), F.lit(True))
    return context.similar_chunks(asked, ["q"], "owner", "place", F.col("question"), F.col("embedding"), 5).select("q", "vec_id", "picked")


@query("SELECT DISTINCT 's' || a.l_suppkey AS owner, a.l_orderkey AS chunk FROM lineitem a WHERE a.l_suppkey % 2 = 0 AND a.l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 2 = 0)")
def relation_chunks_only(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    held = l.where("l_partkey % 2 = 0").select("l_orderkey").distinct()
    return l.where("l_suppkey % 2 = 0").join(held, "l_orderkey", "left_anti").select(F.concat(F.lit("s"), "l_suppkey").alias("owner"), F.col("l_orderkey").alias("chunk")).distinct()


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.count("*").alias("n"))


@query("WITH g AS (SELECT l_orderkey AS q, l_partkey AS d FROM lineitem WHERE l_linenumber <= 2), f AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS d FROM lineitem WHERE l_quantity > 25), r AS (SELECT g.q, count(DISTINCT g.d) AS n, count(DISTINCT f.d) AS hits FROM g LEFT JOIN f ON f.q = g.q AND f.d = g.d GROUP BY g.q) SELECT count(*) AS questions, round(avg(hits / n), 6) AS recall, count_if(hits = n) AS whole, count_if(hits = 0) AS none FROM r")
def retrieval_metrics(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    gold = l.where("l_linenumber <= 2").select("l_orderkey", "l_partkey").distinct()
    found = l.where("l_quantity > 25").select("l_orderkey", "l_partkey").distinct().withColumn("_hit", F.lit(1))
    r = gold.join(found, ["l_orderkey", "l_partkey"], "left").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))
    return r.agg(F.count("*").alias("questions"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"), F.count_if(F.col("hits") == F.col("n")).alias("whole"), F.count_if(F.col("hits") == 0).alias("none"))


@query("SELECT doc_id, source || '/' || doc_id || '.' || lang AS file_path, CASE WHEN doc_id = f THEN 'pending' ELSE 'failed' END AS status, CASE WHEN doc_id = f THEN 'doc-' || md5(text) ELSE 'dup-' || md5(doc_id || '-track-' || source || '/' || doc_id || '.' || lang) END AS id FROM (SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents)")
def enqueue(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), "doc_id", F.lit("."), "lang").alias("file_path"), F.md5(F.col("text").cast("binary")).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("f"))
    own = F.col("doc_id") == F.col("f")
    dup = F.concat(F.lit("dup-"), F.md5(F.concat("doc_id", F.lit("-track-"), "file_path").cast("binary")))
    return d.join(first, "h").select("doc_id", "file_path", F.when(own, "pending").otherwise("failed").alias("status"), F.when(own, F.concat(F.lit("doc-"), "h")).otherwise(dup).alias("id"))


STATUS_OF = "(SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'processed' ELSE 'processing' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"


@query(f"SELECT doc_id, CASE WHEN status IN ('processing', 'failed') THEN 'pending' ELSE status END AS status, status IN ('processing', 'failed') AS reset FROM {STATUS_OF}")
def resume_documents(spark, sf_dir):
    again = F.col("status").isin("processing", "failed")
    return _status(spark, sf_dir).select("doc_id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), again.alias("reset"))


@query(f"SELECT t.total, p.doc_id FROM (SELECT count(*) AS total FROM {STATUS_OF} WHERE status = 'failed') t LEFT JOIN (SELECT doc_id FROM {STATUS_OF} WHERE status = 'failed' ORDER BY doc_id LIMIT 10 OFFSET 0) p ON TRUE")
def page_with_total(spark, sf_dir):
    s = _status(spark, sf_dir).where("status = 'failed'").select("doc_id")
    return s.agg(F.count("*").alias("total")).join(F.broadcast(s.orderBy("doc_id").limit(10)), F.lit(True), "left")


@query("SELECT 'default:extract:' || md5('model|json|' || text) AS key, count(*) AS asked, min(doc_id) AS first_id FROM documents GROUP BY text")
def cache_keys(spark, sf_dir):
    key = F.concat(F.lit("default:extract:"), F.md5(F.concat(F.lit("model|json|"), "text").cast("binary")))
    return _t(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.count("*").alias("asked"), F.min("doc_id").alias("first_id"))


@query("SELECT mode, kind, count(*) AS n, count(DISTINCT hash) AS keys FROM (SELECT CASE user_id % 2 WHEN 0 THEN 'default' ELSE 'local' END AS mode, event_type AS kind, md5(event_id::VARCHAR || ':x') AS hash FROM events) WHERE mode <> 'local' OR kind <> 'error' GROUP BY ALL")
def cache_clean(spark, sf_dir):
    key = F.concat_ws(":", F.when(F.col("user_id") % 2 == 0, "default").otherwise("local"), "event_type", F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":x")).cast("binary")))
    part = F.split(key, ":", 3)
    e = _t(spark, sf_dir, "events").select(part[0].alias("mode"), part[1].alias("kind"), part[2].alias("hash"))
    return e.where("mode <> 'local' OR kind <> 'error'").groupBy("mode", "kind").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("keys"))


@query("SELECT event_type AS chunk, array_to_string(list_sort(list(DISTINCT user_id::VARCHAR)), ',') AS cached FROM events GROUP BY event_type")
def cache_links(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",").alias("cached"))


@query("SELECT p_partkey, chunk, pos::INT AS pos FROM (SELECT p_partkey, unnest([p_brand, p_type, p_name]) AS chunk, unnest([0, 1, 2]) AS pos FROM part)")
def packed_sources(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws("<SEP>", "p_brand", "p_type", "p_name").alias("s"))
    return p.select("p_partkey", F.posexplode(F.split("s", "<SEP>")).alias("pos", "chunk")).select("p_partkey", "chunk", "pos")


@query("SELECT k, count(*) AS n FROM (SELECT DISTINCT regexp_extract(props, '\"k\":\\s*(\\d+)', 1)::INT AS k, event_type FROM events) GROUP BY k")
def unique_contexts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("k"), "event_type").dropDuplicates(["k", "event_type"])
    return e.groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'mineru' WHEN 2 THEN 'legacy' WHEN 3 THEN NULL ELSE 'docling' END AS engine, CASE WHEN doc_id % 5 = 0 THEN 'iet' ELSE '' END AS options FROM documents")
def parser_routes(spark, sf_dir):
    k = F.col("doc_id") % 5
    ends = F.when(k == 0, ".[native-iet].docx").when(k == 1, ".pdf").when(k == 2, ".[mineru].TXT").when(k == 3, ".exe").otherwise(".pptx")
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a"), "doc_id", ends).alias("path"))
    return files.routed(d, "path", [(r"\.docx$", "docling"), (r"^b", "legacy")]).select("doc_id", "engine", F.when(F.col("engine") == "native", F.col("options")).otherwise("").alias("options"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def joined_block_files(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "content").otherwise("meta").alias("type"), F.col("text").alias("content"))
    return files.joined_blocks(c, ["conv_id"], "turn")


@query("SELECT conv_id, turn, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) - 2)::BIGINT AS a, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 2)::BIGINT AS z FROM conversations")
def block_spans(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 2).over(w) - 2
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", (end - F.length("text")).alias("a"), end.alias("z"))


@query("SELECT doc_id, k::INT AS k, least(k * 400 + 500, n)::BIGINT AS z FROM (SELECT doc_id, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE ((length(text) - 500 + 399) // 400) + 1 END)) AS k FROM documents WHERE length(text) > 0)")
def rerank_windows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    last = F.ceil(F.greatest(F.col("n") - 500, F.lit(0)) / 400).cast("int")
    return d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("doc_id", "k", F.least(F.col("k") * 400 + 500, F.col("n")).cast("long").alias("z"))


@query("SELECT l_orderkey, l_linenumber, 'E' || n || '/' || place AS trace FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 2")
def chunk_trace(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    top = top_by(l, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], 2, "place")
    n = l.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return top.join(n, "l_partkey").select("l_orderkey", "l_linenumber", context.trace(F.lit("E"), F.col("n"), F.col("place")).alias("trace"))


@query("SELECT a.l_orderkey, a.l_partkey, b.l_quantity AS score FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber WHERE b.l_linenumber IN (1, 3)")
def scores_by_index(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    scores = _t(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 3)").select("l_orderkey", (F.col("l_linenumber") - 1).alias("index"), F.col("l_quantity").alias("score"))
    return l.withColumn("index", F.col("l_linenumber") - 1).join(scores, ["l_orderkey", "index"]).select("l_orderkey", "l_partkey", "score")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 5 END")
def chunk_top_or_top(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("chunk_top_k", F.when(F.col("o_custkey") % 2 == 0, 3)).withColumn("top_k", F.lit(5))
    return top_by(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).where(F.col("rank") <= F.coalesce("chunk_top_k", "top_k")).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def status_transition(spark, sf_dir):
    return first_by(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")
