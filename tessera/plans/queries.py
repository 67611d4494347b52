"""One query per operator of the retrieval engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, hashed_id, pair_key, summary, trimmed, without_thoughts
from ..operators import chunks, context, graph, ranking, search, tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Pieces of SQL that several queries share.
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
EDGES = "edges AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY ALL)"
ADJ = EDGES + ", adj AS (SELECT src AS node, tgt AS other FROM edges UNION ALL SELECT tgt, src FROM edges), deg AS (SELECT node, count(*) AS degree FROM adj GROUP BY node)"
STATUS = "status AS (SELECT d.doc_id, d.source, d.n_chars, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'processed' ELSE 'processing' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"
ENTITY = "recs AS (SELECT p_brand AS entity, p_type AS kind, p_name AS description, p_partkey AS ord FROM part)"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("tgt")).agg(F.round(F.sum("l_quantity"), 2).alias("weight"))


def _status(spark, sf_dir):
    own = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.lit(1).alias("has"))
    s = F.when(F.col("has").isNull(), "pending").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "processed").otherwise("processing")
    return _t(spark, sf_dir, "documents").join(own, "doc_id", "left").select("doc_id", "source", "n_chars", s.alias("status"))


def _vectors(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


TOP = "scored AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored WHERE score >= 0.2)"


@query(f"WITH {TOP} SELECT query_id, item_id, score, rank FROM top WHERE rank <= 10")
def naive_topk(spark, sf_dir):
    return search.top_k(*_vectors(spark, sf_dir), 10, 0.2)


@query(f"WITH {TOP} SELECT query_id, count(*) AS n FROM top GROUP BY query_id")
def cosine_threshold(spark, sf_dir):
    return search.matches(*_vectors(spark, sf_dir), 0.2).groupBy("query_id").agg(F.count("*").alias("n"))


@query(f"WITH {TOP}, hit AS (SELECT t.query_id, t.rank, (a.label = b.label)::INT AS hit FROM top t JOIN embeddings a ON a.vec_id = t.query_id JOIN embeddings b ON b.vec_id = t.item_id WHERE rank <= 10 AND query_id <> item_id) SELECT query_id, sum(hit) AS hits, round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS mrr FROM hit GROUP BY query_id")
def recall_mrr(spark, sf_dir):
    top = naive_topk(spark, sf_dir).where("query_id <> item_id")
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label")
    j = top.join(e.toDF("query_id", "la"), "query_id").join(e.toDF("item_id", "lb"), "item_id").withColumn("hit", (F.col("la") == F.col("lb")).cast("int"))
    return j.groupBy("query_id").agg(F.sum("hit").alias("hits"), F.round(F.coalesce(F.lit(1.0) / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


@query("SELECT doc_id, k::INT AS chunk_order, length(substr(text, (k * 1100 + 1)::INT, 1200))::INT AS tokens, md5(" + TRIM.format("substr(text, (k * 1100 + 1)::INT, 1200)") + ") AS content_md5 FROM (SELECT doc_id, text, unnest(range(0, ((length(text) + 1099) // 1100))) AS k FROM documents)")
def chunk_fixed(spark, sf_dir):
    return chunks.windows(_t(spark, sf_dir, "documents"), "doc_id", "text", 1200, 100).select("doc_id", "chunk_order", "tokens", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("SELECT doc_id, chunk_order::INT AS chunk_order, md5(c) AS content_md5 FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS chunk_order, " + TRIM.format("unnest(parts)") + r" AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE c <> ''")
def chunk_split_char(spark, sf_dir):
    return chunks.split_lines(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_order", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("SELECT 'doc-' || md5(text) AS id, count(*) AS n, printf('%s-chunk-%03d', min(doc_id)::VARCHAR, 7) AS chunk FROM documents GROUP BY text")
def doc_ids_md5(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("m")).select(hashed_id("doc-", F.col("text")).alias("id"), "n", chunk_id(F.col("m"), F.lit(7)).alias("chunk"))


@query("SELECT doc_id, first_id, doc_id <> first_id AS is_duplicate FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)")
def doc_dedupe_hash(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return d.join(first, "h").select("doc_id", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_duplicate"))


@query("SELECT pos::INT AS pos, k AS o_orderkey, o_orderstatus FROM (SELECT unnest([7, 3, -1, 1, 2]) AS k, unnest([0, 1, 2, 3, 4]) AS pos) LEFT JOIN orders ON o_orderkey = k")
def kv_multiget_order(spark, sf_dir):
    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(k) for k in (7, 3, -1, 1, 2)))).alias("pos", "o_orderkey"))
    return tables.multi_get(wanted, _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def kv_filter_keys(spark, sf_dir):
    return tables.missing_keys(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 2) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def kv_upsert_lww(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return tables.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], F.col("event_id"))


@query(f"WITH {STATUS} SELECT s.status, count(x.doc_id) AS n FROM (SELECT unnest(['pending', 'parsing', 'analyzing', 'processing', 'processed', 'failed']) AS status) s LEFT JOIN status x USING (status) GROUP BY s.status UNION ALL SELECT 'all', count(*) FROM status")
def status_counts(spark, sf_dir):
    return tables.status_counts(_status(spark, sf_dir), ["pending", "parsing", "analyzing", "processing", "processed", "failed"])


@query(f"WITH {STATUS} SELECT doc_id, status, n_chars FROM status WHERE status IN ('processed', 'failed') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def docs_paginated(spark, sf_dir):
    s = _status(spark, sf_dir).where(F.col("status").isin("processed", "failed")).select("doc_id", "status", "n_chars")
    return tables.page(s, [F.desc_nulls_last("n_chars"), F.col("doc_id")], 2, 20)


@query("SELECT doc_id, CASE WHEN length(t) <= 250 THEN t ELSE substr(t, 1, 250) || '...' END AS summary FROM (SELECT doc_id, " + TRIM.format("text") + " AS t FROM documents)")
def content_summary(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", summary(F.col("text")).alias("summary"))


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace('<think>' || role || '</think> ' || text, '(?s)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS said FROM conversations")
def think_tags(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", without_thoughts(F.concat(F.lit("<think>"), "role", F.lit("</think> "), "text")).alias("said"))


@query(f"WITH {ADJ} SELECT node, degree FROM deg")
def node_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"WITH {ADJ} SELECT e.src, e.tgt, e.weight, a.degree + b.degree AS rank FROM edges e JOIN deg a ON a.node = src JOIN deg b ON b.node = tgt")
def edge_rank(spark, sf_dir):
    return graph.edge_ranks(_edges(spark, sf_dir)).select("src", "tgt", "weight", "rank")


@query(f"WITH {ADJ} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 50")
def popular_labels(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir)).orderBy(F.desc("degree"), "node").limit(50)


@query(f"WITH {ADJ} SELECT node, CASE WHEN node = 'p1' THEN 1000 WHEN starts_with(node, 'p1') THEN 500 ELSE 100 - length(node) + CASE WHEN contains(node, ' p1') OR contains(node, '_p1') THEN 50 ELSE 0 END END AS score FROM deg WHERE contains(node, 'p1') ORDER BY score DESC, node LIMIT 30")
def search_labels(spark, sf_dir):
    n = graph.degrees(_edges(spark, sf_dir)).where(F.lower("node").contains("p1"))
    score = F.when(F.lower("node") == "p1", 1000).when(F.lower("node").startswith("p1"), 500).otherwise(100 - F.length("node") + F.when(F.lower("node").rlike("[ _]p1"), 50).otherwise(0))
    return n.select("node", score.alias("score")).orderBy(F.desc("score"), "node").limit(30)


@query(f"WITH {ADJ}, d1 AS (SELECT DISTINCT other AS node FROM adj WHERE node = 'p1'), d2 AS (SELECT DISTINCT other AS node FROM adj WHERE node IN (SELECT node FROM d1)) SELECT node, min(depth)::INT AS depth FROM (SELECT 'p1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) GROUP BY node")
def bfs_depth2(spark, sf_dir):
    return graph.bfs(_edges(spark, sf_dir), spark.range(1).select(F.lit("p1").alias("node")), 2)


@query(f"WITH {ADJ}, best AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 400) SELECT src, tgt, weight FROM edges WHERE src IN (FROM best) AND tgt IN (FROM best)")
def induced_subgraph_topn(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.induced(e, graph.degrees(e).orderBy(F.desc("degree"), "node").limit(400)).select("src", "tgt", "weight")


@query(f"WITH {ADJ}, seeds AS (SELECT unnest(['s1', 'p2', 'p1']) AS node, unnest([0, 1, 2]) AS ord) SELECT least(node, other) AS src, greatest(node, other) AS tgt, min(ord)::INT AS ord FROM adj JOIN seeds USING (node) GROUP BY 1, 2")
def incident_edges(spark, sf_dir):
    seeds = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ("s1", "p2", "p1")))).alias("ord", "node"))
    return graph.incident(_edges(spark, sf_dir), seeds)


@query(f"WITH {EDGES}, moved AS (SELECT CASE WHEN src IN ('p1', 'p2', 'p3') THEN 's1' ELSE src END AS a, tgt AS b, weight FROM edges) SELECT least(a, b) AS src, greatest(a, b) AS tgt, max(weight) AS weight FROM moved WHERE a <> b GROUP BY 1, 2")
def merge_entities(spark, sf_dir):
    mapping = spark.range(1).select(F.explode(F.array(*map(F.lit, ("p1", "p2", "p3")))).alias("old"), F.lit("s1").alias("new"))
    return graph.merged_nodes(_edges(spark, sf_dir), mapping)


@query(f"WITH {ENTITY}, c AS (SELECT entity, kind, count(*) AS n, min(ord) AS seen FROM recs GROUP BY ALL) SELECT entity, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, seen, kind) AS rn FROM c) WHERE rn = 1")
def merge_node_type_majority(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("ord"))
    return graph.majority(p, "entity", "kind", "ord")


@query(f"WITH {ENTITY}, f AS (SELECT entity, description, min(ord) AS o FROM recs GROUP BY ALL) SELECT entity, string_agg(description, '<SEP>' ORDER BY o, length(description) DESC) AS descriptions FROM f GROUP BY entity")
def merge_descriptions(spark, sf_dir):
    p = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entity"), F.col("p_name").alias("d")).agg(F.min("p_partkey").alias("o"))
    s = F.sort_array(F.collect_list(F.struct("o", (-F.length("d")).alias("l"), "d")))
    return p.groupBy("entity").agg(F.array_join(F.transform(s, lambda x: x["d"]), "<SEP>").alias("descriptions"))


def _sources(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct()  # noqa: E741
    return l, Window.partitionBy("l_suppkey")


CAP = "SELECT l_suppkey, string_agg(l_orderkey::VARCHAR, '<SEP>' ORDER BY l_orderkey) AS source_ids FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey {}) AS rn FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) WHERE rn <= 200 GROUP BY l_suppkey"


def _capped(spark, sf_dir, order):
    l, w = _sources(spark, sf_dir)  # noqa: E741
    kept = l.withColumn("rn", F.row_number().over(w.orderBy(order))).where("rn <= 200")
    return kept.groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_orderkey")), lambda x: x.cast("string")), "<SEP>").alias("source_ids"))


@query(CAP.format(""))
def source_ids_cap_keep(spark, sf_dir):
    return _capped(spark, sf_dir, F.col("l_orderkey"))


@query(CAP.format("DESC"))
def source_ids_cap_fifo(spark, sf_dir):
    return _capped(spark, sf_dir, F.desc("l_orderkey"))


@query("SELECT least('p' || l_partkey, 's' || l_suppkey) || '<SEP>' || greatest('p' || l_partkey, 's' || l_suppkey) AS edge, round(sum(l_quantity), 2) AS weight, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS keywords FROM lineitem GROUP BY 1")
def merge_edges(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").withColumn("edge", pair_key(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")))  # noqa: E741
    return l.groupBy("edge").agg(F.round(F.sum("l_quantity"), 2).alias("weight"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("keywords"))


PARSE = "SELECT f[2] AS entity, lower(replace(f[3], ' ', '')) AS kind, f[4] AS description FROM (SELECT string_split(line, '<|#|>') AS f FROM (SELECT concat_ws('<|#|>', 'entity', p_name, p_type, CASE WHEN p_size > 25 THEN p_brand END) AS line FROM part)) WHERE len(f) = 4 AND f[1] = 'entity'"


@query(PARSE)
def parse_entity_records(spark, sf_dir):
    line = F.concat_ws("<|#|>", F.lit("entity"), "p_name", "p_type", F.when(F.col("p_size") > 25, F.col("p_brand")))
    f = _t(spark, sf_dir, "part").select(F.split(line, r"<\|#\|>").alias("f")).where((F.size("f") == 4) & (F.col("f")[0] == "entity"))
    return f.select(F.col("f")[1].alias("entity"), F.lower(F.replace(F.col("f")[2], F.lit(" "), F.lit(""))).alias("kind"), F.col("f")[3].alias("description"))


@query("SELECT p_brand AS entity, p_name AS description FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def gleaning_longest(spark, sf_dir):
    best = ranking.first_by(_t(spark, sf_dir, "part"), ["p_brand"], [F.desc(F.length("p_name")), F.col("p_partkey")])
    return best.select(F.col("p_brand").alias("entity"), F.col("p_name").alias("description"))


LISTS = "lists AS (SELECT o_custkey, 0 AS source, o_orderpriority AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders UNION ALL SELECT o_custkey, 1, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) FROM orders)"


@query(f"WITH {LISTS}, f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, k ORDER BY i, source) AS rn FROM lists) SELECT o_custkey, k, row_number() OVER (PARTITION BY o_custkey ORDER BY i, source) AS pos FROM f WHERE rn = 1")
def round_robin_two(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    one = lambda s, *by: o.select("o_custkey", F.lit(s).alias("source"), F.col("o_orderpriority").alias("k"), F.row_number().over(w.orderBy(*by)).alias("i"))
    both = one(0, "o_orderdate", "o_orderkey").union(one(1, F.desc("o_totalprice"), "o_orderkey"))
    return ranking.round_robin(both, ["o_custkey"], "i", "source", "k").select("o_custkey", "k", "pos")


@query("SELECT o_custkey, o_orderkey, running FROM (SELECT o_custkey, o_orderkey, sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders) WHERE running <= 60")
def token_budget_prefix(spark, sf_dir):
    return ranking.budget_prefix(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.length("o_orderpriority"), 60).select("o_custkey", "o_orderkey", "running")


OWNERS = "own AS (SELECT o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS owner, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place, o_orderkey FROM orders), n AS (SELECT *, max(owner) OVER (PARTITION BY o_custkey) + 1 AS n, count(*) OVER (PARTITION BY o_custkey, owner) AS size FROM own), q AS (SELECT *, CASE WHEN n = 1 THEN 5 ELSE round_even(5 - owner::DOUBLE / (n - 1) * 4, 0)::INT END AS quota FROM n), l AS (SELECT *, place <= quota AS taken, sum(CASE WHEN place = 1 THEN greatest(quota - size, 0) END) OVER (PARTITION BY o_custkey) AS spare FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, taken ORDER BY owner, place) AS rest FROM l)"


@query(f"WITH {OWNERS} SELECT o_custkey, o_orderkey, CASE WHEN taken THEN 1 ELSE 2 END AS round FROM r WHERE taken OR rest <= spare")
def weighted_polling(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    own = o.select("o_custkey", "o_orderkey", (F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")) - 1).alias("owner"), F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")).alias("place"))
    return ranking.weighted_polling(own, ["o_custkey"], "owner", "place", 5, 1).select("o_custkey", "o_orderkey", "round")


@query("SELECT lang, source AS file_path, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first_id)::VARCHAR AS reference_id FROM (SELECT lang, source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL)")
def reference_list(spark, sf_dir):
    return context.references(_t(spark, sf_dir, "documents").select("lang", F.col("source").alias("file_path"), "doc_id"), ["lang"], "file_path", "doc_id")


@query("SELECT l_orderkey, max(l_quantity) AS best, round(avg(l_quantity), 6) AS mean, min([l_linenumber::DOUBLE, l_partkey::DOUBLE, l_quantity])[3] AS first FROM lineitem GROUP BY l_orderkey")
def rerank_aggregate(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("best"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min(F.struct("l_linenumber", "l_partkey", "l_quantity"))["l_quantity"].alias("first"))


@query("SELECT l_partkey, l_orderkey, n FROM (SELECT l_partkey, l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def chunk_occurrence(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    l = _t(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("l_partkey", "l_linenumber")))  # noqa: E741
    return l.where("rn = 1").select("l_partkey", "l_orderkey", "n")


@query("WITH c AS (SELECT doc_id, k * 1100 AS a, least(k * 1100 + 1200, length(text)) AS z FROM (SELECT doc_id, text, unnest(range(0, ((length(text) + 1099) // 1100))) AS k FROM documents)), b AS (SELECT doc_id, k * 700 AS a, least(k * 700 + 700, length(text)) AS z FROM (SELECT doc_id, text, unnest(range(0, ((length(text) + 699) // 700))) AS k FROM documents)) SELECT c.doc_id, c.a AS chunk_start, count(*) AS blocks FROM c JOIN b ON b.doc_id = c.doc_id AND b.a < c.z AND c.a < b.z GROUP BY ALL")
def span_overlap_join(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")).where("n > 0")
    cut = lambda step, size: d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("a")).select("doc_id", "a", F.least(F.col("a") + size, F.col("n")).alias("z"))
    c, b = cut(1100, 1200).alias("c"), cut(700, 700).alias("b")
    j = c.join(b, (F.col("c.doc_id") == F.col("b.doc_id")) & (F.col("b.a") < F.col("c.z")) & (F.col("c.a") < F.col("b.z")))
    return j.groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.a").alias("chunk_start")).agg(F.count("*").alias("blocks"))


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) SELECT w, count(*) AS df, round(ln((SELECT count(*) + 1 FROM documents) / (count(*) + 1)) + 1, 6) AS idf FROM w WHERE length(w) > 1 GROUP BY w")
def tfidf_idf(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    n = d.agg((F.count("*") + 1).alias("n"))
    w = d.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))).alias("w")).where("length(w) > 1")
    return w.groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True)).select("w", "df", F.round(F.ln(F.col("n") / (F.col("df") + 1)) + 1, 6).alias("idf"))


@query(f"WITH {STATUS}, lin AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n, count(DISTINCT CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey END) AS rest FROM lineitem GROUP BY l_partkey) SELECT l_partkey, CASE WHEN rest = 0 THEN 'delete' WHEN rest < n THEN 'rebuild' ELSE 'keep' END AS action FROM lin")
def purge_classify(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"), F.countDistinct(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey"))).alias("rest"))  # noqa: E741
    return l.select("l_partkey", F.when(F.col("rest") == 0, "delete").when(F.col("rest") < F.col("n"), "rebuild").otherwise("keep").alias("action"))


@query("SELECT DISTINCT 'p' || l_partkey AS entity, 'UNKNOWN' AS kind FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def custom_kg_placeholders(spark, sf_dir):
    known = _t(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    ends = _t(spark, sf_dir, "lineitem").select("l_partkey").distinct().join(known, "l_partkey", "left_anti")
    return ends.select(F.concat(F.lit("p"), "l_partkey").alias("entity"), F.lit("UNKNOWN").alias("kind"))


@query("SELECT event_type, user_id % 10 AS bucket, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL")
def cache_grouping(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_id, regexp_extract(props, '\"k\":\\s*(\\d+)', 1)::INT AS k FROM events")
def parse_json(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _register() -> None:
    from . import chunking, compositions, mutations, parsing, serving  # noqa: F401  each registers its own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _register()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(_SQL)
