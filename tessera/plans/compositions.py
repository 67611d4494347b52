"""Retrieval modes and the maintenance operators around them, each with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import graph, ranking, retrieval, search, tables
from .queries import ADJ, EDGES, TOP, _edges, _t, _vectors, naive_topk, query

ENT = f"{TOP}, {ADJ}, ent AS (SELECT query_id, 'p' || item_id AS name, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM top JOIN part ON p_partkey = item_id WHERE rank <= 20)"
LREL = "lrel AS (SELECT query_id, src, tgt, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, weight DESC, src, tgt) AS pos FROM (SELECT DISTINCT query_id, least(node, other) AS src, greatest(node, other) AS tgt FROM ent JOIN adj ON node = name) JOIN (SELECT e.src, e.tgt, e.weight, a.degree + b.degree AS rank FROM edges e JOIN deg a ON a.node = e.src JOIN deg b ON b.node = e.tgt) USING (src, tgt))"
GREL = "grel AS (SELECT query_id, src, tgt, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM top JOIN (SELECT src, min(tgt) AS tgt FROM edges GROUP BY src) ON src = 'p' || item_id WHERE rank BETWEEN 11 AND 40)"
GENT = "gent AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY o) AS pos FROM (SELECT query_id, name, min(o) AS o FROM (SELECT query_id, src AS name, pos * 2 AS o FROM grel UNION ALL SELECT query_id, tgt, pos * 2 + 1 FROM grel) GROUP BY query_id, name))"
TURNS = "(SELECT query_id, {k}, row_number() OVER (PARTITION BY query_id ORDER BY pos, s) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {k} ORDER BY pos, s) AS rn FROM (SELECT query_id, {k}, pos, 0 AS s FROM {a} UNION ALL SELECT query_id, {k}, pos, 1 FROM {b})) WHERE rn = 1)"
HYBRID = f"WITH {ENT}, {LREL}, {GREL}, {GENT}, he AS {TURNS.format(k='name', a='ent', b='gent')}, hr AS {TURNS.format(k='src, tgt', a='lrel', b='grel')}"
ROWS = "SELECT query_id, 'entity' AS kind, name, pos FROM {} UNION ALL SELECT query_id, 'relation', src || '-' || tgt, pos FROM {}"


def _found(spark, sf_dir, first, last):
    top = search.top_k(*_vectors(spark, sf_dir), last, 0.2).where(F.col("rank") >= first)
    return top.select("query_id", F.concat(F.lit("p"), "item_id").alias("name"), "item_id", "rank")


def _rows(entities, relations):
    return entities.select("query_id", F.lit("entity").alias("kind"), "name", "pos").union(relations.select("query_id", F.lit("relation").alias("kind"), F.concat_ws("-", "src", "tgt").alias("name"), "pos"))


def _local(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    ent = retrieval.seed_entities(_found(spark, sf_dir, 1, 20), nodes)
    return ent, retrieval.entity_relations(ent, _edges(spark, sf_dir))


def _global(spark, sf_dir):
    own = _edges(spark, sf_dir).groupBy("src").agg(F.min("tgt").alias("tgt"))
    hits = _found(spark, sf_dir, 11, 40).withColumnRenamed("name", "src").join(own, "src")
    rel = retrieval.numbered(hits, ["query_id"], [F.col("rank")]).select("query_id", "src", "tgt", "pos")
    return rel, retrieval.relation_entities(rel)


@query(f"WITH {ENT}, {LREL} {ROWS.format('ent', 'lrel')}")
def local_query(spark, sf_dir):
    return _rows(*_local(spark, sf_dir))


@query(f"WITH {ENT}, {GREL}, {GENT} {ROWS.format('gent', 'grel')}")
def global_query(spark, sf_dir):
    rel, ent = _global(spark, sf_dir)
    return _rows(ent, rel)


def _hybrid(spark, sf_dir):
    (le, lr), (gr, ge) = _local(spark, sf_dir), _global(spark, sf_dir)
    return _rows(retrieval.merged([le, ge], ["name"]), retrieval.merged([lr, gr], ["src", "tgt"]))


@query(f"{HYBRID} {ROWS.format('he', 'hr')}")
def hybrid_query(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(f"{HYBRID} {ROWS.format('he', 'hr')} UNION ALL SELECT query_id, 'chunk', 'd' || item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) FROM top JOIN documents ON doc_id = item_id WHERE rank <= 40")
def mix_query(spark, sf_dir):
    hits = _found(spark, sf_dir, 1, 40).join(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), "item_id")
    chunks = retrieval.numbered(hits, ["query_id"], [F.col("rank")])
    return _hybrid(spark, sf_dir).union(chunks.select("query_id", F.lit("chunk"), F.concat(F.lit("d"), "item_id"), "pos"))


@query(f"{HYBRID}, b AS (SELECT query_id, name, pos, sum(length(name)) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running FROM he) SELECT query_id, name, pos FROM b WHERE running <= 60")
def truncated_entities(spark, sf_dir):
    (le, _), (_, ge) = _local(spark, sf_dir), _global(spark, sf_dir)
    return ranking.budget_prefix(retrieval.merged([le, ge], ["name"]), ["query_id"], [F.col("pos")], F.length("name"), 60).select("query_id", "name", "pos")


POLL = "held AS (SELECT query_id, l_orderkey AS chunk, count(DISTINCT pos) AS n, min(pos) AS first FROM ent JOIN lineitem ON name = 'p' || l_partkey GROUP BY query_id, l_orderkey), own AS (SELECT query_id, chunk, n, dense_rank() OVER (PARTITION BY query_id ORDER BY first) - 1 AS owner, row_number() OVER (PARTITION BY query_id, first ORDER BY n DESC, chunk) AS place FROM held), q AS (SELECT *, max(owner) OVER (PARTITION BY query_id) + 1 AS m, count(*) OVER (PARTITION BY query_id, owner) AS size FROM own), r AS (SELECT *, CASE WHEN m = 1 THEN 5 ELSE round_even(5 - owner / (m - 1) * 4, 0) END AS quota FROM q), s AS (SELECT *, place <= quota AS taken, sum(CASE WHEN place = 1 THEN greatest(quota - size, 0) END) OVER (PARTITION BY query_id) AS spare FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, taken ORDER BY owner, place) AS rest FROM s)"


@query(f"WITH {ENT}, {POLL} SELECT query_id, chunk, n, CASE WHEN taken THEN 1 ELSE 2 END AS round FROM t WHERE taken OR rest <= spare")
def related_chunks(spark, sf_dir):
    ent, _ = _local(spark, sf_dir)
    lineage = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("name"), F.col("l_orderkey").alias("chunk"))
    return retrieval.related_chunks(ent, lineage)


@query("WITH s AS (SELECT o_custkey, o_orderkey, length(o_orderpriority) AS tok, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 END AS score FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(score, 1) DESC, o_orderkey) AS r FROM s WHERE coalesce(score, 1) >= 0.1), b AS (SELECT *, sum(tok) OVER (PARTITION BY o_custkey ORDER BY r ROWS UNBOUNDED PRECEDING) AS run FROM k WHERE r <= 10) SELECT o_custkey, o_orderkey, 'DC' || r AS dc FROM b WHERE run <= 70")
def chunk_pipeline(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("score", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500000))
    order = [F.desc(F.coalesce("score", F.lit(1.0))), F.col("o_orderkey")]
    return retrieval.final_chunks(o, ["o_custkey"], order, F.col("score"), 0.1, 10, F.length("o_orderpriority"), 70).select("o_custkey", "o_orderkey", "dc")


@query(f"WITH {ADJ}, d1 AS (SELECT DISTINCT other AS node FROM adj WHERE node = 'p1'), d2 AS (SELECT DISTINCT other AS node FROM adj WHERE node IN (SELECT node FROM d1)), l AS (SELECT node, min(depth)::INT AS depth FROM (SELECT 'p1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) GROUP BY node) SELECT node, depth, (SELECT count(*) > 30 FROM l) AS is_truncated FROM l JOIN deg USING (node) ORDER BY depth, degree DESC, node LIMIT 30")
def bfs_capped(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return retrieval.capped_bfs(graph.bfs(e, spark.range(1).select(F.lit("p1").alias("node")), 2), graph.degrees(e), 30)


THREE = [("o_orderdate", "o_orderdate"), ("o_totalprice DESC", "o_totalprice"), ("o_totalprice", "o_totalprice")]


@query("WITH lists AS (" + " UNION ALL ".join(f"SELECT o_custkey, {i} AS source, o_orderpriority AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY {by}, o_orderkey) AS i FROM orders" for i, (by, _) in enumerate(THREE)) + "), f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, k ORDER BY i, source) AS rn FROM lists) SELECT o_custkey, k, row_number() OVER (PARTITION BY o_custkey ORDER BY i, source) AS pos FROM f WHERE rn = 1")
def round_robin_three(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "query_id").withColumnRenamed("o_orderpriority", "k")
    lists = [retrieval.numbered(o, ["query_id"], [F.desc(c) if "DESC" in by else F.col(c), F.col("o_orderkey")]) for by, c in THREE]
    return retrieval.merged(lists, ["k"]).withColumnRenamed("query_id", "o_custkey")


@query("SELECT doc_id, source || '.' || lang AS file_path, 'dup-' || md5(doc_id || '-' || first_id) AS duplicate_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY source, lang) AS first_id FROM documents) WHERE doc_id <> first_id")
def doc_dedupe_filename(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "source", "lang").alias("file_path"))
    # few file names: the minimum is aggregated before the join, so a hot name makes no large group
    first = d.groupBy("file_path").agg(F.min("doc_id").alias("first_id"))
    return d.join(first, "file_path").where("doc_id <> first_id").select("doc_id", "file_path", F.concat(F.lit("dup-"), F.md5(F.concat_ws("-", "doc_id", "first_id").cast("binary"))).alias("duplicate_id"))


@query("SELECT f[2] AS src, f[3] AS tgt, f[4] AS keywords, f[5] AS description, coalesce(TRY_CAST(f[6] AS DOUBLE), 1.0) AS weight FROM (SELECT string_split(line, '<|#|>') AS f FROM (SELECT concat_ws('<|#|>', 'relationship', p_brand, p_type, p_name, 'made by ' || p_brand, CASE WHEN p_size > 25 THEN p_size::VARCHAR END) AS line FROM part)) WHERE len(f) IN (5, 6) AND f[2] <> f[3]")
def parse_relation_records(spark, sf_dir):
    line = F.concat_ws("<|#|>", F.lit("relationship"), "p_brand", "p_type", "p_name", F.concat(F.lit("made by "), "p_brand"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")))
    f = _t(spark, sf_dir, "part").select(F.split(line, r"<\|#\|>").alias("f")).where(F.size("f").isin(5, 6) & (F.col("f")[1] != F.col("f")[2]))
    part = lambda i: F.get("f", F.lit(i))
    return f.select(part(1).alias("src"), part(2).alias("tgt"), part(3).alias("keywords"), part(4).alias("description"), F.coalesce(part(5).try_cast("double"), F.lit(1.0)).alias("weight"))


@query("SELECT l_suppkey, string_agg('f' || k, '<SEP>' ORDER BY k) || CASE WHEN max(n) > 75 THEN '<SEP>...truncated...(KEEP Old)' ELSE '' END AS file_paths FROM (SELECT l_suppkey, l_partkey AS k, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_partkey)) WHERE rn <= 75 GROUP BY l_suppkey")
def file_paths_cap(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()  # noqa: E741
    sizes = l.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    first = ranking.top_by(l, ["l_suppkey"], [F.col("l_partkey")], 75, "_rn").groupBy("l_suppkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("p"))
    names = F.array_join(F.transform("p", lambda x: F.concat(F.lit("f"), x.cast("string"))), "<SEP>")
    return first.join(sizes, "l_suppkey").select("l_suppkey", F.concat(names, F.when(F.col("n") > 75, "<SEP>...truncated...(KEEP Old)").otherwise("")).alias("file_paths"))


@query(f"WITH {EDGES}, r AS (SELECT CASE WHEN src = 'p1' THEN 'z-one' ELSE src END AS a, tgt AS b, weight FROM edges) SELECT least(a, b) AS src, greatest(a, b) AS tgt, weight, 'rel-' || md5(least(a, b) || greatest(a, b)) AS id FROM r")
def rename_entity(spark, sf_dir):
    mapping = spark.range(1).select(F.lit("p1").alias("old"), F.lit("z-one").alias("new"))
    return graph.merged_nodes(_edges(spark, sf_dir), mapping).withColumn("id", F.concat(F.lit("rel-"), F.md5(F.concat("src", "tgt").cast("binary"))))


@query(f"WITH {EDGES} SELECT src, tgt, weight FROM edges WHERE src NOT IN ('p1', 's2') AND tgt NOT IN ('p1', 's2')")
def delete_nodes(spark, sf_dir):
    gone = spark.range(1).select(F.explode(F.array(F.lit("p1"), F.lit("s2"))).alias("node"))
    return reduce(lambda e, side: e.join(F.broadcast(gone.withColumnRenamed("node", side)), side, "left_anti"), ("src", "tgt"), _edges(spark, sf_dir)).select("src", "tgt", "weight")


@query("SELECT doc_id, 'default:extract:' || md5(text) AS cache_key, c.first_id IS NOT NULL AS is_hit FROM documents LEFT JOIN (SELECT text, min(doc_id) AS first_id FROM documents WHERE lang = 'en' GROUP BY text) c USING (text)")
def cache_lookup(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("default:extract:"), F.md5(F.col("text").cast("binary"))).alias("cache_key"))
    stored = d.where("lang = 'en'").select("cache_key").distinct().withColumn("_hit", F.lit(True))
    return d.join(stored, "cache_key", "left").select("doc_id", "cache_key", F.coalesce("_hit", F.lit(False)).alias("is_hit"))


@query("SELECT event_type, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high, round(count(v) / count(*), 6) AS success FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY event_type")
def metric_nan_avg(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = _t(spark, sf_dir, "events").select("event_type", F.when(~F.isnan(v), v).alias("v"))
    return e.groupBy("event_type").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.round(F.count("v") / F.count("*"), 6).alias("success"))


@query("SELECT l_suppkey, count(*) AS parts, md5(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR)) AS chunk_list FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_suppkey")
def lineage_rebuild(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").cast("string").alias("k")).distinct()  # noqa: E741
    return l.groupBy("l_suppkey").agg(F.count("*").alias("parts"), F.md5(F.array_join(F.sort_array(F.collect_list("k")), ",").cast("binary")).alias("chunk_list"))


@query("SELECT query_id, item_id, rank FROM (WITH " + TOP + " SELECT * FROM top) WHERE rank <= 3")
def batch_topk_per_query(spark, sf_dir):
    return naive_topk(spark, sf_dir).where("rank <= 3").select("query_id", "item_id", "rank")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0")
def kv_delete(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return tables.missing_keys(o, o.where("o_orderkey % 11 = 0").select("o_orderkey"), "o_orderkey")
