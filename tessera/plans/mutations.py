"""Queries of graph writes, lineage, deletes and rebuilds, each with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import graph, writes
from ..operators.ranking import first_by
from .queries import ADJ, EDGES, _edges, _t, query

NODES = "nodes AS (SELECT 'p' || p_partkey AS node, p_type AS kind, p_name AS description FROM part)"


def _nodes(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_type").alias("kind"), F.col("p_name").alias("description"))


def _names(spark, *names, column="node"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


@query(f"WITH {NODES} SELECT node, CASE WHEN p THEN 'PATCHED' ELSE kind END AS kind, description FROM (SELECT *, substr(node, 2)::INT % 5 = 0 AS p FROM nodes) UNION ALL SELECT 's' || s_suppkey, 'SUPPLIER', NULL FROM supplier")
def upsert_nodes(spark, sf_dir):
    old = _nodes(spark, sf_dir)
    new = _t(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.lit("PATCHED").alias("kind"), F.lit(None).cast("string").alias("description"))
    made = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit("SUPPLIER").alias("kind"), F.lit(None).cast("string").alias("description"))
    return writes.upsert_attributes(old, new.union(made), ["node"])


@query(f"WITH {EDGES} SELECT src, tgt, CASE WHEN src IN ('p1', 'p2') THEN 1.0 ELSE weight END AS weight FROM edges")
def upsert_edges(spark, sf_dir):
    old = _edges(spark, sf_dir)
    new = old.where(F.col("src").isin("p1", "p2")).select(F.col("tgt").alias("a"), F.col("src").alias("b"), F.lit(1.0).alias("weight"))
    return writes.upsert_attributes(old, new.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt"), "weight"), ["src", "tgt"])


@query(f"WITH {EDGES} SELECT src, tgt, weight FROM edges WHERE NOT (src IN ('p1', 'p2') AND tgt = 's1')")
def delete_edges(spark, sf_dir):
    return writes.without_edges(_edges(spark, sf_dir), spark.createDataFrame([("s1", "p1"), ("p2", "s1")], "a string, b string"))


@query(f"WITH {NODES}, {EDGES} SELECT 'node' AS what, node AS a, '' AS b FROM nodes WHERE node NOT IN ('p1', 'p3') UNION ALL SELECT 'edge', src, tgt FROM edges WHERE src NOT IN ('p1', 'p3') UNION ALL SELECT 'vector', 'ent-' || md5(node), '' FROM nodes WHERE node NOT IN ('p1', 'p3') UNION ALL SELECT 'vector', 'rel-' || md5(src || tgt), '' FROM edges WHERE src NOT IN ('p1', 'p3')")
def cascading_delete(spark, sf_dir):
    nodes, edges = writes.without_nodes(_nodes(spark, sf_dir), _edges(spark, sf_dir), _names(spark, "p1", "p3"))
    rows = [nodes.select(F.lit("node").alias("what"), F.col("node").alias("a"), F.lit("").alias("b")), edges.select(F.lit("edge"), "src", "tgt")]
    rows += [nodes.select(F.lit("vector"), F.concat(F.lit("ent-"), F.md5(F.col("node").cast("binary"))), F.lit("")), edges.select(F.lit("vector"), F.concat(F.lit("rel-"), F.md5(F.concat("src", "tgt").cast("binary"))), F.lit(""))]
    return reduce(lambda a, b: a.union(b), rows)


@query(f"WITH {NODES} SELECT node, false AS refused FROM nodes WHERE substr(node, 2)::INT % 2 = 0 UNION ALL SELECT 'new' || substr(node, 2), false FROM nodes WHERE substr(node, 2)::INT % 2 = 1 UNION ALL SELECT node, true FROM nodes WHERE substr(node, 2)::INT % 2 = 0")
def create_nodes(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    old = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    made, refused = writes.create(old, old.union(p.where("p_partkey % 2 = 1").select(F.concat(F.lit("new"), "p_partkey"))), ["node"])
    return made.select("node", F.lit(False).alias("refused")).union(refused.select("node", F.lit(True)))


@query(f"WITH {NODES} SELECT pos::INT AS pos, n AS node, kind IS NOT NULL AS found, kind FROM (SELECT unnest(['p2', 'none', 'p1']) AS n, unnest([0, 1, 2]) AS pos) LEFT JOIN nodes ON node = n")
def get_nodes(spark, sf_dir):
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ("p2", "none", "p1")))).alias("pos", "node"))
    return wanted.join(_nodes(spark, sf_dir).select("node", "kind"), "node", "left").select("pos", "node", F.col("kind").isNotNull().alias("found"), "kind")


@query(f"WITH {EDGES} SELECT a, b, weight IS NOT NULL AS found, coalesce(weight, 1.0) AS weight FROM (SELECT unnest(['s1', 'p1', 'zz']) AS a, unnest(['p1', 's1', 'p1']) AS b) LEFT JOIN edges ON src = least(a, b) AND tgt = greatest(a, b)")
def get_edges(spark, sf_dir):
    wanted = spark.createDataFrame([("s1", "p1"), ("p1", "s1"), ("zz", "p1")], "a string, b string").select("a", "b", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt"))
    return wanted.join(_edges(spark, sf_dir), ["src", "tgt"], "left").select("a", "b", F.col("weight").isNotNull().alias("found"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


@query(f"WITH {ADJ} SELECT node AS label FROM deg")
def all_labels(spark, sf_dir):
    return graph.adjacency(_edges(spark, sf_dir)).select(F.col("node").alias("label")).distinct().orderBy("label")


@query(f"WITH {ADJ}, ends AS (SELECT DISTINCT src AS node FROM edges WHERE tgt = 's1') SELECT e.src, e.tgt, n.kind FROM edges e JOIN (SELECT 'p' || p_partkey AS node, p_type AS kind FROM part) n ON n.node = e.src WHERE e.src IN (FROM ends) GROUP BY ALL")
def edges_with_vertices(spark, sf_dir):
    e = _edges(spark, sf_dir)
    near = e.where("tgt = 's1'").select("src").distinct()
    return e.join(near, "src", "left_semi").join(_nodes(spark, sf_dir).select(F.col("node").alias("src"), "kind"), "src").select("src", "tgt", "kind").distinct()


@query(f"WITH {EDGES}, out AS (SELECT tgt AS node FROM edges WHERE src = 'p1'), inn AS (SELECT DISTINCT src AS node FROM edges WHERE tgt = 's1') SELECT 'out' AS direction, 'p1' AS node, 0 AS depth UNION ALL SELECT 'out', node, 1 FROM out UNION ALL SELECT 'in', 's1', 0 UNION ALL SELECT 'in', node, 1 FROM inn")
def directed_bfs(spark, sf_dir):
    e = _edges(spark, sf_dir)
    found = [graph.bfs(e, _names(spark, start), 3, way).select(F.lit(way).alias("direction"), "node", "depth") for way, start in (("out", "p1"), ("in", "s1"))]
    return found[0].union(found[1])


@query(f"WITH {ADJ}, d1 AS (SELECT DISTINCT other AS node FROM adj WHERE node = 'p1'), d2 AS (SELECT DISTINCT other AS node FROM adj WHERE node IN (FROM d1)), l AS (SELECT node, min(depth) AS depth FROM (SELECT 'p1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) GROUP BY node), c AS (SELECT l.node FROM l JOIN deg USING (node) ORDER BY depth, degree DESC, l.node LIMIT 30) SELECT src, tgt, src || '-' || tgt AS id, weight FROM edges WHERE src IN (FROM c) AND tgt IN (FROM c)")
def bfs_edges(spark, sf_dir):
    from ..operators import retrieval

    e = _edges(spark, sf_dir)
    kept = retrieval.capped_bfs(graph.bfs(e, _names(spark, "p1"), 2), graph.degrees(e), 30)
    return graph.induced(e, kept).select("src", "tgt", F.concat_ws("-", "src", "tgt").alias("id"), "weight")


MERGE = {"keep_first": "first(p_name ORDER BY p_partkey)", "keep_last": "last(p_name ORDER BY p_partkey)", "concatenate": "string_agg(p_name, '<SEP>' ORDER BY p_partkey)", "max": "max(p_retailprice)", "join_unique_comma": "array_to_string(list_sort(list_distinct(list(p_type) || list('x'))), ',')"}


@query("WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS o FROM part GROUP BY ALL) SELECT b.*, u.join_unique FROM (SELECT p_brand, " + ", ".join(f"{v} AS {k}" for k, v in MERGE.items()) + " FROM part GROUP BY p_brand) b JOIN (SELECT p_brand, string_agg(p_type, '<SEP>' ORDER BY o) AS join_unique FROM f GROUP BY p_brand) u USING (p_brand)")
def merge_strategies(spark, sf_dir):
    k = F.col("p_partkey")
    values = {"keep_first": F.col("p_name"), "keep_last": F.col("p_name"), "concatenate": F.col("p_name"), "max": F.col("p_retailprice"), "join_unique_comma": F.concat(F.lit("x, "), "p_type"), "join_unique": F.col("p_type")}
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(*(writes.merged_values(s, v, k).alias(s) for s, v in values.items()))


@query("SELECT p_partkey, array_to_string([p_brand, p_type, 'a'], '|') AS both, p_brand || '|a' AS less, p_brand || '|b|' || p_name AS delta, p_type = 'PROMO' AS overlap, 'a|b' AS head, 'c|d' AS tail FROM part")
def ordered_sets(spark, sf_dir):
    a, b = F.array("p_brand", "p_type", F.lit("a"), "p_brand"), F.array("p_type", F.lit("z"))
    held, four = F.array("p_brand", F.lit("a"), F.lit("b")), F.array(*map(F.lit, "abcd"))
    j = lambda c: F.array_join(c, "|")
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        j(writes.ordered_union(a, F.array(F.lit("a"), "p_type"))).alias("both"),
        j(F.array_distinct(writes.ordered_difference(a, b))).alias("less"),
        j(writes.with_delta(held, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.col("p_name")))).alias("delta"),
        F.arrays_overlap(b, F.array(F.lit("PROMO"), F.lit("q"))).alias("overlap"),
        j(writes.capped(four, 2)).alias("head"),
        j(writes.capped(four, 2, "FIFO")).alias("tail"),
    )


PURGED = "lin AS (SELECT DISTINCT 'p' || l_partkey AS node, l_orderkey AS source FROM lineitem), lost AS (SELECT DISTINCT node FROM lin WHERE source % 3 = 0), rest AS (SELECT node, count(*) AS rest FROM lin WHERE source % 3 <> 0 GROUP BY node)"


def _purged(spark, sf_dir):
    lin = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("node"), F.col("l_orderkey").alias("source")).distinct()
    return writes.purge(lin, _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("source")), "node")


@query(f"WITH {PURGED} SELECT node, CASE WHEN rest IS NULL THEN 'delete' ELSE 'rebuild' END AS action, coalesce(rest, 0) AS rest FROM lost LEFT JOIN rest USING (node)")
def delete_documents(spark, sf_dir):
    return _purged(spark, sf_dir)[1]


@query(f"WITH {PURGED}, cached AS (SELECT l_orderkey AS source, 'p' || l_partkey AS node, l_returnflag AS kind, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE l_linestatus END AS description, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_orderkey % 3 <> 0 AND 'p' || l_partkey IN (SELECT node FROM lost)), k AS (SELECT node, kind, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, min(ord)) AS rn FROM cached GROUP BY node, kind), d AS (SELECT node, string_agg(description, '<SEP>' ORDER BY o) AS description FROM (SELECT node, description, min(ord) AS o FROM cached WHERE description <> '' GROUP BY ALL) GROUP BY node) SELECT node, kind, coalesce(description, 'Entity ' || node) AS description FROM k LEFT JOIN d USING (node) WHERE rn = 1")
def rebuild_from_cache(spark, sf_dir):
    left, touched = _purged(spark, sf_dir)
    cached = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("node"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.col("l_linestatus")).alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return writes.rebuilt(cached.join(left, ["node", "source"], "left_semi"), touched.where("action = 'rebuild'"), "node")


@query("SELECT l_suppkey, count(*) AS fragments, count(DISTINCT l_orderkey) AS sources FROM (SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS r FROM lineitem) WHERE r <= 200 GROUP BY l_suppkey")
def keep_drops_fragments(spark, sf_dir):
    from ..operators.ranking import top_by

    l = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")  # noqa: E741
    kept = top_by(l.distinct(), ["l_suppkey"], [F.col("l_orderkey")], 200).select("l_suppkey", "l_orderkey")
    return l.join(kept, ["l_suppkey", "l_orderkey"], "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("fragments"), F.countDistinct("l_orderkey").alias("sources"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, 'Entity p' || p_partkey) AS description FROM part")
def missing_descriptions(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.concat(F.lit("Entity p"), "p_partkey")).alias("description"))


@query("SELECT 's' || l_suppkey AS node, count(DISTINCT l_orderkey) AS n, md5(string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR)) AS sources FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey")
def endpoint_sources(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0").select(F.concat(F.lit("s"), "l_suppkey").alias("node"), F.col("l_orderkey").cast("string").alias("k")).distinct()  # noqa: E741
    return l.groupBy("node").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("k")), ",").cast("binary")).alias("sources"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 100 = 0")
def vectors_by_ids(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 100 <> 0 AND label <> 3")
def delete_vectors(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label")
    return e.join(e.where("vec_id % 100 = 0 OR label = 3").select("vec_id"), "vec_id", "left_anti")


@query("SELECT doc_id, count(DISTINCT w) AS entities, md5(string_agg(DISTINCT w, ',' ORDER BY w)) AS names FROM (SELECT l_orderkey AS doc_id, 'p' || l_partkey AS w FROM lineitem) GROUP BY doc_id")
def document_entities(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), "l_partkey"))).alias("s"))  # noqa: E741
    return l.select("doc_id", F.size("s").cast("long").alias("entities"), F.md5(F.array_join("s", ",").cast("binary")).alias("names"))


@query("SELECT p_brand, p_type, description, weight FROM (SELECT p_brand, p_type, p_name AS description, p_size::DOUBLE AS weight, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1")
def custom_kg_last_wins(spark, sf_dir):
    p = first_by(_t(spark, sf_dir, "part"), ["p_brand", "p_type"], [F.desc("p_partkey")])
    return p.select("p_brand", "p_type", F.col("p_name").alias("description"), F.col("p_size").cast("double").alias("weight"))


@query("SELECT l_orderkey, 'p' || a AS item, 'p' || b AS other, 'associated with' AS keywords FROM (SELECT l_orderkey, min(l_partkey) AS a FROM lineitem GROUP BY l_orderkey) JOIN (SELECT DISTINCT l_orderkey, l_partkey AS b FROM lineitem) USING (l_orderkey) WHERE a <> b")
def item_entities(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()  # noqa: E741
    item = l.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"))
    return l.join(item, "l_orderkey").where("a <> l_partkey").select("l_orderkey", F.concat(F.lit("p"), "a").alias("item"), F.concat(F.lit("p"), "l_partkey").alias("other"), F.lit("associated with").alias("keywords"))
