"""Stores, graphs and exports written and read again; routing and repair on literals."""

import json

from pyspark.sql import functions as F

from tessera.operators import context, extraction, writes
from tessera.sources import files


def test_store_keeps_other_workspaces(spark, tmp_path):
    for w in ("a", "b"):
        files.save_store(spark.createDataFrame([("k", w)], "id string, v string"), f"{tmp_path}/kv", w)
    files.save_store(spark.createDataFrame([("k", "new")], "id string, v string"), f"{tmp_path}/kv", "a")
    got = [files.load_store(spark, f"{tmp_path}/kv", w, "id string, v string").collect()[0].v for w in ("a", "b")]
    assert got == ["new", "b"]


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", "x<y"), ('q"', None)], "node string, kind string")
    edges = spark.createDataFrame([("a & b", 'q"', 2.5)], "src string, tgt string, weight double")
    files.save_graphml(nodes, edges, f"{tmp_path}/g")
    n, e = files.load_graphml(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, n.collect())) == [("a & b", "x<y"), ('q"', "")]
    assert [tuple(r) for r in e.collect()] == [("a & b", 'q"', 2.5)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc")], "id int, t string")
    for kind, want in (("md", ["| 1 | a\\|b c |"]), ("txt", ["id: 1; t: a|b c"])):
        files.export_table(df, f"{tmp_path}/{kind}", kind)
        assert [r.value for r in spark.read.text(f"{tmp_path}/{kind}").collect()] == want
    files.export_table(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/csv").collect()[0].t == "a|b\nc"


def test_json_repair():
    assert json.loads(extraction.repaired("{a: 'x', \"b\": [1, 2,],")) == {"a": "x", "b": [1, 2]}
    assert json.loads(extraction.repaired('{"a": "it\'s"}')) == {"a": "it's"}
    assert extraction.repaired("sorry") is None and extraction.repaired(None) is None


def test_rerank_hook_and_missing_vectors(spark):
    df = spark.createDataFrame([("a b", "b c"), ("a", "z")], "q string, t string")
    assert [r.rerank_score for r in context.reranked(df, "q", "t").collect()] == [0.5, 0.0]
    assert context.reranked(df, "q", "t", None).where("rerank_score IS NOT NULL").count() == 0
    owned = spark.createDataFrame([(1, 0, 1, [1.0]), (1, 1, 1, None), (2, 0, 1, [1.0])], "q int, owner int, place int, v array<double>")
    got = context.similar_chunks(owned, ["q"], "owner", "place", F.array(F.lit(1.0)), F.col("v"), 5).select("q", "picked").collect()
    assert sorted(map(tuple, got)) == [(1, "polled"), (1, "polled"), (2, "similar")]


def test_empty_tables_stay_empty(spark):
    old = spark.createDataFrame([], "node string, kind string")
    assert writes.upsert_attributes(old, old, ["node"]).count() == 0
    left, touched = writes.purge(spark.createDataFrame([], "node string, source long"), spark.createDataFrame([], "source long"), "node")
    assert left.count() == touched.count() == 0
