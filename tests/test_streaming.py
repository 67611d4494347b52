from tessera.streaming.ingest import ingest, store_batch


def test_contents_are_stored_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))

    def put(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(src)
        ingest(stream, out, mark).awaitTermination()
        return sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect())

    put([(2, "b"), (1, "b"), (3, None), (4, "")])
    assert run() == [(1, "b"), (3, None)]
    put([(5, "b"), (6, "c")])
    assert run() == [(1, "b"), (3, None), (6, "c")]
    # a batch that is run again gives the same rows
    store_batch(spark.createDataFrame([(5, "b"), (6, "c")], "doc_id long, text string"), 1, out)
    assert spark.read.parquet(out).count() == 3
