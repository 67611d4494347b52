"""Incremental ingest: a stream of documents into a store that holds each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import first_by


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def store_batch(docs: DataFrame, batch: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the new contents of one batch to path/batch=N; of equal contents the smallest id stays.

    A batch overwrites its own folder and looks at earlier ones only, so running it again after a failure changes nothing.
    Null and empty texts are one content.
    """
    rows = docs.withColumn("content_hash", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    new = first_by(rows, ["content_hash"], [F.col(id_col)])
    if _exists(docs, path):
        old = docs.sparkSession.read.option("basePath", path).parquet(path).where(F.col("batch") < batch).select("content_hash")
        new = new.join(old, "content_hash", "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest(stream: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Take in all that the source has now; a later call goes on where this one stopped."""
    return stream.writeStream.foreachBatch(lambda df, n: store_batch(df, n, path, id_col, text_col)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
