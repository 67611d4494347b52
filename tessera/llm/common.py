"""What the operators share: tables, folds, and the shared folder for intermediate tables."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows in an Arrow batch, about. Spark's own bounds (64 MB, 10,000 rows) let a task's worker and its JVM hold several times those beside the heap.
BATCH = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python workers in batches of about BATCH bytes; a longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


#: What this worker keeps for later tasks: one thing at most, by its key.
_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """make(), kept in this worker until a frugal task comes that does not name the key."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def _let_go(keeps: tuple | None) -> None:
    """A function of the module, for one inside another goes to the workers with a copy of _held."""
    if _held and keeps not in _held:
        _held.clear()
        _give_back()


def frugal(run: Callable[[Iterator], Iterator], keeps: tuple | None = None) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, whose worker gives free memory back after each batch and when the task ends: it waits for other tasks, with what it holds.

    What tasks of other operators have left with `held` goes first, unless `keeps` is its key; workers outlive their stages.
    """

    def each(batches):
        for b in batches:
            yield b
            _give_back()

    @functools.wraps(run)
    def out(batches):
        _let_go(keeps)
        try:
            yield from run(each(batches))
        finally:
            _give_back()

    return out


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


#: Rows of a table that is broadcast, at most; larger ones are joined by a shuffle.
BROADCAST = 1_000_000
#: Deletes a query's shuffle files when it has ended, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir, which the whole cluster sees; local sessions without it get one below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def settle(df: DataFrame, **metrics: Column) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs one task.

    What the write has seen on its way (the number of rows, and the given aggregates) is kept with the table: see `seen`.
    """
    spark = df.sparkSession
    path, before, kept = shared_folder(spark), spark.conf.get(_CLEAN, "false"), Observation()
    spark.conf.set(_CLEAN, "true")
    try:
        df.observe(kept, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items())).write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled = kept.get
    return out


def rows(df: DataFrame) -> int:
    """The number of rows of a settled table."""
    return df.settled["rows"]


def small(df: DataFrame, of: DataFrame | None = None, most: int = BROADCAST) -> DataFrame:
    """df marked for broadcast if the settled table `of` that it comes from, or df itself, has at most `most` rows."""
    return F.broadcast(df) if rows(df if of is None else of) <= most else df


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(d, label), settled: the smallest id of the component, for each id that occurs in links (a, b), by alternating stars.

    Each step sends a node's neighbours to its smallest neighbour: to all of them that are larger, then to all that are
    smaller. It works on sums and joins alone, so a node may have any number of links, and ends when nothing changes.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark, seen = F.bit_xor(F.xxhash64("u", "v")), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        less = large.join(low, "u")
        nxt = settle(less.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), mark=mark)
        discard(edges)
        if nxt.settled == seen:
            break
        seen, edges = nxt.settled, nxt
    out = settle(nxt.select(F.col("u").alias("d"), F.col("v").alias("label")).union(nxt.select(F.col("v").alias("d"), F.col("v").alias("label")).distinct()))
    discard(nxt)
    return out
