"""Files in and out: key-value stores, graphs, blocks, exports, and the choice of a parser by file name."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parser engines and the suffixes that they read (fixed values).
ENGINES = {"legacy": ["txt", "md", "html", "csv", "json", "xml", "log"], "native": ["docx"], "mineru": ["pdf", "png", "jpg"], "docling": ["pptx", "xlsx"]}


def save_store(rows: DataFrame, path: str, workspace: str) -> None:
    """Write one workspace of a key-value store as JSON lines; other workspaces below the path stay."""
    rows.write.mode("overwrite").json(f"{path}/workspace={workspace}")


def load_store(spark: SparkSession, path: str, workspace: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/workspace={workspace}")


def save_vectors(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """Vectors of a store; a vector of another dimension stops the read."""
    rows = spark.read.parquet(path)
    return rows.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has not {dimension} numbers"))))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a GraphML document as lines, nodes (node, kind) before edges (src, tgt, weight)."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), text(F.col("node")), F.lit('"><data key="kind">'), text(F.coalesce("kind", F.lit(""))), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), text(F.col("src")), F.lit('" target="'), text(F.col("tgt")), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("line"))
    return n.union(e)


def save_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder of text parts: a head, nodes, edges and an end; joined in the order of their names they are a document."""
    spark = nodes.sparkSession
    head = "".join(f"<key id={quoteattr(k)} for={quoteattr(w)} attr.name={quoteattr(k)} attr.type={quoteattr(escape(t))}/>" for k, w, t in (("kind", "node", "string"), ("weight", "edge", "double")))
    rows = graphml(nodes, edges)
    for k, df in enumerate([spark.createDataFrame([(f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{head}<graph edgedefault="undirected">',)], "line string"), rows.where("part = 1").select("line"), rows.where("part = 2").select("line"), spark.createDataFrame([("</graph></graphml>",)], "line string")]):
        df.write.mode("overwrite").text(f"{path}/{k}")


def load_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document as `save_graphml` writes it, a group a line."""
    lines = spark.read.text(f"{path}/*")
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    part = lambda p: plain(F.regexp_extract("value", p, 1))
    nodes = lines.where(F.col("value").startswith("<node ")).select(part('id="([^"]*)"').alias("node"), part('key="kind">([^<]*)<').alias("kind"))
    edges = lines.where(F.col("value").startswith("<edge ")).select(part('source="([^"]*)"').alias("src"), part('target="([^"]*)"').alias("tgt"), part('key="weight">([^<]*)<').cast("double").alias("weight"))
    return nodes, edges


def joined_blocks(blocks: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, text): the content rows of block files in order, joined by an empty line."""
    rows = blocks.where(F.col("type") == "content").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, "content"))).alias("_b"))
    return rows.select(*by, F.array_join(F.transform("_b", lambda x: x["content"]), "\n\n").alias("text"))


def export_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """csv with a header, md (a table) or txt (a row a line, fields named); values with a bar or line break are escaped in md."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    df.select(as_line(df, kind).alias("line")).write.mode("overwrite").text(path)


def as_line(df: DataFrame, kind: str) -> Column:
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if kind == "md":
        cells = [F.replace(F.replace(value(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in df.columns]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    if kind == "txt":
        return F.concat_ws("; ", *(F.concat(F.lit(f"{c}: "), F.replace(value(c), F.lit("\n"), F.lit(" "))) for c in df.columns))
    raise ValueError(f"unknown kind of export: {kind}")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def hint(path: Column) -> Column:
    """The directive in square brackets before the suffix: engine-options, as in a.[native-iet].docx; empty if there is none."""
    return F.regexp_extract(path, r"\.\[([^\]]*)\]\.[A-Za-z0-9]+$", 1)


def routed(files: DataFrame, path: str, rules: list[tuple[str, str]], engines: dict[str, list[str]] = ENGINES) -> DataFrame:
    """files with suffix, engine and options: the engine of the hint if it can read the suffix, else of the first rule
    (pattern, engine) that matches and can, else the first that can; null if none can."""
    able = {s: [e for e, ss in engines.items() if s in ss] for ss in engines.values() for s in ss}
    can = F.create_map(*(x for s, es in able.items() for x in (F.lit(s), F.array(*map(F.lit, es)))))
    df = files.withColumn("suffix", suffix(F.col(path))).withColumn("_hint", F.split(hint(F.col(path)), "-", 2)).withColumn("_can", F.coalesce(F.try_element_at(can, F.col("suffix")), F.array().cast("array<string>")))
    asked = F.get("_hint", F.lit(0))
    ruled = F.coalesce(*(F.when(F.col(path).rlike(p) & F.array_contains("_can", e), e) for p, e in rules), F.get("_can", F.lit(0)))
    return df.withColumn("engine", F.when(F.array_contains("_can", asked), asked).otherwise(ruled)).withColumn("options", F.coalesce(F.get("_hint", F.lit(1)), F.lit(""))).drop("_hint", "_can")
