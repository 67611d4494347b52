"""Queries of cleaning and parsing, on texts that are put together from `part` with known damage, so that SQL can say the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import extraction
from .queries import _t, query


@query("SELECT p_partkey, p_name || ' <b>' AS said FROM part")
def sanitize_text(spark, sf_dir):
    raw = F.concat(F.lit(" \n"), F.substring("p_name", 1, 2), F.lit("\x07"), F.expr("substring(p_name, 3)"), F.lit("\x7f &lt;b&gt;\t"))
    return _t(spark, sf_dir, "part").select("p_partkey", clean.sanitized(raw).alias("said"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN '中文' || p_name WHEN 2 THEN 'A1-(' || p_name || ')' WHEN 3 THEN '' WHEN 4 THEN 'it\"s ' || p_name ELSE '中国' || p_name || ' 人' END AS name FROM part")
def normalize_names(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit('"'), n, F.lit('"<br/>'))).when(k == 1, F.concat(F.lit("“中 文  "), n, F.lit("”"))).when(k == 2, F.concat(F.lit("<P>Ａ１－（"), n, F.lit("）</p>")))
    raw = raw.when(k == 3, F.when(F.col("p_partkey") % 4 == 1, "12").otherwise(" 1.2.3 ")).when(k == 4, F.concat(F.lit('it"s '), n)).otherwise(F.concat(F.lit("‘中\"国 "), n, F.lit(" '人’")))
    return _t(spark, sf_dir, "part").select("p_partkey", clean.normalized_name(raw, True).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN repeat('中', 170) ELSE left(repeat(p_name, 60), 256) END AS name FROM part")
def truncate_identifier(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", clean.shortened(F.when(F.col("p_partkey") % 2 == 0, F.repeat(F.lit("中"), 200)).otherwise(F.repeat("p_name", F.lit(60)))).alias("name"))


#: Damaged marks, one for each form that is mended (fixed values).
DAMAGE = ["<|#|>", "<|##|>", "<|\\#|>", "<||>", "<x|#|y>", "<#|>", "<|#x>", "<||#>", "|#|>", "||#||"]


@query(f"SELECT p_partkey, 'entity<|#|>' || p_name || '<|#|>' || p_type AS line FROM part WHERE p_partkey % {len(DAMAGE)} < {len(DAMAGE)}")
def repair_delimiters(spark, sf_dir):
    mark = F.get(F.array(*map(F.lit, DAMAGE)), F.col("p_partkey") % len(DAMAGE))
    return _t(spark, sf_dir, "part").select("p_partkey", clean.mended(F.concat(F.lit("entity"), mark, F.col("p_name"), mark, F.col("p_type"))).alias("line"))


def _output(spark, sf_dir):
    """Six lines or marks of model output for each part; what becomes of each depends on p_partkey % 4."""
    k, n, b = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand")
    mark = F.get(F.array(*map(F.lit, DAMAGE[:4])), k)
    kind = F.when(k == 1, F.concat(F.lit(" , "), F.col("p_type"), F.lit(" X,other"))).when(k == 2, F.concat(F.col("p_type"), F.lit("(bad)"))).otherwise(F.col("p_type"))
    entity = F.concat(F.lit("entity"), mark, F.lit('"'), n, F.lit('"'), mark, kind, mark, F.lit("made by "), b)
    wrong = F.concat(F.lit("entity"), mark, n, mark, b, mark, F.lit("of，by"), mark, F.when(k == 3, "2.5").otherwise("a relation"))
    loop = F.concat_ws("<|#|>", F.lit("relation"), n, n, F.lit("x"), F.lit("a loop"))
    tail = F.concat_ws("<|#|>", F.lit("relationship"), b, F.lit("maker"), F.lit("kind"), F.lit("is a"))
    text = F.concat(entity, F.lit("\n"), wrong, F.lit("\n"), loop, F.lit("\n\n"), tail, F.lit("<|#|>entity<|#|>"), F.concat_ws("<|#|>", b, F.lit("brand"), F.lit("seen")), F.lit("<|COMPLETE|>"))
    return extraction.records(_t(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], F.col("text"))


@query("SELECT p_partkey, p_name AS name, lower(p_type) || CASE WHEN p_partkey % 4 = 1 THEN 'x' ELSE '' END AS kind, 'made by ' || p_brand AS description FROM part WHERE p_partkey % 4 <> 2 UNION ALL SELECT p_partkey, p_brand, 'brand', 'seen' FROM part")
def parse_output_entities(spark, sf_dir):
    return extraction.entities(_output(spark, sf_dir), ["p_partkey"]).select("p_partkey", "name", "kind", "description")


@query("SELECT p_partkey, p_name AS src, p_brand AS tgt, 'of,by' AS keywords, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'a relation' END AS description, 1.0::DOUBLE AS weight FROM part WHERE p_partkey % 4 <> 3 UNION ALL SELECT p_partkey, p_brand, 'maker', 'kind', 'is a', 1.0::DOUBLE FROM part")
def parse_output_relations(spark, sf_dir):
    return extraction.relations(_output(spark, sf_dir), ["p_partkey"]).select("p_partkey", "src", "tgt", "keywords", "description", "weight")


def _json_output(spark, sf_dir):
    k, n, b = F.col("p_partkey") % 3, F.col("p_name"), F.col("p_brand")
    body = F.concat(F.lit('{"entities": [{"name": "'), n, F.lit('", "type": "My '), F.col("p_type"), F.lit('", "description": "d"}, {"name": "", "type": "t", "description": "d"}], "relationships": [{"source": "'), n, F.lit('", "target": "'), b, F.lit('", "keywords": "a，b", "description": "r"}'))
    text = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("]}\n```"))).when(k == 1, F.concat(F.translate(body, '"', "'"), F.lit(",]}"))).otherwise(body)
    return _t(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query("SELECT p_partkey, p_name AS name, 'my' || lower(p_type) AS kind, 'd' AS description FROM part")
def json_entities(spark, sf_dir):
    return extraction.from_json(_json_output(spark, sf_dir), ["p_partkey"], F.col("text"))[0].select("p_partkey", "name", "kind", "description")


@query("SELECT p_partkey, p_name AS src, p_brand AS tgt, 'a,b' AS keywords, 'r' AS description FROM part")
def json_relations(spark, sf_dir):
    return extraction.from_json(_json_output(spark, sf_dir), ["p_partkey"], F.col("text"))[1].select("p_partkey", "src", "tgt", "keywords", "description")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|a, b' WHEN 1 THEN p_name || '|x|y' ELSE '' END AS high, CASE WHEN p_partkey % 3 = 2 THEN CASE WHEN length(p_name || repeat('?', p_size)) < 50 THEN p_name || repeat('?', p_size) ELSE '' END WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS low FROM part")
def keyword_payload(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    listed = F.concat(F.lit('<think>no</think>{"high_level_keywords": ["'), n, F.lit(' ", "a, b", ""], "low_level_keywords": ["'), F.col("p_brand"), F.lit('"]}'))
    text = F.when(k == 0, listed).when(k == 1, F.concat(F.lit("```\n{high_level_keywords: '"), n, F.lit("; x,y\\n', low_level_keywords: []}\n```"))).otherwise("sorry")
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(n, F.expr("repeat('?', p_size)")).alias("question"), extraction.keywords(text, "high_level_keywords").alias("high"), extraction.keywords(text, "low_level_keywords").alias("low"))
    return p.select("p_partkey", F.array_join("high", "|").alias("high"), F.array_join(extraction.fallback_keywords(F.col("high"), F.col("low"), F.col("question")), "|").alias("low"))


@query("SELECT p_partkey, p_brand || CASE WHEN p_size > 25 THEN ' → ' || p_type ELSE '' END || ' → ' || p_name AS path FROM part")
def heading_paths(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", clean.heading_path(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(""), F.when(F.col("p_size") > 25, F.col("p_type"))), F.col("p_name")).alias("path"))


@query("SELECT p_partkey, 'see ' || p_name || ' x+1 end' AS said FROM part")
def strip_multimodal(spark, sf_dir):
    raw = F.concat(F.lit('see <drawing id="1" /><table id="t">'), "p_name", F.lit("</table> <Equation>x+1</equation><drawing>pic</drawing> end"))
    return _t(spark, sf_dir, "part").select("p_partkey", clean.without_marks(raw).alias("said"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'unknown_source' ELSE p_name || '.pdf' END AS file FROM part")
def file_basenames(spark, sf_dir):
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit("/in/a/"), "p_name", F.lit(".pdf"))).when(k == 1, F.concat(F.lit("c:\\in\\"), "p_name", F.lit(".pdf"))).when(k == 2, F.concat(F.col("p_name"), F.lit(".pdf"))).otherwise(F.when(F.col("p_size") > 25, "  "))
    return _t(spark, sf_dir, "part").select("p_partkey", clean.base_name(path).alias("file"))


#: Words without weight in lexical evaluation (fixed values).
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with"]


def _tokens(text):
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 1) & ~w.isin(STOP))


_SQL_TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in STOP) + "))"


@query(f"""WITH b AS (SELECT item_id, text FROM benchmark WHERE item_id % 100 = 0), w AS (SELECT doc_id, unnest({_SQL_TOKENS.format('text')}) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT DISTINCT item_id, unnest({_SQL_TOKENS.format('text')}) AS w FROM b), s AS (SELECT item_id, doc_id, round(sum((1 + ln(tf)) * (ln((SELECT count(*) + 1 FROM documents) / (df + 1)) + 1)), 6) AS score FROM q JOIN tf USING (w) JOIN df USING (w) GROUP BY ALL)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def tfidf_ranking(spark, sf_dir):
    from ..operators.ranking import top_by

    b = _t(spark, sf_dir, "benchmark").where("item_id % 100 = 0")
    d = _t(spark, sf_dir, "documents")
    q = b.select("item_id", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("w"))
    # the words of the questions alone are counted and shuffled
    tf = d.select("doc_id", F.explode(_tokens(F.col("text"))).alias("w")).join(q.select("w").distinct(), "w", "left_semi").groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    n = d.agg((F.count("*") + 1).alias("n"))
    s = q.join(tf, "w").join(df, "w").join(F.broadcast(n), F.lit(True)).groupBy("item_id", "doc_id").agg(F.round(F.sum((1 + F.ln("tf")) * (F.ln(F.col("n") / (F.col("df") + 1)) + 1)), 6).alias("score"))
    return top_by(s.where("score > 0"), ["item_id"], [F.desc("score"), F.col("doc_id")], 5).select("item_id", "doc_id", "score", "rank")
