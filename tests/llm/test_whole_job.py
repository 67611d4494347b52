"""What the operators once left out, against brute force."""

import itertools

import public_tokenizers as public
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, jaccard, licenses, packing, pii, quality


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def _linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def _copies(stem, n):
    """n near copies of one text, each with another word changed at its end."""
    base = [f"{stem}{i}" for i in range(80)]
    return [" ".join([*base, f"{stem}x{k}"]) for k in range(n)]


def test_bpe_white_space_before_a_long_match():
    own = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    for gap in ("\n\n", "\n", "  ", " \n \n\n", "\t\t ", "  "):
        for text in ("end" + gap + "a" * 17000, gap + "a" * 17000 + gap + "9" * 17000 + gap, "end" + gap + "b" + gap + "!" * 17000 + "c"):
            assert own.encode(text) == own.encoding.encode_ordinary(text)


def test_licenses_with_two_notices(spark):
    firsts, seconds = ("isc", "bsd", "mit-text"), ("apache-2.0", "gpl-licensed", "mit-notice", "cc-by-nc")
    both = list(itertools.product(firsts, seconds))
    rows = [(i, f"{licenses.TEMPLATES[a][0]} and then {licenses.TEMPLATES[b][0]}") for i, (a, b) in enumerate(both)]
    rows += [(100 + i, "nothing of the kind is said in this text") for i in range(100)]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({a, b} <= set(got[i]) for i, (a, b) in enumerate(both))
    assert got[100] == [""]


def test_jaccard_gives_every_link(spark):
    texts = [*_copies("p", 12), *_copies("q", 3), _copies("p", 1)[0].upper(), "alone", "", None]
    sets = _sets(texts)
    want = {(j, i, len(sets[i] & sets[j])) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] != sets[j] and _linked(sets[i], sets[j])}
    want = {w for w in want if 15 not in w[:2]}  # the copy in capitals is of the class of the first text
    got = jaccard.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(want) == 12 * 11 // 2 + 3
    assert {(max(r.a, r.b), min(r.a, r.b), r.overlap) for r in got} == want


def test_near_duplicates_of_null_and_repeated_ids(spark):
    p, q, r, s = (_copies(x, 4) for x in "pqrs")
    rows = [(None, p[0]), (None, q[0]), (None, q[1]), (None, "alone"), (7, r[1]), (7, r[0]), (7, s[0]), (3, s[1]), (1, "other"), (1, "other"), (2, ""), (2, None), (None, None), (5, p[1])]
    sets = _sets([t for _, t in rows])
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if _linked(sets[i], sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] or "")
    want = [rows[min((k for k in range(len(rows)) if group[k] == g), key=key)] for g in set(group)]
    text = lambda x: (str(x[0]), str(x[1]))
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "a") for i, t in some], "doc_id long, text string, source string")
        got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(map(text, got.select("doc_id", "text").collect())) == sorted(map(text, want))


def test_pipeline_rules_reject_text_without_common_words(spark):
    name = lambda i: chr(97 + i % 26) * 2 + chr(97 + i // 26) * 3
    junk = " | ".join(name(i) + name(i + 1) for i in range(120))
    words = [name(i) for i in range(510)]
    for i in range(0, 510, 17):
        words[i] = f"the {words[i]} of the {words[i + 1]} and {words[i + 2]} to {words[i + 3]} in a"
    clean = " ".join(words)
    docs = spark.createDataFrame([(1, junk), (2, clean), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.check_rules(spark, docs, "").collect()] == [2]


def test_pipeline_sends_workers_little_at_once(spark):
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    bound, spark_own = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    spark.conf.set(bound, spark_own)
    assert corpus_pipeline.redact(spark, docs, "").where("length(text) = 4000").count() == 4000
    sizes = [r.n for r in docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()]
    assert sum(sizes) > 16_000_000 and max(sizes) < 5_000_000
    sent = lambda df: df._jdf.queryExecution().analyzed().children().head().output().size()
    assert sent(pii.find(docs, docs.columns)) == sent(quality.score(docs, quality.AttentionMil(), docs.columns)) == 2


def test_word_cache_is_bounded_and_keeps_first_words(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 60)
    monkeypatch.setattr(packing, "KEPT", 20)
    path = public.path("word_bpe_49k.json")
    own, plain = packing.WordIds(path), Tokenizer.from_file(path)
    for k in range(30):
        text = "the end, of it. " + " ".join(f"w{k}x{i}," for i in range(10))
        assert own([text])[0] == b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids)
        assert len(own.known) <= 60 + 30 and "end," in own.known


def test_workers_keep_no_words_for_other_operators(spark):
    docs = spark.range(0, 64, 1, 32).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"))
    path = public.path("word_bpe_49k.json")

    def alive(batches):
        import gc

        found = [sum(type(x).__name__ == "WordIds" for x in gc.get_objects())]
        yield from (pa.RecordBatch.from_arrays([pa.array(found)], names=["n"]) for _ in batches)

    def left() -> int:
        """Each of the workers that wait gets a task."""
        return sum(r.n for r in spark.range(0, 64, 1, 32).mapInArrow(alive, "n long").collect())

    assert packing.pieces(docs, path, 64, 0).count() == 2 * 64
    assert left() > 0  # for the next tasks of packing
    assert len(quality.score(docs, quality.AttentionMil(), ["doc_id"]).collect()) == 64
    assert left() == 0


def test_classifier_features_do_not_depend_on_the_texts_taken_together(monkeypatch):
    texts = [None, "", "One line, two. " * 900, "x" * 5000, "a b\n" * 3000, " "]
    own, row = quality.passages(texts)
    monkeypatch.setattr(quality, "GROUP", 1 << 21)
    once, row_once = quality.passages(texts)
    assert (own == once).all() and (row == row_once).all()
    monkeypatch.undo()
    assert max(sum(map(len, parts)) for _, parts in quality._slices(["word " * 400] * 2000)) <= quality.GROUP + 2000
