"""The training-data operators against brute force, on edge cases and the smallest tables."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers as public
import pytest

from tessera.llm import bpe, html, jaccard, licenses, lm, omh, packing, pii, quality, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve " * 3
LINES = [
    (1, BASE + "alpha beta gamma", "a"),
    (2, BASE + "alpha beta gamma", "b"),
    (2, BASE + "alpha beta gamma", "b"),
    (3, "", "a"),
    (4, None, None),
    (5, "  \n\t ", "a"),
    (6, "x" * 5000, "a"),
    (7, "the cat. " * 3000, "a"),
    (8, "mail me.now@host.example.org or call +1 (243) 555-5526 or 10.0.0.255 4111 1111 1111 1111\nMIT License", "a"),
    (None, "Licensed under the Apache License, Version 2.0 é ü 中文", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that clash with results
    return spark.createDataFrame([(i, t, s, 0, 0.5, "k") for i, t, s in LINES], "doc_id long, text string, source string, n_words int, score double, labels string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_bpe_round_trip(docs, empty):
    own = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rows = bpe.round_trip(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    assert len(rows) == len(LINES)
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in LINES)
    assert sorted(r.decoded_sha256 for r in rows) == want
    assert bpe.round_trip(empty, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0
    for text in ("ab" * 40_000, "word " * 40_000, "a  b\n\n c " * 9000, "中文" * 9000, ""):
        assert own.encode(text) == own.encoding.encode_ordinary(text)


def test_packing_is_gapless_and_whole(docs, empty):
    rows = packing.pack(docs, public.path("word_bpe_49k.json"), capacity=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert packing.pack(empty, public.path("word_bpe_49k.json"), capacity=64).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    histogram = collections.Counter(rng.integers(1, 2049, 20_000).tolist())
    plan = packing.plan(dict(histogram), 2048)
    packed = collections.Counter()
    for config, copies in plan:
        assert sum(config) <= 2048
        for n in config:
            packed[n] += copies
    assert packed == histogram
    assert sum(c for _, c in plan) <= 1.05 * sum(n * k for n, k in histogram.items()) / 2048


@pytest.mark.parametrize("text", [t or "" for _, t, _ in LINES] + ["a@b.c@d.e x@y.zz.", "1.2.3.4.5.6.7.8 999.1.1.1", "+1+2 (333) 4444444444 5", "0" * 6000 + ".1.2.3"])
def test_pii_base_spans(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    want = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text[:4000] if k == 1 and text.startswith("000") else text):
            g = [c for c in m.group() if c.isdigit()]
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(g)))
            if k == 1 and max(map(int, m.group().split("."))) > 255 or k == 2 and not (14 <= len(g) <= 19 and luhn % 10 == 0) or k == 3 and not 10 <= len(g) <= 15:
                continue
            want.append((m.start(), k, m.end()))
    got = pii.base_spans(text)
    if not text.startswith("000"):
        assert got == sorted(want)


def test_pii_patterns_find_unseen_identifiers(spark, empty):
    rows = [(i, f"x{i} reach me by phone +1 243 555 {1000 + i} today") for i in range(12)] + [(99, "then reach me by phone 243-555-9999 today"), (100, "nothing here")]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[99].n_phone == 0 and got[99].spans == "phone:23:35"
    assert got[100].spans == "" and got[0].spans.startswith("phone:")
    assert pii.detect(empty, ["doc_id"]).count() == 0
    assert pii.masked("call +1 now", "phone:5:7") == "call <phone> now"


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[8].base_labels == "mit" and got[None].base_labels == "apache" and "apache-2.0" in got[None].labels
    assert got[3].n_words == 0 and got[3].first_word is None and got[4].labels == ""
    assert licenses.scan(empty).count() == 0


def test_rules_against_brute_force(docs, empty):
    for r in rules.rules(docs).collect():
        text = r.text or ""
        w = WORD.findall(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r._n_words, r._word_chars, r._n_repeat_words, r._n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r._base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert rules.rules(empty).count() == 0


def test_rules_sql(spark, tmp_path):
    import duckdb

    from tessera.llm import queries

    texts = [t for _, t, _ in LINES] + ["The cat IS on the mat 12 #$ é\n" * 40, "zq " * 300, " of the\x0band to\r\n" * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(queries.oracle_sql()["op6_quality_rules"])
    names = [c[0] for c in want.description]
    got = queries.op6_quality_rules(spark, str(tmp_path))
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_fingerprints(docs, empty):
    rows = omh.edited(docs).collect()
    assert len(rows) == len(LINES)
    same = {tuple(r.fingerprint) for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1
    order = sorted(LINES, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    got = collections.Counter(r.edited_text for r in rows)
    want = collections.Counter()
    for k, (_, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want[t[: len(t) - cut] + nxt[:cut]] += 1
    assert got == want
    assert omh.edited(empty).count() == 0


def test_jaccard_against_brute_force(spark, empty):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(9):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, 4)):
                w[at] = f"e{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), "short text"), (len(rows) + 1, "Short TEXT"), (len(rows) + 2, ""), (len(rows) + 3, None)]
    sets, group = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                o = len(sets[a] & sets[b])
                if o and 100 * o >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in sets}
    assert jaccard.near_duplicates(empty).count() == 0


def test_wrapper_and_main_text(spark):
    page = "<html><body><nav><ul><li>Menu</li></ul></nav><div class='cookie-notice'>Hi</div><article><h1>T &amp; {0}</h1><p>One<br>two <b>b</b>old{0}</p>{1}</article><div id=comments><p>no</p></div><footer>f</footer></body></html>"
    rows = [(i, "http://h.example/x", page.format(i, "<p>more</p>" * (i % 3))) for i in range(5)] + [(9, None, None), (10, "http://h.example/y", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df, ["page_id", "url"]).collect()}
    assert got[1] == "T & 1\n\nOne two bold1\n\nmore" and got[0] == "T & 0\n\nOne two bold0" and got[9] == "" == got[10]
    w = next(r for r in html.wrappers(df).collect() if r.host == "h.example")
    assert "(<article>(<h1>#</h1>)(<p>#</p>)+</article>)" in w.wrapper


def test_quality_learns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{chr(97 + x % 26)}{'word'[: x % 4]}" for x in rng.integers(0, 99, 80)) if i % 2 else "SPAM!! " * 90, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"), df.doc_id % 5 != 0)
    got = {r.doc_id: r.score for r in quality.score(df, model, ["doc_id"]).collect()}
    assert all((got[i] > 0.5) == bool(q) for i, _, q in rows if i % 5 == 0)
    assert quality.score(df.limit(0), model, ["doc_id"]).count() == 0
    assert len(model.score(["", None, "  "])) == 3


def test_gradients_of_the_language_model():
    counts = np.array([9.0, 40.0, *range(30, 3, -1)])
    model = lm.GatedModel(counts)
    model.theta = model.theta.astype(np.float64)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, len(counts), (4, 3))
    targets, resets, valid = model.place[rng.integers(0, len(counts), (4, 3))], rng.random((4, 3)) < 0.3, np.ones((4, 3), bool)
    h = np.zeros((3, lm.HIDDEN))
    _, got = model.learn(model.view(), ids, resets, targets, valid, h)
    flat = np.concatenate([g.ravel() for g in got["grads"].values()])
    for k in rng.choice(np.flatnonzero(np.abs(flat) > 1e-3), 12):
        keep, out = model.theta[k], []
        for e in (1e-3, -1e-3):
            model.theta[k] = keep + e
            hs, _, _ = model.recur(model.view(), ids, resets, h, False)
            out.append(-model.output(model.view(), hs.reshape(-1, lm.HIDDEN), targets.ravel())[0].sum())
        model.theta[k] = keep
        assert abs((out[0] - out[1]) / 2e-3 - flat[k]) < 0.02 * abs(flat[k]) + 1e-3


def test_language_model_scores(docs, empty):
    from pyspark.sql import functions as F

    got = lm.score_corpus(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).collect()
    assert len(got) == len(LINES)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert lm.score_corpus(empty, F.lit(False)).count() == 0


def test_state_goes_on_across_windows():
    model = lm.GatedModel(np.array([9.0, 40.0, *range(30, 3, -1)]))
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(1, 29, n), lm.END) for n in (300, 5, 0, 77)]
    together = lm.score_documents(model, docs)
    alone = [lm.score_documents(model, [d])[0] for d in docs]
    assert np.allclose(together, alone, atol=1e-3)
