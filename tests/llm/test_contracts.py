"""The queries of the contract against plain restatements of it, on the smallest tables and on hard texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers as public
import pytest

import corpus_pipeline
from tessera.llm import html, jaccard, licenses, omh, packing, pii, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_language_model_base(spark, texts):
    tokens = {i: [*WORD.findall(_lower(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = queries.op1_lm_score(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ws = tokens[r.doc_id]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0


def test_quality_folds(spark, texts):
    for r in queries.op2_quality_classifier(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_license_base(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in queries.op4_license_scan(spark, SF).collect():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(texts[r.doc_id]))
        at = [(i, k) for p, k in phrases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        want = (len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(want[4].split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licenses_all_templates_in_one_text_and_one_document(spark):
    every = " and then ".join(t for t, _ in licenses.TEMPLATES.values())
    mit = licenses.TEMPLATES["mit"][0].replace("without limitation", "without any limitation at all")
    rows = [(1, every), (2, mit)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(licenses.TEMPLATES) <= got[1] and "mit" in got[2]
    alone = licenses.scan(spark.createDataFrame(rows[1:], "doc_id long, text string")).collect()[0]
    assert "mit" in alone.labels.split(",") and alone.score > 0.9


def test_packing_ids_are_the_tokenisers(spark, texts):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    pieces = "hello World, it's. | <|endoftext|> | <|ENDOFTEXT|> | İ. | İ, | éÀ. | x²,3. | a b | don't! | 中文。| \x85 | #tag. | K̸. | \n\n | \t ".split(" | ")
    rnd = random.Random(3)
    own = packing.WordIds(path)
    hard = [" ".join(rnd.choices(pieces, k=12)) for _ in range(200)] + ["".join(rnd.choices(pieces, k=8)) for _ in range(200)] + list(texts.values())
    for t, ids in zip(hard, own(hard), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids), t
    by = collections.defaultdict(list)
    for r in queries.op7_packing(spark, SF).collect():
        by[r.doc_id].append(r)
    assert by.keys() == texts.keys()
    for i, rows in by.items():
        ids = [*plain.encode(texts[i], add_special_tokens=False).ids, 0]
        for k, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            cut = ids[k * 2048 : (k + 1) * 2048]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, k * 2048, len(cut), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in cut)))
        assert sum(r.length for r in rows) == len(ids)


def test_fingerprints_feel_order_in_short_texts(spark):
    words = [f"w{i}" for i in range(12)]
    swapped = words[6:] + words[:6]
    rows = [(3, " ".join(words)), (2, " ".join(swapped)), (1, " ".join(words)), (0, "")]
    got = {r.doc_id: r for r in omh.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = set(got[3].fingerprint), set(got[2].fingerprint)
    assert got[3].fingerprint == got[1].fingerprint and got[0].fingerprint == []
    assert len(a) == len(b) == 64 and len(a & b) / 64 < 0.7


def test_bootstrapping_reaches_second_patterns(spark):
    rows = [(i, f"x reach me by phone +1 243 555 {1000 + i} today") for i in range(12)]
    rows += [(100 + i, f"then reach me by phone 243-555-{2000 + i} today") for i in range(2)]
    rows += [(200 + i, f"our fax line 243-555-{2000 + i} ends") for i in range(2)] + [(300 + i, f"our fax line +1 243 555 {1000 + i} ends") for i in range(7)]
    rows += [(400, "our fax line 999-555-0000 ends"), (401, "unlike 999-555-7777 here")]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, spans string, n_email int")
    got = {r.doc_id: r.spans for r in pii.detect(docs.select("doc_id", "text"), ["doc_id"]).collect()}
    assert got[400] == "phone:13:25" and got[401] == ""
    kept = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert kept[400].text == "our fax line <phone> ends" and kept[400].spans == "a" and kept[400].n_email == 1


def test_wrapper_constants_and_headers(spark):
    page = "<html><body><header><h1>Site name</h1></header><div class='x'><p>{0} one.</p><p>Subscribe today for free.</p><h2>{0} two</h2><p>{0} three, long enough to be the larger part of all the text that is on this page.</p></div><p>Copyright 2020 Example</p></body></html>"
    rows = [(i, "http://h.example/x", page.format(f"Text{i}")) for i in range(6)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.main_text(df, ["page_id", "url"]).collect()}
    assert got[3] == "Text3 one.\n\nText3 two\n\nText3 three, long enough to be the larger part of all the text that is on this page."
    # copies of one page keep their text
    same = spark.createDataFrame([(i, u, rows[0][2]) for i, u, _ in rows], "page_id long, url string, html string")
    assert {"Subscribe" in r.text for r in html.main_text(same, ["page_id", "url"]).collect()} == {True}
    assert html.main_text(df.limit(0), ["page_id", "url"]).count() == 0


def test_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "<p>inside</p><nav>menu</nav>" + "</div>" * 20_000
    long = "<article>" + "".join(f"<h2>h{i}</h2><p>t{i}</p>" if i % 3 else f"<p>s{i}</p>" for i in range(20_000)) + "</article>"
    other = long.replace("<h2>h5</h2>", "<ul><li>x</li></ul>")
    rows = [(1, "http://a/1", deep), (2, "http://b/1", long), (3, "http://b/2", other)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got[1] == "inside" and got[2].startswith("s0\n\nh1\n\nt1") and got[2].endswith("t19999")


def test_jaccard_of_a_family_and_repeated_rows(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(150):  # one family of near copies, with chains through texts that are no links of each other
        base = [f"b{i}" for i in range(90)]
        for at in rnd.sample(range(90), k % 4):
            base[at] = f"e{k}x{at}"
        rows.append((k % 140, " ".join(base)))
    for k in range(500, 800):
        rows.append((k, " ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(0, 60)))))
    rows += [(900, "long " * 30_000), (901, "long " * 20_000), (902, rows[0][1].upper())]
    sets = [_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    want = collections.Counter((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True))
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, n int, set string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == want


def _shingles(text):
    w = WORD.findall(_lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stages_keep_columns_of_any_name(spark):
    names = "doc_id long, text string, n_chars long, score double, _kept boolean, spans string, rid long, _text string, _n_words int, row int"
    clean = "It is the year of the cat and a dog was in the house for the day. " * 2
    rows = [(i, clean + " ".join(f"word{i}x{k} and the" for k in range(60)) + f" call +1 243 555 {1000 + i}", 1, 0.5, True, "s", 7, "t", 3, 4) for i in range(8)] + [(9, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, names)
    out = corpus_pipeline.redact(spark, docs, "")
    assert out.columns == docs.columns and out.where("doc_id = 9 AND text IS NULL").count() == 1
    got = out.where("doc_id = 1").collect()[0]
    assert got.text.endswith("call <phone>") and got.n_chars == len(got.text) and got.spans == "s" and got.rid == 7
    for stage in (corpus_pipeline.check_rules, corpus_pipeline.drop_near_duplicates):
        for part in (docs, docs.limit(0)):
            assert stage(spark, part, "").columns == docs.columns
    assert corpus_pipeline.classify(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.pack(spark, docs, "").select("doc_id").distinct().count() == 9


def test_pipeline_runs(spark, texts):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= texts.keys() and all(r.offset + r.length <= 2048 for r in rows)


def test_hash_of_base_spans(spark, texts):
    for r in queries.op3_pii(spark, SF).collect():
        base = pii.base_spans(texts[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
