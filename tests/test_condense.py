"""Condensing by rounds and the last split before embedding, against plain folds and examples."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.operators import chunkers, chunks, condense


def _model():
    # made inside a function, so that it is sent to workers, which cannot import this module
    return lambda texts: f"{len(texts)}{''.join(t[:1] for t in texts)}"


model = _model()
model.__module__ = "__main__"


def plain(texts, context, most, least):
    if len(texts) == 1:
        return texts[0], False
    used = False
    while sum(map(len, texts)) > context and len(texts) > 2:
        texts, used = [model(g) if len(g) > 1 else g[0] for _, g in condense.groups(((0, t) for t in texts), context)], True
    return ("|".join(texts), used) if len(texts) < least and sum(map(len, texts)) < most else (model(texts), True)


@given(st.lists(st.text("ab", max_size=9), max_size=30), st.integers(1, 20))
def test_runs_lose_nothing_and_have_two(texts, context):
    got = [g for _, g in condense.groups(((0, t) for t in texts), context)]
    assert [t for g in got for t in g] == texts
    assert all(len(g) > 1 for g in got[:-1])
    assert all(sum(map(len, g)) <= context or len(g) <= 2 for g in got)


def test_rounds_equal_a_plain_fold(spark):
    sets = {"lone": ["x" * 90], "few": ["a", "b"], "many": [f"{i:02d}text" for i in range(60)], "long": ["y" * 50, "z" * 60, "w" * 70], "two": ["p" * 80, "q" * 80], None: ["c", "d"], "tie": ["e"] * 9}
    rows = [(k, i, t) for k, v in sets.items() for i, t in enumerate(v)] + [("gone", 0, None)]
    df = spark.createDataFrame(rows, "k string, o int, d string")
    got = {r.k: (r.d, r.used) for r in condense.condensed(df, "k", "o", "d", model, context=40, most=30, least=4, mark="|").collect()}
    assert got == {k: plain(v, 40, 30, 4) for k, v in sets.items()}
    assert condense.condensed(df.where("false"), "k", "o", "d", model).count() == 0


def test_limited():
    assert chunkers.limited("One. Two! Three?", 9) == ["One.\n\nTwo!", "Three?"]
    assert chunkers.limited("x" * 25 + ". b", 10) == ["x" * 10, "x" * 10, "x" * 5 + ".", "b"]
    assert chunkers.limited("short", 10) == ["short"]
    assert chunkers.limited(None, 5) == chunkers.limited(" \n ", 1) == []


def test_split_windows(spark):
    df = spark.createDataFrame([(1, "abc|defghij||k"), (2, ""), (3, None)], "id int, t string")
    got = [tuple(r) for r in chunks.split_windows(df, "id", "t", "|", 4, 1).collect()]
    assert got == [(1, 0, 3, "abc"), (1, 1, 4, "defg"), (1, 2, 4, "ghij"), (1, 3, 1, "j"), (1, 4, 0, ""), (1, 5, 1, "k"), (2, 0, 0, "")]
    with pytest.raises(Exception, match="limit is 4"):
        chunks.split_windows(df, "id", "t", "|", 4, 1, only=True).collect()
    assert chunks.split_windows(df.where("id = 1"), "id", "t", "|", 9, 1, only=True).count() == 4


def test_within_limit_names_pieces(spark):
    df = spark.createDataFrame([(1, "c0", 0, "One. Two! Three?"), (1, "c1", 1, "ok"), (1, "c2", 2, "  "), (2, "d0", 0, None)], "id int, chunk_id string, chunk_order int, content string")
    got = [(r.chunk_id, r.content, r.split_part, r.split_total) for r in chunks.within_limit(df, "id", 9).collect()]
    assert got == [("c0-s01", "One.\n\nTwo!", 1, 2), ("c0-s02", "Three?", 2, 2), ("c1", "ok", None, None)]
