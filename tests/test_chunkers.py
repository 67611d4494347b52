"""Chunkers as plain functions and over a table."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunkers as c

TEXTS = st.text(alphabet="ab .\n。é", max_size=120)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(2, 30))
def test_recursive_loses_nothing_and_fits(text, size):
    assert "".join(c._parts(text, size, c.SEPARATORS, len)) == text
    got = c.recursive(text, size)
    assert all(0 < len(x) <= size for x in got)
    assert "".join("".join(got).split()) == "".join(text.split())


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(4, 30), st.integers(0, 3))
def test_recursive_with_overlap_fits(text, size, overlap):
    assert all(len(x) <= size for x in c.recursive(text, size, overlap))


def test_recursive_prefers_coarse_marks():
    assert c.recursive("one two\n\nthree four\n\nfive", 12) == ["one two", "three four", "five"]
    assert c.recursive(None, 5) == [] and c.recursive("", 5) == []
    with pytest.raises(ValueError):
        c.recursive("a", 3, 3)


def test_semantic_breaks_between_topics():
    text = " ".join(["cats purr cats sleep."] * 6 + ["stocks fell stocks rose."] * 6)
    got = c.semantic(text, 1000, window=0)
    assert len(got) == 2 and "stocks" not in got[0] and "cats" not in got[1]
    assert c.semantic(text, 40, embed=None) == c.recursive(text, 40)
    assert c.semantic(None, 10) == []
    for kind in ("percentile", "standard_deviation", "interquartile", "gradient"):
        assert "".join("".join(c.semantic(text, 50, kind=kind)).split()) == "".join(text.split())
    with pytest.raises(ValueError):
        c.limit(np.array([1.0, 2.0]), "none")


def test_packing_and_groups():
    assert c.packed(["aa", "bb", "cccccc", "d"], 5) == ["aa bb", "ccccc", "c d"]
    assert c.row_groups([1] * 10, 4, 5) == [(0, 4), (4, 7), (7, 10)]
    assert c.row_groups([], 4, 5) == [] and c.row_groups([2, 2], 4, 5) == [(0, 2)]
    assert c.windows_to_end(25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]
    assert c.windows_to_end(3, 2, 9) == [(0, 2), (1, 3)]
    assert c.greedy_bins([9, 9, 9, 1], 10) == [[0, 1], [2, 3]]


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, "one two\n\nthree"), (2, ""), (3, None)], "doc int, text string")
    got = [tuple(r) for r in c.apply(df, "doc", "text", lambda t: c.recursive(t, 8)).collect()]
    assert got == [(1, 0, 7, "one two"), (1, 1, 5, "three")]
