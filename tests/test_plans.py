"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tessera.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _text(v):
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(_text(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(_text(r[i]) for i in at) for r in want.fetchall())


def test_budget_of_nothing_keeps_nothing(spark):
    from pyspark.sql import functions as F

    from tessera.operators import ranking

    df = spark.createDataFrame([(1, 1, 3), (1, 2, 4)], "g int, o int, n int")
    assert ranking.budget_prefix(df, ["g"], [F.col("o")], F.col("n"), 0).count() == 0
    assert [r.o for r in ranking.budget_prefix(df, ["g"], [F.col("o")], F.col("n"), 6).collect()] == [1]


def test_overlap_windows(spark):
    from tessera.operators import chunks

    df = spark.createDataFrame([(1, "0123456789abcdefghijklmno"), (2, ""), (3, None)], "id int, t string")
    got = [(r.tokens, r.content) for r in chunks.windows(df, "id", "t", 10, 3).orderBy("id", "chunk_order").collect()]
    assert got == [(10, "0123456789"), (10, "789abcdefg"), (10, "efghijklmn"), (4, "lmno")]
    with pytest.raises(ValueError):
        chunks.windows(df, "id", "t", 3, 3)
