"""The driver's entry points on the smallest tables; the training-data queries are left to their own tests."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
PACK = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["page_id", "ord", "text_content"]


@pytest.mark.parametrize("name", PACK)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert shown(df.select(*columns).collect()) == shown(want)
