"""Every query with SQL gives the rows that DuckDB finds by itself."""

import os

import duckdb
import pytest

from lacewing.plans import graph_queries, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cells(df):
    columns = sorted(df.columns)
    text = df[columns].map(lambda v: f"{v:.6g}" if isinstance(v, float) else str(v))
    return columns, sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert cells(got) == cells(duck.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(graph_queries.EXAMPLES))
def test_generators_equal_sql(spark, duck, name):
    made, text = graph_queries.EXAMPLES[name]
    got = made(spark, SF).toPandas()
    assert name not in registry.QUERIES and len(got) and (text is None or cells(got) == cells(duck.execute(text).df()))


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert {r.bucket for r in rows} == {"1:0,1:0,2:0", "2:1,2:1,2:1"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
