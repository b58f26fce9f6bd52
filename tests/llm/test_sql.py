"""Queries with SQL give the rows that DuckDB finds by itself."""

import duckdb
import pytest

from lacewing.llm import queries

from ..test_queries import cells

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert cells(queries.QUERIES[name](spark, SF).toPandas()) == cells(con.execute(queries.ORACLE_SQL[name]).df())


def test_the_other_queries_give_a_row_a_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)):
        assert queries.QUERIES[name](spark, SF).count() == n, name
