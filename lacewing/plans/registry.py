"""All registered queries of the graph engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**graph_queries.Q, **vector_queries.Q}
ORACLE_SQL: dict[str, str] = {**graph_queries.S, **vector_queries.S}
