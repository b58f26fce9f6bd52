"""Joins whose left side may hold a very frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many of the most frequent keys are heavy, at most; each other key has less than this part of the rows.
HEAVY_SHARE = 1024
#: A key with fewer rows is never heavy.
HEAVY_ROWS = 1000


def join_unique(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """The inner or left join of ``rows`` with ``lookup``, which has one row a key; keys are not null.

    Rows of a heavy key would all meet in one task. They stay where they are, and
    the lookup's rows of those keys, at most HEAVY_SHARE, are broadcast to them.
    ``rows``, or ``counted`` with the same keys, should be a written table: it is read once more to find such keys.
    """
    counts = (rows if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= HEAVY_ROWS)
    found = counts.orderBy(F.desc("_n")).limit(HEAVY_SHARE).drop("_n")
    heavy = found.collect()
    if not heavy:
        return rows.join(lookup, keys, how)
    heavy = F.broadcast(rows.sparkSession.createDataFrame(heavy, found.schema))
    hot = rows.join(heavy, keys, "left_semi").join(F.broadcast(lookup.join(heavy, keys, "left_semi")), keys, how)
    return hot.unionByName(rows.join(heavy, keys, "left_anti").join(lookup, keys, how))
