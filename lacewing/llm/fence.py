"""Columns that are computed once, whatever the optimizer moves around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, made by a generator of one row.

    Projections are merged and conditions are pushed by putting definitions in
    place of names. Where the name stands inside a lambda, the definition would
    run for every element; neither crosses a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    """A row for each element of ``array``, added as ``name``; none for an empty array.

    The outer form infers no condition on the array, which would compute it twice.
    """
    return df.select("*", F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
