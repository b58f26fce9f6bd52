"""Hashes that any SQL engine reproduces, in place of process-salted ones."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_int(c: Column) -> Column:
    """The first 32 bits of the MD5 as a non-negative integer."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def md5_uniform(c: Column) -> Column:
    """A number in [0, 1) that depends on the value only."""
    return md5_int(c) / F.lit(4294967296.0)


def md5_bucket(c: Column, dim: int) -> Column:
    return (md5_int(c) % dim).cast("int")
