"""Sharding by sampled splitters.

Method: draw size-weighted key samples, choose quantile boundaries among them,
range-partition the records by those boundaries, and subdivide the ranges that
hold more than their share. The key is (digest of the text, doc_id, number of
the record), so equal texts are neighbours in key order, and a group of copies
or of repeated rows that is larger than a range is divided by doc_id and then
by record instead of being kept in one task.

The ranges bound what a task orders. Shards are then cut at equal shares of the
exact running size over all ranges, which every range knows from the totals of
those before it: the splitters' sampling error moves work between tasks, never
bytes between shards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace

#: Expected number of sampled keys on the driver, whatever the input's size.
SAMPLES = 8192
#: Key ranges that the first boundaries make; an overfull one is divided again.
RANGES = 512
#: A range above this many times the mean size is subdivided.
OVERFULL = 2.0
OVERHEAD = 16
#: Digest of the text, doc_id, and a number that tells repeated rows apart.
KEY = ("h", "id", "tie")


def _sampled_keys(records: DataFrame, rate: float) -> list[tuple]:
    """(key, size) of records drawn with probability min(1, size * rate), in key order.

    Records are drawn apart from each other, so their number is near the total
    size times the rate.
    """
    drawn = F.pmod(F.xxhash64(*KEY, F.lit(77)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    rows = records.filter(drawn < F.col("size") * rate).select(*KEY, "size").collect()
    return sorted(((r.h, r.id, r.tie), r.size) for r in rows)


def quantile_boundaries(sample: list[tuple], parts: int, rate: float) -> list[tuple]:
    """Keys that cut the sample into ``parts`` pieces of equal weight.

    A drawn record stands for 1/p of its kind, so its weight is size/p: equal
    for all but those whose size alone exceeds 1/rate.
    """
    weights = [max(1.0, s * rate) for _, s in sample]
    total, seen, out = sum(weights), 0.0, []
    for (key, _), w in zip(sample, weights, strict=True):
        seen += w
        if seen >= total * (len(out) + 1) / parts and len(out) < parts - 1 and (not out or out[-1] < key):
            out.append(key)
    return out


def _assign(records: DataFrame, boundaries: list[tuple], column: str) -> DataFrame:
    """Adds the number of boundaries at or below each record's key."""
    schema = records.withColumn(column, F.lit(0)).schema

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in KEY), strict=True)
            found = pa.array([bisect_right(boundaries, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, column])

    return records.mapInArrow(ranges, schema)


def shard(docs: DataFrame, n_shards: int, workspace: Workspace | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    The law is ``bytes``: records in key order are cut at equal shares of the
    total size, so shard sizes differ from the mean by less than one record at
    each end. ``slot`` counts a shard's records from 0 in key order.

    Defined results: a null text has size 16 and the checksum of no bytes (0);
    a null doc_id is an ordinary record that sorts first among its copies;
    repeated rows are separate records, in any order among themselves; a very long
    text is one record; an empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    spark: SparkSession = docs.sparkSession
    ws = workspace or Workspace(spark, "sharding")
    text = F.coalesce(docs["text"], F.lit(""))
    records = ws.keep(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("id"),
            F.monotonically_increasing_id().alias("tie"),  # fixed once it is written
        ),
        "records",
    )
    total = records.agg(F.sum("size")).first()[0] or 0
    rate = SAMPLES / max(total, 1)
    sample = _sampled_keys(records, rate)
    ranged = _assign(records, quantile_boundaries(sample, RANGES, rate), "range")
    measured = {r["range"]: r.s for r in ranged.groupBy("range").agg(F.sum("size").alias("s")).collect()}
    mean = total / RANGES
    overfull = {k: s for k, s in measured.items() if s > OVERFULL * mean}
    if overfull:
        # draw again, only inside those ranges and more densely, and cut each of them finer
        dense = 16 * rate
        inside = _sampled_keys(ranged.filter(F.col("range").isin(list(overfull))), dense)
        more = list(quantile_boundaries(sample, RANGES, rate))
        cut = sorted(more)
        for k, s in overfull.items():
            own = [x for x in inside if bisect_right(cut, x[0]) == k]
            more += quantile_boundaries(own, int(s / mean) + 1, dense)
        ranged = _assign(records, sorted(set(more)), "range")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row a range, some hundreds in all: a single task orders them
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy(*KEY)
    placed = (
        ranged.join(F.broadcast(offsets), "range")  # at most a few times RANGES rows
        .withColumn("at", F.col("start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor((F.col("at") + F.col("size") / 2) * n_shards / F.lit(float(max(total, 1)))).cast("int")))
        .withColumn("nth", F.row_number().over(Window.partitionBy("range", "shard").orderBy(*KEY)))
    )
    placed = ws.keep(placed.select("doc_id", "size", "text_crc32", "range", "shard", "nth"), "placed")
    ws.drop_all_but("placed")
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), ["shard", "range"]).select(  # ranges plus shards rows at most
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
