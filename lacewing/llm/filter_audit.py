"""Filter interaction audit: what each of five filters removes, alone and in every order.

One scan of the text buffers gives each document a mask of the filters that it
fails: byte classes and prefix sums count words, capitals, code points and
symbols, and sorted word hashes, verified byte by byte, count distinct words.
The fifth filter, repeated texts, is decided by digests of whole texts. Masks
are then counted by part, at most 32 rows each, and all 120 orders are read off
those counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_unique
from .store import Workspace
from .wordspans import chunks, distinct_per_text, per_text, word_spans

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10

#: Bits of a byte's class.
WORD, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8
_CLASS = np.full(256, WORD | POINT, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = POINT
_CLASS[ord("A") : ord("Z") + 1] |= CAPITAL
_CLASS[[ord(c) for c in "#$%&*|"]] |= SYMBOL
_CLASS[0x80:0xC0] = WORD  # the second and later bytes of a code point

ROWS = "doc_id long, part string, fails int, digest binary"


def text_failures(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mask of filters A to D that each of the adjacent texts fails."""
    kind = _CLASS[data]
    starts, stops, upto = word_spans(kind & WORD != 0, ends)
    n_words = np.diff(upto)
    capitals, symbols, points = (per_text(kind & bit != 0, ends) for bit in (CAPITAL, SYMBOL, POINT))
    fails = (n_words < MIN_WORDS).astype(np.int32)
    fails |= (100 * distinct_per_text(data, starts, stops, upto) < MIN_DISTINCT_PERCENT * n_words).astype(np.int32) << 1
    fails |= (100 * capitals > MAX_CAPITALS_PERCENT * points).astype(np.int32) << 2
    return fails | (symbols > 0).astype(np.int32) << 3


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part, the mask of failed text filters and a digest of the text, a row an input row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, ends in chunks(b.column(2)):
                digests = [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                n = len(digests)
                columns = [b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(text_failures(data, ends), pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "fails", "digest"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(scan, ROWS)


def failures(docs: DataFrame, labels: DataFrame, workspace: Workspace) -> DataFrame:
    """A written row for each input row: doc_id, part, fails (bits A to E from the lowest), good, toxic.

    A digest with more than one doc_id is looked up by its rows; where one text
    makes up much of the table, its rows stay where they are.
    """
    rows = workspace.keep(scanned(docs), "scanned")
    firsts = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    late = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    rows = join_unique(rows, firsts, ["digest"], "left").select("doc_id", "part", F.col("fails").bitwiseOR(late).alias("fails"))
    rows = workspace.keep(rows, "judged")
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic"))
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = marks.filter("doc_id is not null").groupBy("doc_id").agg(mark("quality").alias("good"), mark("toxic").alias("toxic")).filter("good or toxic")
    known = join_unique(rows.filter("doc_id is not null"), marks, ["doc_id"], "left")
    nameless = rows.filter("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    no = F.lit(False)
    return known.unionByName(nameless).select("doc_id", "part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, the step's filter as a bit, those before it as bits) of all orders of the filters."""
    out = []
    for p in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(p, 1):
            own = 1 << FILTERS.index(letter)
            out.append(("".join(p), step, own, before))
            before |= own
    return out


def audit(docs: DataFrame, labels: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """A row for each part, order of the five filters and step, with the counts of documents within the part.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. Defined results: a null text is an empty
    one; a null lang belongs to part '' ; a row without doc_id never repeats
    another and is never repeated, and has no labels; rows repeated with doc_id
    and text count each and don't repeat each other; a doc_id with several
    labels is good or toxic if one of them says so; an empty table has no parts
    and gives no rows; a text has any length; other columns are not read.
    """
    ws = workspace or Workspace(docs.sparkSession, "audit")
    marked = failures(docs, labels, ws)
    counts = marked.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("n_good"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"))
    counts = ws.keep(counts, "counts")
    ws.drop_all_but("counts")
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, s, own, before in orders()])
    each = counts.select("*", F.inline(steps))
    own = F.col("fails").bitwiseAND(F.col("own")) != 0
    gone = F.col("fails").bitwiseAND(F.col("before")) != 0
    total = lambda test, n, name: F.sum(F.when(test, F.col(n)).otherwise(F.lit(0))).cast("long").alias(name)
    rows = each.groupBy("part", "filter_order", "step", "own").agg(
        total(~own & ~gone, "n", "kept"),
        total(own & ~gone, "n", "removed"),
        total(own & gone, "n", "redundant"),
        total(F.col("fails") == F.col("own"), "n", "unique_fails"),
        total(own & ~gone, "n_good", "good_lost"),
        total(own & ~gone, "n_toxic", "toxic_lost"),
    )
    # a window holds the 120 rows of a part and a filter
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
