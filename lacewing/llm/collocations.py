"""Phrase collocations by Apriori level-wise passes.

Level k counts phrases of k words in each language. A pass over the texts emits
a phrase only when both phrases of k - 1 words that it overlaps are frequent:
the level before is broadcast as a table of bits, addressed by two hashes of a
phrase, whose size is bounded. A bit set by chance lets a phrase through that is
then counted and dropped, so bits decide what is counted and never what is
found. Words are numbered within a piece of text by hash and compared byte by
byte, phrases meet in Spark as strings, so counts are exact. The best cut of a
phrase is scored from the level tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_unique
from .store import Workspace
from .wordhash import _LOWER, _U, column_bytes, mix, ngrams, signed
from .wordspans import CHUNK_BYTES, numbered_words, span_hashes, strings, word_spans

MIN_COUNT = 30
LONGEST = 4
COVER_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
#: Parts in which a language's phrases are ranked before its first ones are.
PARTS = 16
#: Bits of a level's table: so many a phrase, within these bounds (32 MB at most).
BITS_A_PHRASE, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

_BLANK, _BREAK = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[ord(c) for c in ".,;:!?"]] = _BREAK
_CLASS[0x0A:0x0E] = _BREAK

#: A phrase's words and its language, which may hold blanks, joined by blanks: one key to move and compare.
COUNTS = "key string, n long"


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, ends) of groups of texts; a text longer than a chunk is cut, after a break only, into parts."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1))
        begin, end = offsets[at], offsets[to]
        while end - begin > CHUNK_BYTES:  # one long text
            breaks = np.flatnonzero(_CLASS[data[begin : begin + CHUNK_BYTES]] == _BREAK)
            cut = begin + (breaks[-1] + 1 if len(breaks) else CHUNK_BYTES)
            while not len(breaks) and cut < end:
                breaks = np.flatnonzero(_CLASS[data[cut : min(end, cut + CHUNK_BYTES)]] == _BREAK)
                cut = cut + (breaks[0] + 1 if len(breaks) else CHUNK_BYTES)
            cut = min(cut, end)
            if cut >= end:
                break
            yield at, data[begin:cut], np.array([0, cut - begin])
            begin = cut
        yield at, data[begin:end], np.concatenate([[0], offsets[at + 1 : to + 1] - begin])
        at = to


def prints_of(hashes: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
    """A print of the k words from each place on, in the language of the first."""
    return mix(ngrams(hashes, k) ^ lang[: len(hashes) - k + 1])


@lru_cache(4096)
def _lang_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class Bits:
    """Which phrases are frequent: two bits of a table each; a phrase that isn't may pass by chance."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = _U(64 * len(words) - 1)

    @staticmethod
    def places(prints: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return prints & mask, (prints >> _U(32)) & mask

    def has(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), bool)
        for place in self.places(prints, self.mask):
            out &= (self.words[place >> _U(6)] >> (place & _U(63)) & _U(1)).astype(bool)
        return out


def _prints(level: DataFrame) -> DataFrame:
    """The print of each phrase of a level table."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lang = np.array([_lang_hash(x) for x in b.column(0).to_pylist()], np.uint64)
                data, offsets = column_bytes(b.column(1))
                ends = offsets - offsets[0]
                data = data[offsets[0] : offsets[-1]]
                starts, stops, upto = word_spans(_CLASS[data] == 0, ends)
                k = int(upto[1] - upto[0])  # phrases of a table have as many words
                every = prints_of(span_hashes(data, starts, stops), np.repeat(lang, k), k)
                yield pa.RecordBatch.from_arrays([pa.array(signed(every[::k]))], names=["print"])

    return level.select("lang", "phrase").mapInArrow(prints, "print long")


def frequent_bits(level: DataFrame) -> Bits:
    """The bits of a written level table; Spark combines them, and at most MOST_BITS travel."""
    wanted = BITS_A_PHRASE * level.count()
    bits = LEAST_BITS
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = lambda c: c.bitwiseAND(F.lit(bits - 1).cast("long"))
    places = _prints(level).select(F.explode(F.array(place(F.col("print")), place(F.shiftrightunsigned("print", 32)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    return Bits(table.view(np.uint64))


def _grams(data: np.ndarray, ends: np.ndarray, lang_code: np.ndarray, lang_hash: np.ndarray, k: int, frequent: Bits | None):
    """(language codes, phrases, counts) of the phrases of k words in one piece of text."""
    data = _LOWER[data]
    kind = _CLASS[data]
    starts, stops, upto = word_spans(kind == 0, ends)
    if len(starts) < k:
        return None
    hashes = span_hashes(data, starts, stops)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(upto))
    # words of a phrase have one text and as many breaks before them
    breaks = np.cumsum(kind == _BREAK)[starts]
    places = len(starts) - k + 1
    good = (text[:places] == text[k - 1 :]) & (breaks[:places] == breaks[k - 1 :])
    if k > 1:
        passes = frequent.has(prints_of(hashes, lang_hash[text], k - 1))
        good &= passes[:places] & passes[1 : places + 1]
    at = np.flatnonzero(good)
    if not len(at):
        return None
    # only words of phrases that pass are numbered
    used = np.zeros(len(starts), bool)
    for j in range(k):
        used[at + j] = True
    own = np.flatnonzero(used)
    starts, stops = starts[own], stops[own]
    number, first = numbered_words(data, starts, stops, hashes[own])
    place = (np.cumsum(used) - 1)[at]
    key = lang_code[text[at]]
    for j in range(k):
        # renumbered at each word, so that the product stays small
        key = np.unique(key, return_inverse=True)[1] * len(first) + number[place + j]
    _, where, counts = np.unique(key, return_index=True, return_counts=True)
    words = strings(data, starts[first], stops[first])
    parts = [words.take(pa.array(number[place[where] + j])) for j in range(k)]
    return lang_code[text[at[where]]], pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], counts


def phrase_counts(docs: DataFrame, k: int, frequent: Broadcast | None = None) -> DataFrame:
    """key, n: the phrases of k words whose overlapping parts pass, each with all its occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value if frequent is not None else None
        for b in batches:
            langs = b.column(0).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            named = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)
            data, offsets = column_bytes(b.column(1))
            for at, piece, ends in _pieces(data, offsets):
                own = codes[at : at + len(ends) - 1]
                found = _grams(piece, ends, own, named[own], k, bits)
                if found is not None:
                    code, phrases, counts = found
                    keys = pc.binary_join_element_wise(phrases, langs.dictionary.take(pa.array(code)), " ")
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int64))], names=["key", "n"])

    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text")).filter("text is not null")
    return rows.mapInArrow(count, COUNTS).groupBy("key").agg(F.sum("n").alias("n"))


def _unpacked(counts: DataFrame, k: int) -> DataFrame:
    """lang, phrase, n of keys of k words."""
    parts = F.split("key", " ", k + 1)
    return counts.select(F.get(parts, F.lit(k)).alias("lang"), F.array_join(F.slice(parts, 1, k), " ").alias("phrase"), "n")


def levels(docs: DataFrame, workspace: Workspace, least: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n: all its words), and the written tables of frequent phrases of 1, 2, ... words."""
    words = workspace.keep(_unpacked(phrase_counts(docs, 1), 1), "words")
    totals = workspace.keep(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    found = [workspace.keep(words.filter(F.col("n") >= least), "level1")]
    workspace.drop("words")
    context = docs.sparkSession.sparkContext
    for k in range(2, longest + 1):
        bits = context.broadcast(frequent_bits(found[-1]))
        found.append(workspace.keep(_unpacked(phrase_counts(docs, k, bits).filter(F.col("n") >= least), k), f"level{k}"))
        bits.unpersist()
    return totals, found


def _part(words: str, start, length) -> F.Column:
    return F.array_join(F.slice(F.col(words), start, length), " ")


def best_cuts(found: list[DataFrame], workspace: Workspace) -> DataFrame:
    """lang, phrase, a, score, cut, l, r of the lowest-scoring cut of each phrase of two words or more."""
    rows = None
    for k, level in enumerate(found[1:], 2):
        own = level.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("cut"))
        own = own.select("lang", "phrase", "a", "cut", _part("w", F.lit(1), F.col("cut")).alias("left"), _part("w", F.col("cut") + 1, F.lit(k) - F.col("cut")).alias("right"))
        rows = own if rows is None else rows.unionByName(own)
    counts = None
    for level in found[:-1]:
        own = level.select("lang", "phrase", "n")
        counts = own if counts is None else counts.unionByName(own)
    # every part of a frequent phrase is frequent, so the joins find it
    for side, count in (("left", "l"), ("right", "r")):
        lookup = counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        rows = workspace.keep(join_unique(workspace.keep(rows, f"cuts_{side}"), lookup, ["lang", side]), f"with_{side}")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    rows = rows.withColumn("_top", wide("a") * F.lit(SCALE)).withColumn("_both", wide("l") + wide("r"))
    rows = rows.withColumn("score", F.expr("cast(_top div _both as bigint)"))
    return rows.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")


def covered(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, longest: the largest count of a longer frequent phrase that holds the phrase."""
    rows = None
    for k, level in enumerate(found[2:], 3):
        parts = [(i, size) for size in range(2, k) for i in range(1, k - size + 2)]
        own = level.withColumn("w", F.split("phrase", " "))
        own = own.select("lang", F.col("n").alias("f"), F.explode(F.array(*[_part("w", F.lit(i), F.lit(size)) for i, size in parts])).alias("phrase"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine(docs: DataFrame, workspace: Workspace | None = None, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Defined results: a null text is empty and a null lang is ``und``; a null
    doc_id, repeated rows and columns of other names don't matter, each row
    counts; a lang without a frequent phrase, like an empty table, gives no
    rows; texts have any length, a piece of text never crosses a break; equal
    scores and counts are ordered by the phrase's bytes.
    """
    ws = workspace or Workspace(docs.sparkSession, "collocations")
    totals, found = levels(docs, ws, least)
    best = ws.keep(best_cuts(found, ws), "best")
    kept = best.join(covered(found), ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer").cast("decimal(20,0)") < F.lit(COVER_PERCENT) * F.col("a").cast("decimal(20,0)"))
    )
    # the first rows of a part of a lang's phrases, then of the lang: its last task sees PARTS times as many, whatever the input
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    ranked = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ws.keep(ranked.drop("part"), "ranked")
    ws.drop_all_but("ranked", "totals")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
