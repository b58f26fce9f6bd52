"""Exact substring dedup with a compressed FM-index per shard.

A window of T words is a repeat when its word sequence also starts in a
document with a smaller doc_id. Windows are routed by content: the smallest
k-gram hash of a window (its minimizer) is the same wherever the window occurs,
so windows that share it meet in one shard, as segments of neighbouring windows
with one minimizer. Minimizers that occur in a single document are left out.

Each shard sorts the suffixes of its segments and keeps two wavelet matrices of
packed bit vectors with rank directories, one of the Burrows-Wheeler transform
and one of the document at each suffix; neither the suffix array nor the text
stays in the index. The segments are streamed through it: backward search gives
each position's matching statistic up to T words, extending all windows word by
word and giving up those whose interval is down to their own single occurrence.
Intervals that reach T words are reported, with the smallest doc_id among their
occurrences, a range minimum in the second matrix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_unique
from .store import Workspace
from .wordhash import ngrams, range_keys, signed, word_hashes

WINDOW = 13
GRAM = 5
#: Words in a shard's index, on average.
SHARD_WORDS = 400_000
#: A minimizer with more words than this in its distinct segments is routed window by window.
HOT_WORDS = 50_000
#: Hot minimizers are broadcast up to this many (8 MB), which HOT_WORDS times as many words must bring.
BROADCAST_GRAMS = 1 << 20
#: Minimizers that a task holds before it passes them on.
TASK_ROWS = 600_000
_U = np.uint64
LAST = (1 << 63) - 1


def sequence_key(words: np.ndarray) -> int:
    """A digest of the whole word sequence."""
    return int(range_keys(words, np.array([0]), np.array([len(words)]))[0])


def minimizers(words: np.ndarray) -> np.ndarray:
    """The smallest k-gram hash of each window; empty below WINDOW words."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64)
    g = ngrams(words, GRAM)
    width, span = WINDOW - GRAM + 1, 1
    while span < width:
        # the least of twice as many, or of the width, from two that overlap
        step = min(span, width - span)
        g = np.minimum(g[:-step], g[step:])
        span += step
    return g


class BitVector:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((_U(1) << (i & 63).astype(np.uint64)) - _U(1)))


class WaveletMatrix:
    """Ranks of any symbol in a sequence and least symbols of its ranges, a bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = ((symbols >> b) & 1).astype(np.uint8)
            self.levels.append((b, BitVector(bit)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def places(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i places lead in the order by symbol below the last level: a symbol's own start and its rank."""
        for b, v in self.levels:
            ones = v.ones(i)
            i = np.where((symbol >> b) & 1 == 1, v.zeros + ones, i - ones)
        return i

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest symbol of each non-empty range."""
        value = np.zeros(len(low), np.int64)
        for b, v in self.levels:
            low_ones, high_ones = v.ones(low), v.ones(high)
            zero = high - high_ones > low - low_ones
            value += np.where(zero, 0, 1 << b)
            low = np.where(zero, low - low_ones, v.zeros + low_ones)
            high = np.where(zero, high - high_ones, v.zeros + high_ones)
        return value


class FMIndex:
    """Backward search over a text of symbols from 2 on; 1 ends a segment and 0 the text.

    ``owner`` is a number at each place of the text, here of the document; the
    smallest one of an interval can be asked for.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        n = len(text)
        top = int(text.max(initial=1)) + 1
        if top > 1 << 21:
            raise ValueError(f"{top} symbols: three of them don't fit in a key of 63 bits")
        padded = np.concatenate([text, np.zeros(2, np.int64)])
        # prefix doubling, from three symbols on
        key, h = (padded[:n] * top + padded[1 : n + 1]) * top + padded[2:], 3
        while True:
            order = np.argsort(key)
            k = key[order]
            rank = np.zeros(n, np.int64)
            rank[order[1:]] = np.cumsum(k[1:] != k[:-1])
            if rank[order[-1]] == n - 1 or h >= n:
                break
            key = rank * (n + 1)
            key[:-h] += rank[h:] + 1
            h *= 2
        self.matrix = WaveletMatrix(text[order - 1].astype(np.int32), max(1, (top - 1).bit_length()))
        self.owners = WaveletMatrix(owner[order].astype(np.int32), max(1, int(owner.max(initial=0)).bit_length()))
        self.first = np.searchsorted(np.sort(text), np.arange(top + 1))
        # a symbol's start in the matrix is the same for all its ranks
        self.shift = self.first[:top] - self.matrix.places(np.arange(top), np.zeros(top, np.int64))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns extended by one symbol to the left."""
        both = self.matrix.places(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.shift[symbol] + both[: len(low)], self.shift[symbol] + both[len(low) :]

    def matches(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched length, low, high) of the pattern of up to ``length`` symbols before each end.

        A pattern whose interval is down to one suffix, its own, isn't extended.
        """
        got = np.ones(len(ends), np.int64)
        low, high = self.first[text[ends - 1]], self.first[text[ends - 1] + 1]
        open_ = np.flatnonzero(high - low > 1)
        for k in range(2, length + 1):
            if not len(open_):
                break
            low[open_], high[open_] = self.step(text[ends[open_] - k], low[open_], high[open_])
            got[open_] = k
            open_ = open_[high[open_] - low[open_] > 1]
        return got, low, high


def smallest_documents(words: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
    """For each segment, the smallest document among all occurrences of each of its windows."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words)
    _, symbols, times = np.unique(flat, return_inverse=True, return_counts=True)
    # a word that stands once in the shard is in no repeat: such words share symbol 2, and their windows aren't searched
    single = times[symbols] == 1
    symbols = np.where(single, 0, np.cumsum(times > 1)[symbols])
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    text = np.ones(len(flat) + len(words) + 1, np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    inside = np.arange(len(flat)) + np.repeat(np.arange(len(words)), lengths)
    text[inside] = symbols + 2
    text[-1] = 0
    ranked, rank = np.unique(docs, return_inverse=True)
    index = FMIndex(text, np.append(rank[owner], 0))
    n_windows = lengths - WINDOW + 1
    of = np.repeat(np.arange(len(words)), n_windows)
    cut = np.cumsum(n_windows)[:-1]
    ends = np.concatenate([np.arange(s + WINDOW, s + z + 1) for s, z in zip(starts, lengths, strict=True)])
    before = np.zeros(len(text) + 1, np.int64)
    before[1 + inside] = single
    np.cumsum(before, out=before)
    asked = np.flatnonzero(before[ends] == before[ends - WINDOW])
    got, low, high = index.matches(text, ends[asked], WINDOW)
    least = docs[of].copy()
    full = np.flatnonzero((got == WINDOW) & (high - low > 1))
    if len(full):
        # equal windows have equal intervals and different ones disjoint intervals
        lows, first, back = np.unique(low[full], return_index=True, return_inverse=True)
        least[asked[full]] = ranked[index.owners.least(lows, high[full][first])][back]
    return np.split(least, cut)


def _documents(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(index, sequence key, word hashes) of each text; the keys of many texts are made at once."""
    for at, words, offsets in word_hashes(column, lower=False):
        keys = range_keys(words, offsets[:-1], offsets[1:]).tolist()
        for i, key in enumerate(keys):
            yield at + i, key, words[offsets[i] : offsets[i + 1]]


def _joined(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()  # by ASCII white space: the same separators


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, ord, tkey, n_words, the sequence's digest, and the digest of the text with nothing removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sha = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
            for i, tid, words in _documents(b.column(1)):
                n[i], key[i] = len(words), tid
                sha.append(hashlib.sha256(b" ".join(_joined(b.column(1)[i].as_py()))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n), pa.array(key), pa.array(sha, pa.string())], names=["doc_id", "ord", "tkey", "n_words", "tid", "sha"])

    return docs.mapInArrow(run, "doc_id long, ord long, tkey long, n_words long, tid long, sha string")


def _repeated_minimizers(docs: DataFrame) -> DataFrame:
    """(tid, grams): each sequence's minimizers that other sequences have too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        grams: list[np.ndarray] = []
        tids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            g, t = np.concatenate(grams), np.concatenate(tids)
            grams.clear()
            tids.clear()
            order = np.argsort(g, kind="stable")
            g, t = g[order], t[order]
            start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            # two of a minimizer's sequences go and prove to other tasks that it is repeated; the rest needn't meet them
            known = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g)))) >= 2
            return pa.RecordBatch.from_arrays([pa.array(np.where(known, t, g)), pa.array(g), pa.array(t), pa.array(known)], names=["key", "gram", "tid", "known"])

        for b in batches:
            for _, tid, words in _documents(b.column(0)):
                if len(words) >= WINDOW and tid not in seen:
                    seen.add(tid)
                    grams.append(signed(np.unique(minimizers(words))))
                    tids.append(np.full(len(grams[-1]), tid, np.int64))
                    size += len(grams[-1])
                    if size > TASK_ROWS:
                        yield flush()
                        size = 0
        if grams:
            yield flush()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by gram and tid; a gram's first row waits until a second sequence shows up
        gram, tid, several = None, None, False
        for b in batches:
            known = b.column(3).to_numpy(zero_copy_only=False)
            g, t = b.column(1).to_numpy(), b.column(2).to_numpy()
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(g[known]), pa.array(t[known])], names=["gram", "tid"])
                g, t = g[~known], t[~known]
            if not len(g):
                continue
            new_gram = np.append(True, g[1:] != g[:-1])
            new_gram[0] = g[0] != gram
            new = new_gram | np.append(t[0] != tid, t[1:] != t[:-1])
            run = np.cumsum(new_gram)  # 0: the run that was open before
            counts = np.bincount(run[new], minlength=run[-1] + 1)
            counts[0] += 0 if gram is None else (2 if several else 1)
            keep = new & (counts[run] > 1)
            out = [np.stack([g[keep], t[keep]], 1)]
            if gram is not None and not several and counts[0] > 1:
                out.append(np.array([[gram, tid]], np.int64))
            last_several = counts[run[-1]] > 1
            rows = np.concatenate(out)
            # an open run of one row is told later, if at all
            gram, tid, several = g[-1], t[-1], bool(last_several)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["gram", "tid"])

    rows = docs.select("text").mapInArrow(emit, "key long, gram long, tid long, known boolean")
    found = rows.repartition("key").sortWithinPartitions("gram", "tid").mapInArrow(repeated, "gram long, tid long")
    return found.groupBy("tid").agg(F.collect_set("gram").alias("grams"))


SEGMENT = "tid long, ord long, start int, gram long, seg long, words binary"


def _segments(docs: DataFrame, wanted: DataFrame, base: DataFrame) -> DataFrame:
    """Segments of neighbouring windows with one repeated minimizer, of one document for each sequence.

    A content that a task has sent before travels without its words. Where very
    many rows repeat doc_id and text, they stay where they are, and each task
    that has some sends the segments.
    """
    rows = join_unique(docs, wanted.select("ord", "tkey", "tid", "grams"), ["ord", "tkey"], counted=base).select("tid", "ord", "grams", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sent: set[tuple[int, int]] = set()
        for b in batches:
            tids, ords = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for i, tid, words in _documents(b.column(3)):
                if tid in seen or tid != tids[i]:
                    continue
                seen.add(tid)
                m = minimizers(words)
                grams = np.sort(b.column(2)[i].values.to_numpy()).view(np.uint64)
                grams.sort()
                hit = grams[np.minimum(np.searchsorted(grams, m), len(grams) - 1)] == m
                change = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                stops = np.append(change[1:], len(m)) + WINDOW - 1
                use = hit[change]
                starts, stops = change[use], stops[use]
                keys = list(zip(signed(m[starts]).tolist(), range_keys(words, starts, stops).tolist(), strict=True))
                raw = words.tobytes()
                out[0] += [tids[i]] * len(keys)
                out[1] += [ords[i]] * len(keys)
                out[2] += starts.tolist()
                out[3] += [k[0] for k in keys]
                out[4] += [k[1] for k in keys]
                for k, a, z in zip(keys, starts.tolist(), stops.tolist(), strict=True):
                    out[5].append(None if k in sent else raw[8 * a : 8 * z])
                    sent.add(k)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])

    return rows.mapInArrow(run, SEGMENT)


def _cut_windows(segments: DataFrame) -> DataFrame:
    """(gram, seg, at, window, ord, words): each different window of a segment by itself, with all its places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for gram, seg, ord_, words in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                w = np.frombuffer(words, np.uint64)
                starts = np.arange(len(w) - WINDOW + 1)
                keys, first, back, times = np.unique(range_keys(w, starts, starts + WINDOW), return_index=True, return_inverse=True, return_counts=True)
                n = len(keys)
                places = np.split(np.argsort(back, kind="stable").astype(np.int32), np.cumsum(times)[:-1])
                parts = [words[8 * at : 8 * (at + WINDOW)] for at in first.tolist()]
                for column, v in zip(out, ([gram] * n, [seg] * n, places, keys.tolist(), [ord_] * n, parts), strict=True):
                    column += v
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["gram", "seg", "at", "window", "ord", "words"])

    return segments.select("gram", "seg", "ord", "words").mapInArrow(run, "gram long, seg long, at array<int>, window long, ord long, words binary")


def _searched(segments: DataFrame, shards: int) -> DataFrame:
    """(gram, seg, least): the FM-index of each shard, and its segments streamed through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def finish() -> pa.RecordBatch:
            grams, segs, ords, words = zip(*rows, strict=True)
            least = smallest_documents([np.frombuffer(w, np.uint64) for w in words], np.array(ords, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(segs, pa.int64()), pa.array(least, pa.list_(pa.int64()))], names=["gram", "seg", "least"])

        for b in batches:
            for s, *row in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if s != shard:
                    if rows:
                        yield finish()
                    shard, rows = s, []
                rows.append(row)
        if rows:
            yield finish()

    placed = segments.select(F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int").alias("shard"), "gram", "seg", "ord", "words")
    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "gram long, seg long, least array<long>")


def dedup(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Removed are the words that a repeat covers, judged on the input. Defined
    results: a null text has no words; documents of fewer than WINDOW words lose
    none; a missing doc_id counts as larger than all others; rows repeated with
    their doc_id don't repeat each other, since no doc_id is smaller; an empty
    table gives no rows; other columns aren't read; one very long text is one
    document like others, whole. Sequences are compared by 64-bit word hashes, in
    full by the index. A passage that very many documents share is split: its
    minimizer's windows are routed by their own digests.
    """
    ws = workspace or Workspace(docs.sparkSession, "substring-dedup")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # a row is found again by doc_id and text: many rows may lack a doc_id or share one
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("tkey"))
    base = ws.keep(_base(docs), "base")
    first = base.filter(f"n_words >= {WINDOW}").groupBy("tid").agg(F.min(F.struct("ord", "tkey")).alias("f")).select("tid", "f.ord", "f.tkey")
    wanted = ws.keep(_repeated_minimizers(docs).join(first, "tid"), "wanted")
    segments = ws.keep(_segments(docs, wanted, base), "segments")
    # max skips the rows that travel without words; equal content has equal words
    contents = ws.keep(segments.groupBy("gram", "seg").agg(F.min("ord").alias("ord"), F.max("words").alias("words")), "contents")
    words = contents.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0] // 8
    shards = int(words // SHARD_WORDS) + 1
    hot = ws.keep(contents.groupBy("gram").agg((F.sum(F.length("words")) / 8).alias("c")).filter(F.col("c") > HOT_WORDS).select("gram"), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_GRAMS else hot
    cold = contents.join(hot, "gram", "left_anti")
    windows = ws.keep(_cut_windows(contents.join(hot, "gram")), "windows")
    # of a hot minimizer each different window is one row, routed by its own digest
    apart = windows.groupBy("window").agg(F.min("ord").alias("ord"), F.max("words").alias("words")).select(F.col("window").alias("gram"), F.lit(None).cast("long").alias("seg"), "ord", "words")
    least = ws.keep(_searched(cold.unionByName(apart), shards), "least")
    by_window = join_unique(windows.drop("words"), least.filter("seg is null").select(F.col("gram").alias("window"), F.get("least", F.lit(0)).alias("m")), ["window"])
    placed = F.flatten(F.transform(F.collect_list(F.struct("at", "m")), lambda x: F.transform(x["at"], lambda at: F.struct(at.alias("at"), x["m"].alias("m")))))
    hot_least = by_window.groupBy("gram", "seg").agg(F.transform(F.sort_array(placed), lambda x: x["m"]).alias("least"))
    found = join_unique(segments.drop("words"), least.filter("seg is not null").unionByName(hot_least), ["gram", "seg"])
    repeats = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("ord"), F.col("start") + i.cast("int"))), lambda x: x.isNotNull())
    found = found.select("tid", "ord", repeats.alias("at")).filter(F.size("at") > 0)
    gone = found.groupBy("tid").agg(F.flatten(F.collect_set("at")).alias("at")).join(first, "tid")
    changed = ws.keep(_removed(docs, ws.keep(gone, "gone"), base).dropDuplicates(["tid"]), "changed")
    known = ws.keep(first.select("tid", F.col("ord").alias("first")).join(changed, "tid", "left"), "known")
    rows = join_unique(base, known, ["tid"], "left")
    ws.drop_all_but("base", "known")
    copy = F.col("ord") > F.col("first")
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _removed(docs: DataFrame, gone: DataFrame, base: DataFrame) -> DataFrame:
    """(tid, n_removed, kept) of the sequences that lose words; several equal rows where very many rows repeat doc_id and text."""
    rows = join_unique(docs, gone, ["ord", "tkey"], counted=base).select("tid", "at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            tids = b.column(0).to_pylist()
            out: list[list] = [[], [], []]
            for i, tid, hashes in _documents(b.column(2)):
                if tid in seen or tid != tids[i]:
                    continue
                seen.add(tid)
                edge = np.zeros(len(hashes) + 1, np.int64)
                at = b.column(1)[i].values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = [w for w, c in zip(_joined(b.column(2)[i].as_py()), covered.tolist(), strict=True) if not c]
                for column, v in zip(out, (tids[i], int(covered.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["tid", "n_removed", "kept"])

    return rows.mapInArrow(run, "tid long, n_removed long, kept string")
