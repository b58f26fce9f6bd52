"""Whole Arrow text columns to word hashes, vectorised over many texts at once.

A word is read in lanes of eight bytes. Each lane is mixed with its place, the
mixed lanes are added and the sum is mixed with the word's length, so no
arrangement of bytes cancels and two different words collide with a probability
of about 2**-64. A word has the same hash wherever it stands and on every
machine. Separators are single ASCII bytes, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed together; bounds the working memory to some 20 times this.
CHUNK_BYTES = 1 << 19
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
#: The bytes of a lane that belong to a word with so many bytes left.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _hash_chunk(data: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of adjacent texts, and how many words each text has."""
    if lower:
        data = _LOWER[data]
    inside = (data != 0x20) & (data - np.uint8(0x09) > 4)
    # a text's first byte starts a word even when the text before ends inside one
    first = np.zeros(len(data) + 1, bool)
    first[ends[:-1]] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | first[1:])) + 1
    counts = np.diff(np.searchsorted(starts, ends))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = stops - starts
    n_lanes = (lengths + 7) >> 3
    ends = np.cumsum(n_lanes)
    place = np.arange(ends[-1]) - np.repeat(ends - n_lanes, n_lanes)
    values = _lanes(data, np.repeat(starts, n_lanes) + 8 * place, np.repeat(lengths, n_lanes) - 8 * place)
    values = mix(values + (place + 1).astype(np.uint64) * _U(_STEP))
    return mix(np.add.reduceat(values, ends - n_lanes) + lengths.astype(np.uint64)), counts


def _lanes(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, those after the word's last one as zeros."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    aligned = padded.view("<u8")
    word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    # the second shift is split: a shift by 64 isn't defined
    got = aligned[word] >> shift | aligned[word + 1] << (_U(63) - shift) << _U(1)
    return got & _MASKS[np.minimum(left, 8)]


def word_hashes(column: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, offsets by text) of groups of texts.

    Groups hold CHUNK_BYTES of text or a single longer one.
    """
    data, offsets = column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        piece = data[offsets[at] : offsets[to]]
        hashes, counts = _hash_chunk(piece, offsets[at : to + 1] - offsets[at], lower)
        yield at, hashes, np.concatenate([[0], np.cumsum(counts)])
        at = to


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (order counts); empty below n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mix(out)


def range_keys(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A digest of each stretch of the word sequence, the same wherever it stands.

    Each word is mixed with its place in the stretch before it is added, so no
    arrangement of words cancels.
    """
    lengths = stops - starts
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    values = mix(words[np.repeat(starts, lengths) + place] + (place + 1).astype(np.uint64) * _U(_STEP))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mix(total[ends] - total[ends - lengths] + lengths.astype(np.uint64)).view(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
