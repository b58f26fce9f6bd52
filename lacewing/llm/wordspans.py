"""Spans of bytes in adjacent texts: words by byte class, their hashes, and exact comparison.

Arrow's text buffer is looked at as one array of bytes; a table of 256 entries
gives each byte its class, and prefix sums of class bits, read at the texts'
ends, count per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .wordhash import _STEP, _U, _lanes, column_bytes, mix

#: Bytes of text worked on together; a longer text is a chunk of its own. Bounds the working memory to some 60 times this.
CHUNK_BYTES = 1 << 20
#: So many texts a chunk at most, so that a text's number takes 16 bits.
CHUNK_TEXTS = (1 << 16) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, ends from 0 on) of groups of adjacent texts; nulls are empty."""
    data, offsets = column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n, at + CHUNK_TEXTS)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes each text has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[ends])


def word_spans(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, words before each text's end) of the maximal runs of ``inside``; none crosses an end."""
    border = np.zeros(len(inside) + 1, bool)
    border[ends] = True
    near = np.zeros(len(inside) + 2, bool)
    near[1:-1] = inside
    starts = np.flatnonzero(inside & (~near[:-2] | border[:-1]))
    stops = np.flatnonzero(inside & (~near[2:] | border[1:])) + 1
    return starts, stops, np.searchsorted(starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    n_lanes = (lengths + 7) >> 3
    upto = np.cumsum(n_lanes)
    place = np.arange(upto[-1]) - np.repeat(upto - n_lanes, n_lanes)
    values = _lanes(data, np.repeat(starts, n_lanes) + 8 * place, np.repeat(lengths, n_lanes) - 8 * place)
    values = mix(values + (place + 1).astype(np.uint64) * _U(_STEP))
    return mix(np.add.reduceat(values, upto - n_lanes) + lengths.astype(np.uint64))


def same_bytes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Is span a[i] the same bytes as span b[i]? Spans are not empty."""
    lengths = stops - starts
    equal = lengths[a] == lengths[b]
    at = np.flatnonzero(equal)
    if len(at):
        size = lengths[a[at]]
        n_lanes = (size + 7) >> 3
        upto = np.cumsum(n_lanes)
        place = 8 * (np.arange(upto[-1]) - np.repeat(upto - n_lanes, n_lanes))
        left = np.repeat(size, n_lanes) - place
        one, other = (_lanes(data, np.repeat(starts[x[at]], n_lanes) + place, left) for x in (a, b))
        equal[at] = np.logical_and.reduceat(one == other, upto - n_lanes)
    return equal


def distinct_per_text(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many different words each text has.

    Hashes are sorted within each text; neighbours with one hash are compared
    byte by byte, and a text in which two different words share a hash is
    counted by its words themselves.
    """
    n_words = np.diff(upto)
    hashes = span_hashes(data, starts, stops)
    text = np.repeat(np.arange(len(n_words), dtype=np.uint16), n_words)
    order = np.argsort(hashes)
    order = order[np.argsort(text[order], kind="stable")]
    again = np.flatnonzero((text[order[1:]] == text[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]]))
    a, b = order[again], order[again + 1]
    verified = same_bytes(data, starts, stops, a, b)
    out = n_words - np.bincount(text[a], minlength=len(n_words))
    for t in np.unique(text[a[~verified]]):
        out[t] = len({data[starts[i] : stops[i]].tobytes() for i in range(upto[t], upto[t + 1])})
    return out


def numbered_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each word, equal exactly for equal words; the first place of each number)."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    if same_bytes(data, starts, stops, np.arange(len(starts)), first[number]).all():
        return number, first
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts, stops, strict=True)])
    return number, np.unique(number, return_index=True)[1]


def strings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    lengths = stops - starts
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, lengths)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at].tobytes())])
