"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

Leaves hold the rank of each adjacent pair of a pre-token (infinity where the
pair can't merge) together with its position; inner nodes hold the minimum, so
the root is the leftmost lowest-rank merge. A merge changes three leaves, each
a logarithmic point update, and encoding ends when the root is infinite. Short
pre-tokens are encoded side by side, one tree per row of an array; longer ones
run through the same tree one at a time. Texts are cut as the library's own
pre-tokenizer cuts them; see ``pretokens``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .pretokens import Agreement

#: Pre-tokens of up to this many bytes are encoded side by side.
WIDE = 32
#: Pre-tokens that a worker process keeps; the first ones, since frequent words come early.
REMEMBERED = 120_000
#: Characters of text taken together, or one longer text.
GROUP_CHARS = 500_000
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NONE = np.int64(1) << 62


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in byte order.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class SegmentTree:
    """Minimum over leaves of (rank, position), with point updates."""

    def __init__(self, ranks: list[float]):
        self.size = 1
        while self.size < max(1, len(ranks)):
            self.size *= 2
        inf = (float("inf"), -1)
        self.node = [inf] * (2 * self.size)
        for i, r in enumerate(ranks):
            self.node[self.size + i] = (r, i)
        for k in range(self.size - 1, 0, -1):
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def update(self, i: int, rank: float) -> None:
        k = self.size + i
        self.node[k] = (rank, i)
        k //= 2
        while k:
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])
            k //= 2

    def lowest(self) -> tuple[float, int]:
        return self.node[1]


class ByteBPE:
    """A byte-level vocabulary with its merges, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        to_byte = {c: b for b, c in byte_characters().items()}
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in self.vocab.items() if all(c in to_byte for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.zeros(256, np.int64)
        for b, c in byte_characters().items():
            self.first[b] = self.vocab[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self._table()
        self.split = regex.compile(_SPLIT)
        self.to_byte = to_byte
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.agreement = Agreement(self.split.findall, self._library_cut)
        self.around = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.recent: dict[str, tuple[str, int, bytes]] = {}  # what the texts at hand need besides

    def _table(self) -> None:
        """Open-addressing table of pair -> (rank, merged id), for whole arrays of pairs."""
        self.bits = max(4, int(len(self.pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, _NONE), np.zeros(size, np.int64)
        self.probes = 1
        for (a, b), (rank, new) in self.pairs.items():
            key = a << 20 | b
            at, n = self._slot(key), 1
            while self.keys[at] != -1:
                at, n = (at + 1) & (size - 1), n + 1
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, new
            self.probes = max(self.probes, n)

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - self.bits)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        key = a << 20 | b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_one(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids: list[int] = [int(self.first[b]) for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = lambda i: self.pairs.get((ids[i], ids[after[i]]), (float("inf"),))[0] if after[i] >= 0 else float("inf")
        tree = SegmentTree([rank(i) for i in range(n)])
        while True:
            low, i = tree.lowest()
            if low == float("inf"):
                break
            j = after[i]
            ids[i] = self.pairs[ids[i], ids[j]][1]
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            ids[j] = -1
            tree.update(j, float("inf"))
            tree.update(i, rank(i))
            if before[i] >= 0:
                tree.update(before[i], rank(before[i]))
        return [x for x in ids if x >= 0]

    def _encode_block(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pre-tokens of at most ``width`` bytes, ``width`` a power of two: a tree per row."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        inside = np.arange(width) < lengths[:, None]
        ids[:, :width][inside] = self.first[flat]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[np.arange(n), lengths - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), _NONE)

        def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            """rank and position of the pair that starts at each place."""
            right = ids[rows, after[rows, at]]
            out = np.full(len(rows), _NONE)
            real = np.flatnonzero(right >= 0)
            slot = self._find(ids[rows[real], at[real]], right[real])
            out[real] = np.where(slot >= 0, self.ranks[slot] * 64 + at[real], _NONE)
            return out

        r, c = np.nonzero(inside)
        tree[r, width + c] = leaf(r, c)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            k = at + width
            tree[rows, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            i = tree[rows, 1] & 63
            j = after[rows, i]
            ids[rows, i] = self.merged[self._find(ids[rows, i], ids[rows, j])]
            ids[rows, j] = -1
            then = after[rows, j]
            after[rows, i] = then
            linked = then < width
            before[rows[linked], then[linked]] = i[linked]
            update(rows, j, np.full(len(rows), _NONE))
            update(rows, i, leaf(rows, i))
            p = before[rows, i]
            has = np.flatnonzero(p < width)
            if len(has):
                update(rows[has], p[has], leaf(rows[has], p[has]))
            rows = rows[tree[rows, 1] < _NONE]
        body = ids[:, :width]
        kept = body >= 0
        ends = np.cumsum(kept.sum(1)).tolist()
        out, at = body[kept].tolist(), 0
        found = []
        for e in ends:
            found.append(out[at:e])
            at = e
        return found

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        out: list[list[int]] = [[]] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        width = 4
        while width <= WIDE:
            some = np.flatnonzero((lengths > low) & (lengths <= width))
            for s in range(0, len(some), 8192):
                part = some[s : s + 8192]
                for k, ids in zip(part.tolist(), self._encode_block([pieces[k] for k in part.tolist()], width), strict=True):
                    out[k] = ids
            low, width = width, width * 2
        for k in np.flatnonzero(lengths > WIDE).tolist():
            out[k] = self.encode_one(pieces[k])
        return out

    def _library_cut(self, text: str) -> list[str]:
        """The pre-tokens that the library's own pre-tokenizer makes."""
        return [bytes([self.to_byte[c] for c in p]).decode("utf-8") for p, _ in self.cutter.pre_tokenize_str(text)]

    def _cut(self, text: str) -> list[str]:
        return self.split.findall(text) if self.agreement.covers(text) else self._library_cut(text)

    def pretokens(self, text: str) -> list[str | int]:
        """The text's pre-tokens, with special tokens as their ids."""
        if self.around is None or not self.around.search(text):
            return self._cut(text)
        out: list[str | int] = []
        at = 0
        for m in self.around.finditer(text):
            out += self._cut(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._cut(text[at:])

    def learn(self, pretokens: set[str]) -> None:
        """Encode those that aren't kept: their ids as text, how many, and their decoded bytes."""
        self.recent = {}
        new = [p for p in pretokens if p not in self.known]
        for p, ids in zip(new, self.encode_pieces([p.encode("utf-8") for p in new]), strict=True):
            table = self.known if len(self.known) < REMEMBERED else self.recent
            table[p] = (",".join(map(str, ids)), len(ids), b"".join([self.bytes_of[i] for i in ids]))

    def _learnt(self, t: str) -> tuple[str, int, bytes]:
        return self.known.get(t) or self.recent[t]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        tokens = self.pretokens(text)
        self.learn({t for t in tokens if isinstance(t, str)})
        for t in tokens:
            out += [t] if isinstance(t, int) else map(int, self._learnt(t)[0].split(","))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def round_trip(self, tokens: list[str | int]) -> tuple[int, str, str]:
        """(tokens, SHA-256 of the ids, SHA-256 of the decoded text) of learnt pre-tokens."""
        known, recent = self.known, self.recent
        found = [(known.get(t) or recent[t]) if isinstance(t, str) else (str(t), 1, self.bytes_of[t]) for t in tokens]
        decoded = b"".join([f[2] for f in found]).decode("utf-8", "replace")
        return sum(f[1] for f in found), hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


_loaded: dict[str, ByteBPE] = {}


def vocabulary(path: str) -> ByteBPE:
    """The vocabulary at a path on every machine, or shipped by ``SparkContext.addFile``; read once a process."""
    if path not in _loaded:
        where = SparkFiles.get(path[6:]) if path.startswith("spark:") else path
        _loaded[path] = ByteBPE(where)
    return _loaded[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts are encoded whole and decoded from their ids. Defined results: a null
    or empty text has no tokens and the digests of empty strings; a null doc_id
    stays; repeated rows are encoded each; an empty table gives no rows; other
    columns are not read. Special tokens written in a text become their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows: list[tuple[int, str, str]] = []
            at = 0
            while at < len(texts):  # so that what is learnt at once stays bounded
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP_CHARS):
                    size += len(texts[to])
                    to += 1
                cut = [bpe.pretokens(x) for x in texts[at:to]]
                bpe.learn({t for x in cut for t in x if isinstance(t, str)})
                rows += [bpe.round_trip(x) for x in cut]
                at = to
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
