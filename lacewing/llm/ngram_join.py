"""Exact n-gram Jaccard self-join with signature trees.

Documents are sets of hashed word shingles; equal sets are one set from the
start. A signature tree finds the links: its leaves hold the sets' token
bitmaps, its inner nodes the OR of their children's and their range of sizes,
and a dual traversal drops a pair of nodes when the largest overlap that bitmaps
and sizes allow is below what the threshold needs. Trees have bounded size, so
sets are routed first; routing chooses only which sets share a tree, and can't
separate a linked pair.

Routing. Two sets with Jaccard similarity of t or more, the smaller of size s,
differ in at most D = floor(s * (1 - t) / t) elements. Cut the hash range of
elements into more than D parts: one part at least holds no difference, so both
sets agree on it. Each set therefore sends a digest of each of its parts, and
sets that share a digest form a circle; parts on which the same sets agree are
one circle. A circle is searched by a tree over hashed bitmaps, which may take unlike sets for alike but not the reverse, unless
it is very large; the connected components of what is left are groups. Many
groups are packed into one tree over exact bitmaps, whose inner nodes tell them
apart and whose leaves are the links. A group that is too large for one tree is
cut into blocks; see ``_cross_blocks``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .skew import join_unique
from .store import Workspace
from .wordhash import mix, ngrams, signed, word_hashes

#: Most sets, and about the most tokens, in one tree.
BLOCK_SETS = 2048
BLOCK_TOKENS = 1_000_000
#: Sets and tokens in a tree that many groups share, on average.
PACKED_SETS, PACKED_TOKENS = 512, 250_000
FANOUT = 8
#: Lists of set keys of up to this many rows are broadcast (some 50 MB).
BROADCAST_ROWS = 1 << 20
#: Sets of one part up to which a task sends them all, and up to which they are compared by bitmap; more are tied.
GROUP, HUGE = 256, 1024
#: Members of circles that are looked at together, about.
FAMILY = 1 << 14
#: Frequent shingles: most that travel to the tasks, and documents that make one frequent.
COMMON = 1 << 18
COMMON_DOCS = 64
#: Shingles or parts that a task holds before it passes them on.
TASK_ROWS = 600_000
_U = np.uint64


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle."""
    if not len(words):
        return words
    return np.unique(ngrams(words, min(n, len(words))) + _U(min(n, len(words))))


def set_key(tokens: np.ndarray) -> int:
    """A digest of the set, whatever the order."""
    both = np.array([np.bitwise_xor.reduce(mix(tokens ^ _U(0x5851F42D4C957F2D))), np.add.reduce(mix(tokens))], np.uint64)
    return int(mix(both[:1] + mix(both[1:])).view(np.int64)[0])


class SizeBands:
    """Bands of set sizes such that linked sets lie in the same or in neighbouring ones."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.starts = [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * self.t.denominator // self.t.numerator + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def differences(self, band: int) -> int:
        """D of the largest set of the band."""
        while len(self.starts) <= band + 1:
            self.starts.append(self.starts[-1] * self.t.denominator // self.t.numerator + 1)
        return (self.starts[band + 1] - 1) * (self.t.denominator - self.t.numerator) // self.t.numerator


def part_digests(tokens: np.ndarray, bands: SizeBands, common: np.ndarray) -> np.ndarray:
    """A digest of each telling part of the set, in the class of its own band and of the next.

    A part tells something when it has an element outside ``common``, a sorted
    list of the corpus's most frequent ones. D differences spoil D parts at
    most, so where more than D parts tell something, one of them is the same in
    both sets (and tells as much in the other), and the rest can be left out.
    """
    band = bands.band(len(tokens))
    rare = np.ones(len(tokens), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
    out = []
    for c in (band, band + 1):
        most = bands.differences(c)
        parts = most + 1 + (most + 9) // 10
        if parts > 1 << 16:
            part = ((tokens >> _U(32)) % _U(parts)).astype(np.int64)
        else:  # 16 bits sort by radix
            part = ((tokens >> _U(32)) % _U(parts)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        values = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens[order] + _U(c)), out=values[1:])
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        digests = mix((values[cut[1:]] - values[cut[:-1]]) ^ mix(np.arange(parts, dtype=np.uint64) + _U((c + 1) << 32)))
        tells = np.bincount(part[rare], minlength=parts) > 0
        out.append(digests[tells] if tells.sum() > most else digests)
    return np.concatenate(out)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of each text."""
    for at, words, offsets in word_hashes(column, lower=True):
        for i in range(len(offsets) - 1):
            yield at + i, shingle_set(words[offsets[i] : offsets[i + 1]], n)


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit a hash, in the smallest power of two that has a bit for each element; 64 at least."""
    bits = np.zeros(1 << max(6, int(len(tokens) - 1).bit_length()), np.uint8)
    bits[(tokens & _U(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap of bytes as words of ``width`` bytes in all; parts of a wider one are united."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width // 8), axis=0)


def circle_roots(sizes: list[int], maps: list[bytes], threshold: Fraction) -> list[int]:
    """For each set of a circle the place of the first that it may be linked with, directly or through others.

    Each bit of one set that another lacks is an element that they don't share,
    so sizes and bitmaps bound the overlap from above.
    """
    width = min(map(len, maps))
    bits = np.stack([_folded(m, width) for m in maps])
    size = np.array(sizes, np.int64)
    spare = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
    found = traverse(SignatureTree(bits, size, spare, bits[:, 0]), np.arange(len(size)), threshold)
    _, first, back = np.unique(found, return_index=True, return_inverse=True)
    return first[back].tolist()


def _pairs_possible(sizes_a: list[int], maps_a: list[bytes], sizes_b: list[int], maps_b: list[bytes], threshold: Fraction) -> list[bool]:
    """The same test for pairs of sets."""
    num, both, out = threshold.numerator, threshold.numerator + threshold.denominator, []
    for n, x, m, y in zip(sizes_a, maps_a, sizes_b, maps_b, strict=True):
        width = min(len(x), len(y))
        x, y = (int.from_bytes(z if len(z) == width else _folded(z, width).tobytes(), "little") for z in (x, y))
        common = (x & y).bit_count() + min(n - x.bit_count(), m - y.bit_count())
        out.append(common * both >= num * (n + m))
    return out


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tkey, n_shingles, the set's digest (null where it is empty) and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.zeros(b.num_rows, np.int64)
            key = np.zeros(b.num_rows, np.int64)
            maps: list[bytes | None] = [None] * b.num_rows
            for i, tokens in _sets(b.column(1), n):
                size[i] = len(tokens)
                if len(tokens):
                    key[i], maps[i] = set_key(tokens), bitmap(tokens)
            columns = [b.column(0), b.column(2), pa.array(size), pa.array(key, mask=size == 0), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "n_shingles", "sid", "bitmap"])

    return docs.mapInArrow(run, "doc_id long, tkey long, n_shingles long, sid long, bitmap binary")


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.array([0])


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """The COMMON most frequent shingles, of those in COMMON_DOCS documents or more; sorted.

    Counted over all documents, but a task reports only what it saw twice. The
    list decides which parts are worth sending, never which links exist.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            tokens, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(tokens[c > 1])), pa.array(c[c > 1])], names=["token", "c"])

        for b in batches:
            for _, tokens in _sets(b.column(0), n):
                if len(tokens) and (sid := set_key(tokens)) not in seen:
                    seen.add(sid)
                    held.append(tokens)
                    size += len(tokens)
                    if size > TASK_ROWS:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    found = counts.filter(F.col("c") >= COMMON_DOCS).orderBy(F.desc("c"), "token").limit(COMMON).select("token").toArrow()
    return np.sort(found.column("token").to_numpy().astype(np.int64).view(np.uint64))


def _ties(k: np.ndarray, s: np.ndarray, grouped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, circles, ties) of sets that stand next to each other with one key, in order.

    Two sets are a pair to be looked at. More are a circle, given as (circle,
    set, first set); a circle is named by a digest of its sets, so parts that
    the same sets agree on make one circle. In one of more than HUGE, or one in
    which a set stands for a group, all are tied to the first.
    """
    cut = _runs(k)
    size = np.diff(cut)
    any_group = np.add.reduceat(grouped.astype(np.int64), cut[:-1]) > 0 if len(size) else np.zeros(0, bool)
    blind = (size > HUGE) | any_group
    lead = np.repeat(s[cut[:-1]], size)
    tied = np.repeat(blind, size) & (lead != s)
    at = cut[:-1][(size == 2) & ~blind]
    in_circle = np.repeat((size > 2) & ~blind, size)
    names = mix(np.add.reduceat(mix(s.view(np.uint64) ^ _U(0xD6E8FEB86659FD93)), cut[:-1]) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
    circle = np.repeat(signed(names), size)
    return np.sort(np.stack([s[at], s[at + 1]], 1), axis=1), np.stack([circle[in_circle], s[in_circle], lead[in_circle]], 1), np.stack([s[tied], lead[tied]], 1)


#: What a row of candidate_edges is.
PAIR, MEMBER, TIE = 0, 1, 2


def _edge_batch(pairs: np.ndarray, circles: np.ndarray, ties: np.ndarray) -> pa.RecordBatch:
    pairs, circles, ties = (np.unique(x, axis=0) if len(x) else x for x in (pairs, circles, ties))
    e = np.concatenate([pairs, circles[:, :2], ties])
    kind = np.repeat(np.array([PAIR, MEMBER, TIE], np.int32), [len(pairs), len(circles), len(ties)])
    lead = np.concatenate([pairs[:, 0], circles[:, 2], ties[:, 0]])
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(lead), pa.array(kind)], names=["a", "b", "lead", "kind"])


def candidate_edges(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(a, b, lead, kind): pairs of set digests that agree on a part, members b of a circle a with its first member, and ties.

    Where very many sets of a task agree on a part they are tied at once, and
    one goes on for all, so that such a part brings few rows a task to the
    shuffle. A row (key, sid, other) is a part with its set; with ``other``
    equal to ``sid`` the set stands for a group; with another set there it is a
    finished tie that travels along.
    """

    common = common_shingles(docs, n)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = SizeBands(threshold), set()
        keys: list[np.ndarray] = []
        sids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k, s = np.concatenate(keys), np.concatenate(sids)
            keys.clear()
            sids.clear()
            order = np.argsort(k, kind="stable")
            k, s = k[order], s[order]
            cut = _runs(k)
            many = np.diff(cut) > GROUP
            lead = np.repeat(s[cut[:-1]], np.diff(cut))
            grouped = np.repeat(many, np.diff(cut))
            first = np.zeros(len(s), bool)
            first[cut[:-1]] = True
            goes = ~grouped | first
            e = np.stack([s[~goes], lead[~goes]], 1)
            e = np.unique(e, axis=0) if len(e) else e
            other = np.concatenate([s[goes], e[:, 1]])
            mask = np.concatenate([~grouped[goes], np.zeros(len(e), bool)])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[goes], e[:, 0]])), pa.array(np.concatenate([s[goes], e[:, 0]])), pa.array(other, mask=mask)], names=["key", "sid", "other"])

        for b in batches:
            for _, tokens in _sets(b.column(0), n):
                if len(tokens) and (sid := set_key(tokens)) not in seen:
                    seen.add(sid)
                    d = signed(part_digests(tokens, bands, common))
                    keys.append(d)
                    sids.append(np.full(len(d), sid, np.int64))
                    size += len(d)
                    if size > TASK_ROWS:
                        yield flush()
                        size = 0
        if keys:
            yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # the open circle: key, set, stands for a group
        for b in batches:
            k, s, o = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).fill_null(0).to_numpy()
            has = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            done = has & (o != s)
            travelled = np.stack([s[done], o[done]], 1)
            k, s, g = (np.concatenate([x, y[~done]]) for x, y in zip(held, (k, s, has), strict=True))
            # a set can come twice with a part
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | g[1:] | g[:-1]
            k, s, g = k[new], s[new], g[new]
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0
            pairs, circles, ties = _ties(k[:last], s[:last], g[:last])
            held = (k[last:], s[last:], g[last:])
            if len(held[0]) > HUGE:
                ties = np.concatenate([ties, _ties(*held)[2]])
                held = (held[0][:1], held[1][:1], np.ones(1, bool))
            yield _edge_batch(pairs, circles, np.concatenate([ties, travelled]))
        yield _edge_batch(*_ties(*held))

    rows = docs.select("text").mapInArrow(emit, "key long, sid long, other long")
    return rows.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(join, "a long, b long, lead long, kind int")


def circle_members(edges: DataFrame, ws: Workspace) -> DataFrame:
    """lead, block, sid, circles: for each set the circles with one first member that it is in.

    Circles of near-copies differ little and mostly share their first member,
    so a set's bitmap is needed once for many of them. Where one first member
    has very many, they are dealt to blocks.
    """
    circles = ws.keep(edges.filter(F.col("kind") == MEMBER).select("lead", F.col("a").alias("circle"), F.col("b").alias("sid")).distinct(), "circles")
    blocks = circles.groupBy("lead").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("blocks"))
    dealt = join_unique(circles, blocks, ["lead"]).withColumn("block", F.pmod(F.col("circle"), F.col("blocks")).cast("int"))
    return dealt.groupBy("lead", "block", "sid").agg(F.collect_set("circle").alias("circles"))


def family_ties(sids: list[int], sizes: list[int], maps: list[bytes], circles: list[list[int]], threshold: Fraction) -> list[tuple[int, int]]:
    """(set, another) for the sets that circles may link, directly or through others.

    Large circles come first; one whose sets are connected already has nothing to add.
    """
    members: dict[int, list[int]] = {}
    for i, own in enumerate(circles):
        for c in own:
            members.setdefault(c, []).append(i)
    root = np.arange(len(sids))
    for _, at in sorted(members.items(), key=lambda m: (-len(m[1]), m[0])):
        at = np.array(at)
        if (root[at] == root[at[0]]).all():
            continue
        for i, r in zip(at, at[circle_roots([sizes[i] for i in at], [maps[i] for i in at], threshold)], strict=True):
            if root[i] != root[r]:
                root[root == max(root[i], root[r])] = min(root[i], root[r])
    return [(sids[i], sids[r]) for i, r in enumerate(root) if i != r]


def possible_edges(edges: DataFrame, sets: DataFrame, threshold: Fraction, ws: Workspace) -> DataFrame:
    """(a, b): the ties, and of pairs and circles what sizes and bitmaps allow to be linked."""
    pairs = edges.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    circles = ws.keep(circle_members(edges, ws), "members-of-circles")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("sid")).union(circles.select("sid")).distinct()
    maps = sets.join(nodes, "sid").groupBy("sid").agg(F.max("n_shingles").alias("n"), F.max("bitmap").alias("m"))

    def test_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(_pairs_possible(*(b.column(c).to_pylist() for c in range(2, 6)), threshold), pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    def test_circles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            out = []
            for lead, block, *row in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if (lead, block) != key:
                    if len(rows) > 1:
                        out += family_ties(*zip(*rows, strict=True), threshold)
                    key, rows = (lead, block), []
                rows.append(row)
            yield _pair_batch(out)
        if len(rows) > 1:
            yield _pair_batch(family_ties(*zip(*rows, strict=True), threshold))

    both = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
    members = circles.join(maps, "sid").select("lead", "block", "sid", "n", "m", "circles").repartition("lead", "block").sortWithinPartitions("lead", "block")
    found = both.mapInArrow(test_pairs, "a long, b long").union(members.mapInArrow(test_circles, "a long, b long"))
    return found.union(edges.filter(F.col("kind") == TIE).select("a", "b"))


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*set(pairs), strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class SignatureTree:
    """Sets with a bitmap each at the leaves; OR-combined bitmaps, and ranges of sizes, upwards.

    ``spare`` is how many elements of a set may share a bit with another of its
    elements: none where bitmaps are exact. Neighbours in the tree should be
    alike: the order is by size class, then by ``near``.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, spare: np.ndarray, near: np.ndarray):
        self.order = np.lexsort((near, np.floor(np.log(np.maximum(sizes, 1)) * 9.5)))
        size = sizes[self.order]
        self.levels = [(bits[self.order], size, size, spare[self.order])]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, spare = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)))

    def below(self, level: int, node: int) -> np.ndarray:
        """The children of a node."""
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][1])))


def exact_tree(tokens: np.ndarray, offsets: np.ndarray) -> SignatureTree:
    """The tree of some sets with a bit for each token that two of them have."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    values, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    # a token of one set only is in no overlap: it counts in the sizes and needs no bit
    shared = counts >= 2
    bit = np.cumsum(shared) - 1
    width = max(1, (int(shared.sum()) + 63) // 64)
    keep = shared[inverse]
    row, place = np.repeat(np.arange(n), sizes)[keep], bit[inverse[keep]]
    bits = np.zeros(n * width, np.uint64)
    np.bitwise_or.at(bits, row * width + (place >> 6), _U(1) << (place & 63).astype(np.uint64))
    least = np.array([tokens[a] if z > a else 0 for a, z in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
    return SignatureTree(bits.reshape(n, width), sizes, np.zeros(n, np.int64), least)


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits of each row of a with each row of b."""
    step = max(1, 4_000_000 // max(1, len(b) * a.shape[1]))
    return np.concatenate([np.bitwise_count(a[i : i + step, None, :] & b[None, :, :]).sum(2, dtype=np.int64) for i in range(0, len(a), step)])


def traverse(tree: SignatureTree, labels: np.ndarray, threshold: Fraction, seen: Counter | None = None) -> np.ndarray:
    """For each set, a number shared by exactly the sets that possible links or equal ``labels`` connect with it.

    Where bitmaps are exact a possible link is a link. Node pairs whose sets are
    all connected already are left out as well: they hold no link that changes
    the answer. ``seen`` counts node pairs looked at and ruled out, by level.
    """
    n = len(tree.order)
    _, root = np.unique(labels[tree.order], return_inverse=True)
    root = root.astype(np.int64)
    num, den = threshold.numerator, threshold.denominator

    def possible(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Matrix: can any two sets under nodes a and b be linked?"""
        bits, low, high, spare = tree.levels[level]
        common = _overlaps(bits[a], bits[b]) + np.minimum(spare[a][:, None], spare[b][None, :])
        common = np.minimum(common, np.minimum(high[a][:, None], high[b][None, :]))
        fits = common * (num + den) >= num * (low[a][:, None] + low[b][None, :])
        return fits & (den * high[a][:, None] >= num * low[b][None, :]) & (den * high[b][None, :] >= num * low[a][:, None])

    stack = [(len(tree.levels) - 1, 0, 0)] if n > 1 else []
    while stack:
        level, a, b = stack.pop()
        span = FANOUT**level
        ra, rb = root[a * span : (a + 1) * span], root[b * span : (b + 1) * span]
        if ra[0] == rb[0] and (ra == ra[0]).all() and (rb == rb[0]).all():
            continue
        ca, cb = tree.below(level, a), tree.below(level, b)
        fits = possible(level - 1, ca, cb)
        if seen is not None:
            seen[level - 1, "looked at"] += fits.size
            seen[level - 1, "ruled out"] += int((~fits).sum())
        for i, j in zip(*np.nonzero(fits), strict=True):
            if level > 1:
                if a != b or i <= j:
                    stack.append((level - 1, int(ca[i]), int(cb[j])))
            elif root[ca[i]] != root[cb[j]]:
                x, y = root[ca[i]], root[cb[j]]
                root[root == max(x, y)] = min(x, y)
    out = np.empty(n, np.int64)
    out[tree.order] = root
    return out


def tree_links(tokens: np.ndarray, offsets: np.ndarray, labels: np.ndarray, threshold: Fraction, seen: Counter | None = None) -> np.ndarray:
    """For each set of tokens, a number shared by exactly the sets that links or equal ``labels`` connect with it."""
    return traverse(exact_tree(tokens, offsets), labels, threshold, seen)


MEMBERS = "comp long, block int, sid long, label long, tokens binary"


def _member_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, comp, block, blocks, n, tokens) of the wanted sets; one document's text stands for each."""
    few = wanted.count() <= BROADCAST_ROWS
    w = wanted.select("tkey", "sid", "comp", "block", "blocks")
    rows = docs.join(F.broadcast(w) if few else w, "tkey").select("sid", "comp", "block", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            want = b.column(0).to_pylist()
            at: list[int] = []
            sizes: list[int] = []
            sets: list[bytes] = []
            for i, tokens in _sets(b.column(4), n):
                # several rows can have that text: it counts once
                if len(tokens) and want[i] not in seen and set_key(tokens) == want[i]:
                    seen.add(want[i])
                    at.append(i)
                    sizes.append(len(tokens))
                    sets.append(tokens.tobytes())
            own = [c.take(pa.array(at, pa.int64())) for c in b.columns[:4]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "comp", "block", "blocks", "n", "tokens"])

    return rows.mapInArrow(run, "sid long, comp long, block int, blocks int, n long, tokens binary")


def _block_links(members: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): links found inside each (comp, block), each set tied to one of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sids, labels, sets = None, [], [], []

        def finish() -> pa.RecordBatch:
            at = {s: i for i, s in reversed(list(enumerate(sids)))}  # a set that came twice counts once
            use = sorted(at.values())
            s = np.array([sids[i] for i in use], np.int64)
            tokens = [np.frombuffer(sets[i], np.uint64) for i in use]
            found = tree_links(np.concatenate(tokens), np.cumsum([0, *map(len, tokens)]), np.array([labels[i] for i in use], np.int64), threshold)
            order = np.lexsort((s, found))
            cut = _runs(found[order])
            lead = np.repeat(s[order][cut[:-1]], np.diff(cut))
            own = s[order]
            tied = own != lead
            return pa.RecordBatch.from_arrays([pa.array(own[tied]), pa.array(lead[tied])], names=["a", "b"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if row[:2] != key:
                    if len(sids) > 1:
                        yield finish()
                    key, sids, labels, sets = row[:2], [], [], []
                sids.append(row[2])
                labels.append(row[3])
                sets.append(row[4])
        if len(sids) > 1:
            yield finish()

    chosen = members.select("comp", "block", "sid", "label", "tokens")
    return chosen.repartition("comp", "block").sortWithinPartitions("comp", "block").mapInArrow(run, "a long, b long")


def _packed(members: DataFrame) -> DataFrame:
    """Groups that a tree can hold share one with others: ``comp`` becomes the tree's number and ``block`` -1."""
    small = F.col("blocks") <= 1
    sets, tokens = members.filter(small).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    trees = max(sets // PACKED_SETS, tokens // PACKED_TOKENS) + 1
    return members.withColumn("comp", F.when(small, F.pmod(F.xxhash64("comp"), F.lit(trees))).otherwise(F.col("comp"))).withColumn("block", F.when(small, F.lit(-1)).otherwise(F.col("block")))


def _blocked(members: DataFrame, by: str) -> DataFrame:
    """Adds ``block``: 0 for groups that one tree can hold, else a share by the set's hash."""
    sizes = members.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    return members.join(sizes, "comp").withColumn(by, F.pmod(F.xxhash64("sid", F.lit(by)), F.greatest(F.lit(1), F.col("blocks"))).cast("int"))


def _cross_blocks(members: DataFrame, links: DataFrame, threshold: Fraction, ws: Workspace) -> DataFrame:
    """Links between blocks of the groups that were cut; ``links`` are those inside blocks.

    First the smallest set of each component so far meets the others of its
    group, which ties blocks of copies together. What then differs is settled
    exactly: the sets outside a group's largest component meet every block of
    the group, and the traversal skips what is connected already.
    """
    large = members.filter("blocks > 1")
    groups = large.select("comp").distinct().count()
    if not groups:
        return links
    for step in range(2):
        roots = connected_components(links, ws, f"cross{step}")
        labelled = large.drop("label").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root")
        labelled = ws.keep(labelled, f"labelled{step}")
        if step == 0:
            heads = _blocked(labelled.filter("sid = label").drop("block", "blocks"), "block")
            links = ws.keep(_stars(roots).union(_block_links(heads, threshold)), "links-heads")
    counts = labelled.groupBy("comp", "label").agg(F.count("*").alias("c"))
    most = counts.groupBy("comp").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    outside = labelled.join(most, "comp").filter("label <> top").drop("block", "blocks", "top", "labels")
    outside = ws.keep(_blocked(outside, "chunk").withColumnRenamed("blocks", "chunks"), "outside")
    chunks = outside.groupBy("comp").agg(F.max("chunks").alias("chunks"))
    # every block of such a group meets every chunk of its outside sets
    blocks = labelled.join(chunks, "comp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    per_group = labelled.join(chunks, "comp").groupBy("comp").agg(F.max("blocks").alias("blocks"))
    loose = outside.join(per_group, "comp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["comp", (F.col("chunk") * F.lit(1 << 15) + F.col("block")).cast("int").alias("block"), "sid", "label", "tokens"]
    return _stars(roots).union(_block_links(blocks.select(*columns).union(loose.select(*columns)), threshold))


def _stars(roots: DataFrame) -> DataFrame:
    """(a, b): the fewest edges that make these components."""
    return roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def components(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), workspace: Workspace | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased in A-Z; a document's set is its distinct n-word
    shingles, or its whole sequence where it is shorter. Two documents link when
    their Jaccard similarity is at least ``threshold``; component_id is the
    smallest doc_id that links reach. No link is lost and none is guessed, up to
    64-bit hash collisions. Defined results: a null or wordless text has an
    empty set and links with nothing (component_id is its own doc_id); a null
    doc_id is linked like others but never names a component unless all are
    null; repeated rows are in the same component; a very long text is one set;
    an empty table gives no rows; other columns, whatever their names, aren't read.
    """
    ws = workspace or Workspace(docs.sparkSession, "ngram-join")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))
    sets = ws.keep(document_sets(docs, n), "sets")
    edges = ws.keep(candidate_edges(docs, n, threshold), "edges")
    possible = possible_edges(edges, sets.filter("sid is not null"), threshold, ws)
    groups = ws.keep(connected_components(possible, ws, "candidates"), "groups")
    distinct = sets.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("tkey").alias("tkey"), F.max("n_shingles").alias("n"))
    wanted = groups.select(F.col("node").alias("sid"), F.col("root").alias("comp")).join(distinct, "sid")
    # blocks are laid out before the sets have their tokens, so that those needn't travel for it
    wanted = ws.keep(_blocked(ws.keep(wanted, "grouped"), "block"), "wanted")
    members = _member_sets(docs, wanted, n).withColumn("label", F.col("sid"))
    members = ws.keep(members, "members")
    links = ws.keep(_block_links(_packed(members), threshold), "links")
    links = ws.keep(_cross_blocks(members, links, threshold, ws), "all-links")
    roots = connected_components(links, ws, "components")
    named = distinct.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = ws.keep(named, "named")
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = ws.keep(join_unique(named, ids, ["root"]).select("sid", "component_id"), "by-set")
    rows = join_unique(sets.drop("bitmap"), by_set, ["sid"], "left")
    ws.drop_all_but("sets", "by-set")
    return rows.select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def distinct_rows(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The input rows, with all their columns, one of each component of near-duplicates; decided by row, not by doc_id alone.

    The row that comes first by (doc_id, nulls last, then the text's digest)
    stays, once if it is repeated. Texts without words link with nothing and stay.
    """
    ws = Workspace(docs.sparkSession, "distinct-rows")
    names = docs.columns
    text = docs["text"].cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keys = [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("k")]
    # ids and digests decide; the rows with their texts stay where they are
    light = ws.keep(docs.select(*keys, worded.alias("worded")).groupBy("doc_id", "k", "worded").agg(F.count("*").alias("c")), "rows")
    # texts stand for their rows: copies are counted once before anything is joined
    found = components(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), n, threshold).filter("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("k")).agg(F.min("component_id").alias("comp"))
    first = light.filter("worded").groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("f"))
    stay = first.join(found, "k").groupBy("comp").agg(F.min(F.struct("f.none", "f.doc_id", "k")).alias("s")).select(F.col("s.doc_id").alias("_d"), F.col("s.k").alias("_k"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["_d"]) & (x["k"] == y["_k"])
    names_of = lambda x: x.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"))
    gone = ws.keep(names_of(light.filter("worded").join(stay, same(light, stay), "left_anti")), "gone")
    repeated = ws.keep(names_of(light.filter("c > 1")), "repeated")
    sent = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *keys)
    kept = keyed.join(sent(gone), same(keyed, gone), "left_anti")
    if not repeated.limit(1).count():
        return kept.select("row.*")
    repeated_once = sent(repeated)
    once = kept.join(repeated_once, same(kept, repeated), "left_anti")
    more = kept.join(repeated_once, same(kept, repeated), "left_semi").dropDuplicates(["doc_id", "k"])
    return once.unionByName(more).select("row.*")
