"""The n-gram join against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from lacewing.llm import ngram_join as J
from lacewing.llm.components import connected_components
from lacewing.llm.store import Workspace

from .fixtures import documents, frame, multiset

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)) if w else frozenset()


def brute(rows, n, t):
    sets = [shingles(x, n) for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * t.denominator >= t.numerator * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(known) if known and sets[i] else d))
    return out


def near_copies(seed, groups, n, length):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{g}x{k}" for k in range(length)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(0, length // 16)):
                w[rng.randrange(length)] = f"z{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_equal_brute_force(spark, n, t):
    rows = documents(2, 80)
    got = J.components(frame(spark, rows), n, t).collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows, n, t))


def test_groups_cut_into_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 8)
    for rows in (near_copies(5, 3, 40, 90), near_copies(6, 1, 60, 40)):
        got = J.components(frame(spark, rows), 3, Fraction(9, 10)).collect()
        want = brute(rows, 3, Fraction(9, 10))
        assert 1 < len({r[2] for r in want}) < len(rows)
        assert multiset(map(tuple, got)) == multiset(want)


def test_large_lists_are_shuffled_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    rows = documents(3, 40)
    got = J.components(frame(spark, rows), 3, Fraction(9, 10)).collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows, 3, Fraction(9, 10)))


def test_empty_table(spark):
    assert J.components(frame(spark, []), 3, Fraction(9, 10)).count() == 0


def test_signature_tree_links(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, (6, 200), dtype=np.uint64)
    sets = []
    for k in range(150):
        s = base[k % 6].copy()
        s[rng.integers(0, 200, k % 11)] = rng.integers(0, 1 << 62, k % 11, dtype=np.uint64)
        sets.append(np.unique(s))
    got = J.tree_links(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), np.arange(150), Fraction(9, 10))
    want = brute([(i, " ".join(map(str, s.tolist()))) for i, s in enumerate(sets)], 1, Fraction(9, 10))
    pairs = {(i, j) for i in range(150) for j in range(i)}
    assert {p for p in pairs if got[p[0]] == got[p[1]]} == {p for p in pairs if want[p[0]][2] == want[p[1]][2]}


def test_frequent_parts_are_left_out_safely():
    bands = J.SizeBands(Fraction(4, 5))
    rng = np.random.default_rng(1)
    tokens = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    common = np.sort(tokens[:60])
    other = np.unique(np.concatenate([tokens[: len(tokens) - 40], rng.integers(0, 1 << 62, 40, dtype=np.uint64)]))
    a, b = (set(J.part_digests(x, bands, common).tolist()) for x in (tokens, other))
    assert a & b and len(a) < len(J.part_digests(tokens, bands, tokens))


def test_components_of_a_long_path(spark):
    rng = random.Random(3)
    name = list(range(200))
    rng.shuffle(name)
    edges = spark.createDataFrame([(name[i], name[i + 1]) for i in range(149)] + [(name[150], name[151]), (name[151], name[150])], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, Workspace(spark, "t"), "x").collect()}
    assert got == {x: min(name[:150]) for x in name[:150]} | {x: min(name[150:152]) for x in name[150:152]}


@pytest.mark.parametrize(("group", "huge"), [(2, 3), (256, 4), (3, 1024)])
def test_parts_that_many_sets_share_lose_no_link(spark, monkeypatch, group, huge):
    monkeypatch.setattr(J, "GROUP", group)
    monkeypatch.setattr(J, "HUGE", huge)
    rows = near_copies(7, 4, 25, 60)
    for n, t in ((3, Fraction(9, 10)), (5, Fraction(4, 5))):
        got = J.components(frame(spark, rows), n, t).collect()
        assert multiset(map(tuple, got)) == multiset(brute(rows, n, t))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(12)
    t = Fraction(4, 5)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.5, 1)], rng.integers(0, 1 << 62, int(rng.integers(0, n // 2 + 2)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and both * 5 >= 4 * (len(a) + len(b) - both):
            assert J.circle_roots([len(a), len(b)], [J.bitmap(a), J.bitmap(b)], t) == [0, 0]


@pytest.mark.parametrize("words", [2_000, 20_000])
def test_long_near_copies_stay_linear(spark, words, monkeypatch):
    """Parts on which the same long sets agree are one circle, and a set's bitmap is read once for all of them."""
    monkeypatch.setattr(J, "FAMILY", 64)
    rows = near_copies(9, 1, 4, words) + near_copies(10, 1, 3, words // 2)[:3]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    ws, df = Workspace(spark, "t"), frame(spark, rows)
    edges = ws.keep(J.candidate_edges(df, 3, Fraction(9, 10)), "edges")
    members = J.circle_members(edges, ws).collect()
    assert 0 < len(members) < 40 and sum(len(r.circles) for r in members) < 100
    got = J.components(df, 3, Fraction(9, 10)).collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows, 3, Fraction(9, 10)))


def test_families_are_dealt_to_blocks_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(J, "FAMILY", 3)
    rows = near_copies(7, 3, 25, 60)
    got = J.components(frame(spark, rows), 3, Fraction(9, 10)).collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows, 3, Fraction(9, 10)))
