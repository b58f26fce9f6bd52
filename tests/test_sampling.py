"""Sets grown along one path each: all of them without thinning, at the right frequency with it, within the budget."""

import itertools
import math
import random
from collections import Counter

import pytest

from lacewing.operators import sampling, subgraphs
from lacewing.plans import discovery as D


def connected_sets(edges, k):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for s in itertools.combinations(sorted(near), k):
        seen, todo = {s[0]}, [s[0]]
        while todo:
            for v in near[todo.pop()] & set(s) - seen:
                seen.add(v)
                todo.append(v)
        if len(seen) == k:
            out.add(s)
    return out


def graph(seed, n, p):
    rng = random.Random(seed)
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p}
    return sorted(edges | {(i, i + 1) for i in range(n - 1)})


def frame(spark, graphs):
    return spark.createDataFrame([(g, a, b) for g, edges in graphs.items() for a, b in edges], "graph_id long, src long, dst long")


def test_every_set_once_without_thinning(spark):
    graphs = {g: graph(g, n, p) for g, (n, p) in enumerate([(5, 0.5), (7, 0.3), (8, 0.6), (4, 1.0), (2, 1.0)])}
    got = Counter((r.graph_id, tuple(r.nodes)) for r in sampling.extension_tree(frame(spark, graphs), 3, 6, p=1.0).collect())
    want = {(g, s) for g, edges in graphs.items() for k in range(3, 7) if k < max(b for _, b in edges) + 1 for s in connected_sets(edges, k)}
    assert set(got) == want and set(got.values()) == {1}


def test_inclusion_frequencies(spark):
    """A set of k nodes lives with probability p ** (k - 1), whatever its shape."""
    edges, rounds, p = graph(3, 7, 0.4), 600, 0.6
    got = Counter((tuple(r.nodes)) for r in sampling.extension_tree(frame(spark, {1: edges}), 3, 4, p=p, rounds=rounds).collect())
    for k in (3, 4):
        chance = p ** (k - 1)
        sets = connected_sets(edges, k)
        assert {s for s in got if len(s) == k} == sets
        spread = math.sqrt(rounds * chance * (1 - chance))
        assert all(abs(got[s] - rounds * chance) < 5 * spread for s in sets)
        assert abs(sum(got[s] for s in sets) / len(sets) - rounds * chance) < 2 * spread


def test_budget_bounds_a_level_and_a_star_ends(spark):
    star = [(0, i) for i in range(1, 3001)]
    got = sampling.extension_tree(frame(spark, {1: star, 2: graph(1, 12, 0.5)}), 3, 5, p=1.0, budget=40).collect()
    sizes = Counter((r.graph_id, len(r.nodes)) for r in got)
    assert sizes == {(g, k): 40 for g in (1, 2) for k in (3, 4, 5)}
    near = {(a, b) for a, b in graph(1, 12, 0.5)}
    assert all(any((a, b) in near for a, b in itertools.combinations(r.nodes, 2)) for r in got if r.graph_id == 2)
    assert all(r.nodes[0] == 0 for r in got if r.graph_id == 1)


def test_graphs_with_few_sets_repeat_them(spark):
    found = sampling.sampled_sets(frame(spark, {1: [(0, 1), (1, 2), (2, 3)]}), 3, 4)
    picks = subgraphs.sample_subgraphs(found, 5).collect()
    assert len(picks) == 5 and {tuple(r.nodes) for r in picks} == {(0, 1, 2), (1, 2, 3)}


@pytest.mark.parametrize("k", [(3, 16)])
def test_discovery_runs_on_large_sets(spark, k):
    edges, truth = D.generate(spark, "clique", n_graphs=8, parent=20, p=0.2, size=6)
    c = D.Config(embed_mode="wl", k_min=k[0], k_max=k[1], hash_dim=4, n_samples=15)
    sizes = {len(r.nodes) for r in D.sampled(edges.filter("role = 'pos'").select("graph_id", "src", "dst"), c).collect()}
    assert max(sizes) > 6
