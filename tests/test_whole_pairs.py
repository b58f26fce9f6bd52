"""Distances of all pairs, against one pair at a time."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from lacewing.operators import ged
from lacewing.plans import registry
from lacewing.sources import collections as src

SF = "/root/testdata/sf0.001"


def graphs_of(spark):
    rows = ged.packed(src.event_week(spark, SF)).collect()
    return {r.graph_id: ged.matrix(r.n, [(e.i, e.j) for e in r.pairs]) for r in rows}


def test_exact_equals_a_star_and_many_equal_one():
    rng = np.random.default_rng(3)
    graphs = [ged.matrix(n, [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.5]) for n in (1, 2, 3, 4, 4, 5, 5)]
    for a, b in itertools.product(graphs, graphs):
        assert ged.exact(a, b) == ged.a_star(a, b)
        assert ged.bipartite_many(np.array([a, a]), np.array([b, b])).tolist() == [ged.bipartite(a, b)] * 2


def test_a_spent_budget_gives_an_upper_bound():
    rng = np.random.default_rng(5)
    a, b = (ged.matrix(9, [p for p in itertools.combinations(range(9), 2) if rng.random() < 0.5]) for _ in range(2))
    want = ged.exact(a, b)
    assert ged.exact_within(a, b, 1 << 40) == (want, True)
    bounds = [ged.exact_within(a, b, n) for n in (0, 20, 200)]
    assert not bounds[0][1] and all(d >= want for d, _ in bounds)


def expanded(df, value, either=False):
    """Every pair of graphs from pairs of shapes and their members."""
    rows = df.collect()
    shape = {r.a: r.b for r in rows if r.kind == "member"}
    known = {(r.a, r.b): r[value] for r in rows if r.kind == "pair"}
    assert len(known) + len(shape) == len(rows)
    key = lambda a, b: tuple(sorted((shape[a], shape[b]))) if either else (shape[a], shape[b])
    return {(a, b): known[key(a, b)] for a, b in itertools.combinations(sorted(shape), 2)}


def test_edit_distances_cover_all_graphs(spark):
    graphs = graphs_of(spark)
    pairs = list(itertools.combinations(sorted(graphs), 2))
    want = {(a, b): ged.bipartite(graphs[a], graphs[b]) for a, b in pairs}
    assert expanded(registry.QUERIES["ged_bipartite_g2"](spark, SF), "ged") == want
    sim = expanded(registry.QUERIES["ged_similarity_matrix_g2"](spark, SF), "sim")
    assert sim.keys() == want.keys() and all(np.isclose(sim[p], np.exp(-0.5 * want[p])) for p in want)
    exact = {(a, b): ged.exact(graphs[a], graphs[b]) for a, b in pairs}
    assert expanded(registry.QUERIES["ged_astar_g2"](spark, SF), "ged", either=True) == exact
    packed = ged.packed(src.event_week(spark, SF))
    for algorithm, right in (("bipartite", want), ("astar", exact)):
        found = ged.pair_distances(packed, algorithm).collect()
        assert len(found) == len(right) and {(r.a, r.b): r.ged for r in found} == right
    matrix = ged.similarity_matrix(ged.pair_distances(packed, "bipartite").select("a", "b", ged.similarity(F.col("ged")).alias("sim")), packed.select("graph_id"))
    assert matrix.count() == len(graphs) ** 2 == matrix.select("i", "j").distinct().count()
    assert matrix.filter(F.col("i") == F.col("j")).agg(F.min("sim")).first()[0] == 1.0


def test_copies_add_members_and_no_pairs(spark):
    """Pairs listed don't grow with the square of the copies, and isomorphic graphs are searched in one direction."""
    e = src.event_week(spark, SF)
    copies = e.withColumn("graph_id", F.explode(F.array(*[F.col("graph_id") + 10**7 * i for i in range(3)])))
    for algorithm in ("bipartite", "astar"):
        costs, members = ged.shape_distances(ged.packed(copies), algorithm)
        shapes = members.select("shape").distinct().count()
        assert members.count() == 3 * e.select("graph_id").distinct().count()
        assert costs.count() == (shapes * shapes if algorithm == "bipartite" else shapes * (shapes + 1) // 2)


def test_exact_search_with_twins_and_larger_graphs(spark):
    rng = np.random.default_rng(11)
    star = ged.matrix(6, [(0, i) for i in range(1, 6)])
    graphs = [star, ged.matrix(5, [(0, 3), (0, 4), (1, 3), (1, 4), (2, 3), (2, 4)]), *[ged.matrix(n, [p for p in itertools.combinations(range(n), 2) if rng.random() < q]) for n, q in ((5, 0.3), (6, 0.3), (6, 0.6))]]
    for a, b in itertools.product(graphs, graphs):
        want = min(ged.edit_cost(a, b, list(m)) for m in itertools.permutations(range(len(b)), len(a))) if len(a) <= len(b) else None
        assert want is None or ged.exact_within(a, b, 1 << 40) == (want, True)


def test_similar_shapes_and_their_members_are_all_similar_pairs(spark):
    lists = ged.degree_lists(src.event_week(spark, SF)).cache()
    n = lists.count()
    rng = np.random.default_rng(1)
    more = [(10**9 + i, sorted(rng.integers(1, 9, rng.integers(2, 12)).tolist())) for i in range(80)]
    lists = lists.union(spark.createDataFrame(more, "graph_id long, degs array<int>")).cache()
    every = {(r.a, r.b): r.ged for r in ged.hausdorff_distances(lists).collect()}
    assert len(every) == (n + 80) * (n + 79) // 2
    shape = {r.graph_id: r.shape for r in ged.hausdorff_shapes(lists).collect()}
    for least in (0.9, 0.5, 0.3, 0.1):
        found = {(r.a, r.b): r.ged for r in ged.hausdorff_similar(lists, least).collect()}
        got = {}
        for a, b in every:
            x, y = sorted((shape[a], shape[b]))
            if x == y:
                got[a, b] = 0.0
            elif (x, y) in found:
                got[a, b] = found[x, y]
        most = -2 * np.log(least)
        assert got == {p: g for p, g in every.items() if np.exp(-0.5 * g) >= least}
        shapes = len(set(shape.values()))
        candidates = ged.hausdorff_candidates(lists, most).count()
        assert len(found) <= candidates < shapes * (shapes - 1) / 2
        if least >= 0.5:
            assert candidates < 0.5 * shapes * (shapes - 1) / 2


def test_hausdorff_query_has_every_pair(spark):
    n = ged.degree_lists(src.event_week(spark, SF)).count()
    got = registry.QUERIES["hausdorff_ged_g2"](spark, SF)
    assert got.count() == n * (n - 1) // 2 == got.select("a", "b").distinct().count()
