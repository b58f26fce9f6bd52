"""Patterns, labelled edit distance, generators and folds against brute force on small graphs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.operators import generators, graphs, isomorphism, pooling, results, scoring, vectors
from lacewing.operators import labelled_ged as L
from lacewing.plans import discovery, generate
from lacewing.sources import collections as src


def random_edges(spark, seed, n_graphs=6, nodes=6, p=0.5):
    rng = np.random.default_rng(seed)
    rows = [(g, a, b) for g in range(n_graphs) for a in range(nodes) for b in range(a + 1, nodes) if rng.random() < p]
    return rows, spark.createDataFrame(rows, "graph_id long, src long, dst long")


@pytest.mark.parametrize("pattern", [[(0, 1)], [(0, 1), (1, 2), (2, 3), (3, 0)], [(0, 1), (1, 2), (0, 2), (2, 3)], [(0, 1), (0, 2), (0, 3), (2, 3), (1, 2)]])
def test_patterns_equal_brute_force(spark, pattern):
    rows, df = random_edges(spark, 1)
    size = 1 + max(map(max, pattern))
    want, subs = {}, {}
    for g in {r[0] for r in rows}:
        ties = {frozenset(r[1:]) for r in rows if r[0] == g}
        for m in itertools.permutations(range(6), size):
            if all(frozenset((m[a], m[b])) in ties for a, b in pattern):
                want[g] = want.get(g, 0) + 1
                subs.setdefault(g, set()).add(frozenset(frozenset((m[a], m[b])) for a, b in pattern))
    assert {r.graph_id: r.n_mappings for r in isomorphism.counts(df, pattern).collect()} == want
    got = isomorphism.occurrences(df, pattern).groupBy("graph_id").count().collect()
    assert {r.graph_id: r["count"] for r in got} == {g: len(x) for g, x in subs.items()}
    least = min(sum(r[0] == g for r in rows) for g in range(6))
    left = {r.graph_id: r.found for r in isomorphism.found(df, pattern, budget=least).collect()}
    assert all((left[g] is None) == (sum(r[0] == g for r in rows) > least) for g in left)


def test_patterns_are_connected():
    with pytest.raises(ValueError):
        isomorphism.in_joining_order([(0, 1), (2, 3)])
    with pytest.raises(ValueError):
        isomorphism.in_joining_order([])


def test_labelled_distance_equals_enumeration(spark):
    rng = np.random.default_rng(5)
    costs = L.Costs(1.5, 1.0, 2.0, 0.5, 0.75)
    made = []
    for k in range(12):
        n, m = int(rng.integers(0, 5)), int(rng.integers(0, 5))
        a, b = (np.triu(rng.random((x, x)) < 0.5, 1) for x in (n, m))
        a, b = a | a.T, b | b.T
        la, lb = (list(rng.choice(["x", "y"], x)) for x in (n, m))
        sub = L.label_mismatch(la, lb)
        best = min(L.cost_of(a, b, sub, list(way), costs) for way in itertools.product(range(-1, m), repeat=n) if len({w for w in way if w >= 0}) == sum(w >= 0 for w in way))
        got, exact, mapping = L.distance(a, b, la, lb, costs)
        assert exact and got == pytest.approx(best) and L.cost_of(a, b, sub, mapping, costs) == pytest.approx(best)
        bound, exact, _ = L.distance(a, b, la, lb, costs, budget=0)
        assert bound >= best - 1e-9
        edges = lambda x: [[i, j] for i, j in zip(*np.nonzero(np.triu(x, 1)), strict=True)]
        made.append((k, k + 100, [[int(i) for i in e] for e in edges(a)], [str(x) for x in la], [[int(i) for i in e] for e in edges(b)], [str(x) for x in lb], best))
    df = spark.createDataFrame([x[:6] for x in made], "a long, b long, edges_a array<array<int>>, labels_a array<string>, edges_b array<array<int>>, labels_b array<string>")
    assert {r.a: pytest.approx(r.ged) for r in L.pair_distances(df, costs).collect()} == {x[0]: x[6] for x in made}
    assert L.normalised([1, -1], 2, 3) == ([1, None], [None, 0, None])
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            L.Costs(edge_deletion=bad)


def connected(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, stack = set(), [min(near)]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            stack += near[v]
    return seen == set(near)


def by_graph(rows):
    out = {}
    for r in rows:
        out.setdefault(r.graph_id, []).append((r.src, r.dst))
    return out


def test_no_graph_is_lost(spark):
    got = by_graph(generators.connected_parents(spark, 100, 20, 0.1).collect())
    assert sorted(got) == list(range(100)) and all(connected(e) and len({v for x in e for v in x}) == 20 for e in got.values())
    with pytest.raises(ValueError):
        generators.connected_parents(spark, 2, 3, 0.0)


def test_families_are_connected(spark):
    rows = generators.mixed_parents(spark, 30, 15).collect()
    got = by_graph(rows)
    assert len(got) == 30 and all(connected(e) and len(set(e)) == len(e) for e in got.values()) and {r.family for r in rows} == set(generators.FAMILIES)


def test_generated_collections_are_written_and_found(spark, tmp_path):
    generate.main(["--out", str(tmp_path), "--motif-type", "clique", "--motif-size", "4", "--n-graphs", "8", "--parent-size", "8", "--parent-p", "0.3", "--rewired"])
    edges, truth = spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/truth")
    for role in ("pos", "neg", "null"):
        got = by_graph(edges.filter(F.col("role") == role).collect())
        assert sorted(got) == list(range(8)) and all(map(connected, got.values()))
    assert truth.count() == 32
    model, first = discovery.discover(edges, truth, discovery.Config(embed_mode="canonical", k_max=3))
    _, again = discovery.discover(edges, truth, discovery.Config(embed_mode="canonical", k_max=3), model)
    assert first.collect() == again.collect()


def test_swaps_that_keep_graphs_whole(spark):
    _, df = random_edges(spark, 3, nodes=8, p=0.35)
    whole = {g for g, e in by_graph(df.collect()).items() if connected(e)}
    got = by_graph(generators.swap_null(df, connected=True).collect())
    assert whole and all(connected(got[g]) for g in whole)
    degree = lambda e: sorted(v for x in e for v in x)
    assert {g: degree(e) for g, e in got.items()} == {g: degree(e) for g, e in by_graph(df.collect()).items()}


def test_numbers_run_through_all_ranges(spark):
    rows = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    got = src.numbered(spark.createDataFrame(rows, "k long, v long").repartition(7), F.col("k"), size="v").collect()
    total = 0
    for rn, r in enumerate(sorted(got, key=lambda r: r.k), 1):
        assert r.rn == rn and r.before == total
        total += r.v
    assert src.numbered(spark.createDataFrame([], "k long, v long"), F.col("k"), size="v").count() == 0


def test_fold_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"test_idx-{f}.txt").write_text("".join(f"{i}\n" for i in range(f, 12, 3)))
    got = src.read_folds(spark, str(tmp_path)).collect()
    assert sorted((r.graph_id, r.fold) for r in got) == [(i, i % 3) for i in range(12)]


def test_planes_of_a_fold_come_from_the_others(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3, ["neg", "pos", "other"][i % 7 % 3], [float(x) for x in rng.normal(i % 2, 1, 4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "fold int, role string, z array<double>")
    got = vectors.planes_by_fold(df, 4, 3)
    for f in range(3):
        assert np.allclose(got[f], vectors.lda_planes(df.filter(F.col("fold") != f).filter("role <> 'other'"), 4, 3)[0])
    assert not vectors.planes_by_fold(df.filter("fold = 0"), 4, 3)[0].any()


def test_unpool_and_filters(spark):
    cluster = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 3)], "graph_id long, node long, cluster long")
    values = spark.createDataFrame([(0, 1, 5.0), (0, 3, 7.0)], "graph_id long, cluster long, x double")
    assert sorted((r.node, r.x) for r in pooling.unpool(values, cluster).collect()) == [(1, 5.0), (2, 5.0), (3, 7.0)]
    sigma = spark.createDataFrame([(0, n, float(n)) for n in range(6)], "graph_id long, node long, sigma double")
    assert sorted(r.node for r in pooling.filter_sigma(sigma, 2, best=False).collect()) == [0, 1]
    assert pooling.filter_random(sigma, 4).count() == 4


def test_dictionary_loss_equals_definition(spark):
    rng = np.random.default_rng(4)
    atoms, x, p = rng.normal(size=(3, 4)), rng.normal(size=(5, 4)), rng.dirichlet([1, 1, 1], 5)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, p, strict=True)], "x array<double>, p array<double>")
    want = ((np.eye(3) - atoms @ atoms.T) ** 2).mean() + ((x - p @ atoms) ** 2).mean()
    assert scoring.dictionary_loss(df, atoms.tolist()).first().loss == pytest.approx(want)


def test_stop_controller_and_latex(spark):
    stop = results.StopController(2)
    assert [stop.step(x) for x in (3.0, 2.0, float("nan"), 2.5)] == [False, False, False, True]
    text = results.latex(spark.createDataFrame([("a_b", "1 ± 2")], "x string, y string"))
    assert r"a\_b & 1 $\pm$ 2 \\" in text and text.startswith(r"\begin{tabular}{ll}")


def test_labelled_line_graph_without_labels(spark):
    _, df = random_edges(spark, 6, 1, 4, 1.0)
    lines, labels = graphs.labelled_line_graph(df)
    assert lines.count() == 12 and {r.label for r in labels.collect()} == {"1"}
