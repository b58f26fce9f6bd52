"""Out-of-fold codes against plain numpy, cliques in peeling order against combinations, folds by ranges."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.operators import classification, graphs, vectors
from lacewing.sources import collections as src


def test_codes_and_vocabularies_see_training_folds_only(spark):
    rng = np.random.default_rng(4)
    graph = np.repeat(np.arange(12), 6)
    fold, label = graph % 3, (graph // 3) % 2
    z = np.round(rng.normal(size=(72, 4)) + label[:, None] * [1.0, 0, 0.5, 0], 3)
    rows = spark.createDataFrame([(int(g), x.tolist()) for g, x in zip(graph, z, strict=True)], "graph_id long, vec array<double>")
    folds = spark.createDataFrame([(g, g % 3, (g // 3) % 2) for g in range(12)], "graph_id long, fold int, class int")
    codes = classification.fold_codes(rows, folds, 3, 4, 3).cache()
    got = {r.graph_id: r for r in codes.collect()}
    assert len(got) == 12
    for f in range(3):
        train = fold != f
        m = lambda pick: (int(pick.sum()), z[pick].sum(0), z[pick].T @ z[pick])  # noqa: B023, E731
        planes, _ = vectors._lda({"pos": m(train & (label == 1)), "neg": m(train & (label == 0))}, 4, 3)
        want = ["".join("1" if x > 0 else "0" for x in planes @ row) for row in z]
        for g in range(12):
            own = graph == g
            assert got[g][f"buckets_{f}"] == sorted(np.array(want)[own].tolist()) and got[g].pool == pytest.approx(z[own].mean(0).tolist())
        counter = classification.fold_vocabulary(codes, f)
        assert set(counter.vocabulary) == set(np.array(want)[train].tolist())
        hist = {r.graph_id: r.hist.toArray() for r in counter.transform(codes).collect()}
        for g in range(12):
            assert hist[g].tolist() == [float((np.array(want)[graph == g] == w).sum()) for w in counter.vocabulary]
    result = classification.validate_folds(codes, 3, trees=5, depth=3, parallel=2).collect()
    assert [r.fold for r in result] == [0, 1, 2] and all(0 <= r.accuracy <= 1 and r.vocabulary > 0 for r in result)


def random_graph(seed, n, p):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


@pytest.mark.parametrize("size", [2, 3, 4, 5, 6])
def test_cliques_of_every_size(spark, size):
    made = {1: random_graph(1, 14, 0.6), 2: random_graph(2, 20, 0.3), 3: list(itertools.combinations(range(7), 2)), 4: [(0, i) for i in range(1, 30)] + [(1, 2), (2, 3), (1, 3)]}
    edges = spark.createDataFrame([(g, f"n{a:02d}", f"n{b:02d}") for g, es in made.items() for a, b in es], "graph_id long, src string, dst string")
    got = sorted((r.graph_id, *r.nodes) for r in graphs.cliques(edges, size).collect())
    want = []
    for g, es in made.items():
        tied = set(es)
        want += [(g, *[f"n{v:02d}" for v in c]) for c in itertools.combinations(range(30), size) if all(p in tied for p in itertools.combinations(c, 2))]
    assert got == sorted(want)


def test_a_large_star_ends_and_its_lists_are_short(spark):
    n = 100_000
    edges = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("graph_id"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    edges = edges.union(spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3)], "graph_id long, src long, dst long"))
    assert [r.nodes for r in graphs.cliques(edges, 4).collect()] == [[0, 1, 2, 3]]
    assert graphs.later_neighbours(edges).agg(F.max(F.size("later"))).first()[0] <= 3


def test_folds_are_dealt_round_in_each_class(spark):
    labelled = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(203)], "graph_id long, class string").repartition(7)
    got = {r.graph_id: r.fold for r in src.stratified_folds(labelled, 5).collect()}
    for c in (lambda i: i % 4 == 0, lambda i: i % 4 != 0):
        order = sorted((i for i in range(203) if c(i)), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        assert [got[i] for i in order] == [k % 5 for k in range(len(order))]
