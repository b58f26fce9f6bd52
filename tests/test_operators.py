"""Known answers, brute force on tiny graphs, and invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.operators import classification, ged, generators, graphs, pooling, results, scoring, subgraphs, vectors
from lacewing.sources import collections as src


def edges(spark, pairs, graph=1):
    return spark.createDataFrame([(graph, str(min(a, b)), str(max(a, b))) for a, b in pairs], "graph_id long, src string, dst string")


SQUARE = [(0, 1), (0, 2), (1, 3), (2, 3)]


def test_spotlights_unite_what_merged_nodes_cover(spark):
    spot = spark.createDataFrame([(1, "0", "1"), (1, "0", "2"), (1, "1", "3"), (1, "1", "4")], "graph_id long, node string, base string")
    cluster = spark.createDataFrame([(1, "0", "0"), (1, "1", "0")], "graph_id long, node string, cluster string")
    assert {(r.node, r.base) for r in pooling.next_spotlights(spot, cluster).collect()} == {("0", b) for b in "1234"}


def test_local_index(spark):
    nodes = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (2, 5)], "graph_id long, node long")
    assert [r.idx for r in graphs.local_index(nodes).orderBy("node").collect()] == [0, 1, 2, 0, 1, 0]


def test_four_cycle_is_one_set(spark):
    assert [r.nodes for r in subgraphs.enumerate_subgraphs(edges(spark, SQUARE), 4).collect()] == [list("0123")]
    assert subgraphs.squares(edges(spark, SQUARE)).count() == 1


def connected(nodes, pairs):
    seen, stack = set(), [nodes[0]]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            stack += [b if a == v else a for a, b in pairs if v in (a, b) and a in nodes and b in nodes]
    return len(seen) == len(nodes)


@pytest.mark.parametrize("k", [3, 4, 5])
def test_enumeration_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    pairs = [(a, b) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.35]
    want = sorted(list(map(str, s)) for s in itertools.combinations(range(8), k) if connected(list(s), pairs))
    e = edges(spark, pairs)
    assert sorted(r.nodes for r in subgraphs.enumerate_subgraphs(e, k).collect()) == want
    near = {v: sorted({b if a == v else a for a, b in pairs if v in (a, b)}) for v in range(8)}
    assert sorted(list(map(str, s)) for s in generators.esu_sample(near, rng, 1.0, k, k, 10**6)) == want


@pytest.mark.parametrize(("k", "classes"), [(3, 2), (4, 6), (5, 21)])
def test_certificates_tell_connected_graphs_apart(spark, k, classes):
    rows = []
    all_pairs = list(itertools.combinations(range(k), 2))
    for g, keep in enumerate(itertools.product([0, 1], repeat=len(all_pairs))):
        pairs = [p for p, x in zip(all_pairs, keep, strict=True) if x]
        if len({v for p in pairs for v in p}) == k and connected(list(range(k)), pairs):
            rows += [(g, str(a), str(b)) for a, b in pairs]
    e = spark.createDataFrame(rows, "graph_id long, src string, dst string")
    subs = graphs.nodes_of(e).groupBy("graph_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    assert subgraphs.certificates(subgraphs.induced(subs, e)).select("cert").distinct().count() == classes


def test_wl_vectors_sum_and_cert_counts_agree(spark):
    rng = np.random.default_rng(2)
    e = edges(spark, [p for p in itertools.combinations(range(9), 2) if rng.random() < 0.4])
    ind = subgraphs.induced(subgraphs.enumerate_subgraphs(e, 3), e)
    assert all(sum(r.vec) == 15 for r in subgraphs.wl_histograms(subgraphs.wl_labels(ind, None, 4), 32).collect())
    deg = graphs.degrees(e).select("graph_id", "node", F.col("deg").cast("string").alias("label"))
    assert all(sum(r.vec) == 15 for r in subgraphs.wl_histograms(subgraphs.wl_labels(ind, deg, 4), 32).collect())
    assert all(len(r.vec) == 32 and r.vec[30:] == [0, 0] for r in subgraphs.wwl_vectors(subgraphs.wl_labels(ind, None, 4), 32, 4).collect())
    slow = {(r.cert, r.n) for r in subgraphs.certificates(ind).groupBy("cert").agg(F.count("*").alias("n")).collect()}
    assert {(r.cert, r.n) for r in subgraphs.certificate_counts_k3(e).collect()} == slow


def test_gstat_by_hand(spark):
    counts = spark.createDataFrame([("a", 8, 2), ("b", 2, 8), ("c", 0, 5)], "bucket string, r_pos long, r_neg long")
    got = {r.bucket: r.score for r in scoring.gstat(counts).collect()}
    b = 10 / 25
    assert set(got) == {"a", "b"}
    assert math.isclose(got["a"], 2 * (8 * math.log(8 / (10 * b)) + 2 * math.log(2 / (10 * (1 - b)))))
    assert scoring.gstat(counts, signed=True).filter("bucket = 'b'").first().score < 0
    empty = counts.limit(0)
    assert scoring.gstat(empty).count() == 0


def test_permutation_jaccard_golden(spark):
    assert scoring.permutation_jaccard([(3, 1, 1.0)], 1) == 1.0
    assert scoring.permutation_jaccard([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.7)], 2) == pytest.approx(1.5)
    nodes = spark.createDataFrame([(1, i, p, t) for i, (p, t) in enumerate([(1, 0), (1, 0), (1, 0), (3, 1)])], "graph_id long, node long, pred int, truth int")
    assert [(r.pred, r.jaccard) for r in scoring.pairwise_jaccard(nodes).collect()] == [(3, 1.0)]


def test_ged_goldens():
    path = [(i, i + 1) for i in range(6)]
    a, b = ged.matrix(7, path, True), ged.matrix(7, [p for p in path if p != (2, 3)], True)
    assert ged.graph_edit_distance(a, a, "astar") == 0.0
    assert ged.graph_edit_distance(a, b, "astar") == 1.0
    assert ged.graph_edit_distance(None, None) == 0.0
    assert ged.graph_edit_distance(None, b) == 7 + 5


def test_ged_equals_all_mappings():
    rng = np.random.default_rng(5)
    for _ in range(12):
        n, m = rng.integers(1, 5, 2)
        a, b = (ged.matrix(k, [p for p in itertools.combinations(range(k), 2) if rng.random() < 0.5]) for k in (n, m))
        best = min(ged.edit_cost(a, b, [x if x < m else -1 for x in p[:n]]) for p in itertools.permutations(range(m + n), int(n)))
        assert ged.a_star(a, b) == best
        assert ged.bipartite(a, b) >= best and ged.a_star(a, b, 20) >= best


def test_assignment_is_least():
    rng = np.random.default_rng(6)
    for n in range(1, 6):
        c = rng.random((n, n))
        got, cost = ged.assignment(c)
        assert sorted(got.tolist()) == list(range(n))
        assert math.isclose(cost, min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_matching_is_the_greedy_one_and_levels_partition(spark):
    rng = np.random.default_rng(8)
    pairs = [p for p in itertools.combinations(range(12), 2) if rng.random() < 0.3]
    e = edges(spark, pairs)
    scored = e.withColumn("s", pooling.edge_weight())
    free, want = {v for p in pairs for v in p}, set()
    for r in sorted(scored.collect(), key=lambda r: (-r.s, r.src, r.dst)):
        if int(r.src) in free and int(r.dst) in free:
            want.add((r.src, r.dst))
            free -= {int(r.src), int(r.dst)}
    assert {(r.src, r.dst) for r in pooling.greedy_matching(scored).collect()} == want
    for level in pooling.pool(e, 3):
        assert sorted(r.base for r in level["spot"].collect()) == sorted(r.node for r in graphs.nodes_of(e).collect())


def test_softmax_sums_to_one(spark):
    e = edges(spark, SQUARE).withColumn("s", F.lit(700.0) + F.col("src").cast("double"))
    total = pooling.edge_softmax(e, ["graph_id"]).agg(F.sum("p")).first()[0]
    assert math.isclose(total, 1.0)
    assert [r.x for r in e.select(pooling.EDGE_SCORE["dummy"](F.col("s")).alias("x")).distinct().collect()] == [0.5]
    x = e.limit(1).select(pooling.linear(pooling.merge_features("sum", F.array(F.lit(1.0)), F.array(F.lit(2.0))), [[2.0]], [1.0]).alias("y")).first().y
    assert x == [7.0]


def test_traversal(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (4, 5)])
    seeds = spark.createDataFrame([(1, "0")], "graph_id long, node string")
    assert {(r.node, r.hop) for r in graphs.expand(e, seeds, 2).collect()} == {("0", 0), ("1", 1), ("2", 2)}
    assert {r.node for r in graphs.largest_component(e, graphs.nodes_of(e)).collect()} == set("0123")
    assert {(r.src, r.dst) for r in graphs.context_view(e, seeds).collect()} == {("0", "1")}
    assert graphs.line_graph(e).count() == 2
    assert graphs.cliques(edges(spark, itertools.combinations(range(6), 2)), 5).count() == 6


def test_shapes_have_the_promised_sizes(spark):
    size = {"star": (9, 8), "clique": (8, 28), "wheel": (8, 14), "barbell": (10, 15), "lollipop": (12, 14)}
    for shape, (n, m) in size.items():
        got = generators.motif_shape(spark, shape, 8).collect()
        assert (len({v for r in got for v in (r.src, r.dst)}), len(got)) == (n, m), shape


def test_swaps_keep_degrees(spark):
    rng = np.random.default_rng(9)
    e = edges(spark, [p for p in itertools.combinations(range(14), 2) if rng.random() < 0.3])
    for connected_only in (False, True):
        swapped = generators.swap_null(e, 200, 3, connected_only)
        key = lambda x: {(r.node, r.deg) for r in graphs.degrees(x).collect()}
        assert key(swapped) == key(e)
        assert swapped.distinct().count() == e.count()
        assert {tuple(r) for r in swapped.collect()} != {tuple(r) for r in e.collect()}


def test_planted_motif_is_found(spark):
    parents = generators.connected_parents(spark, 10, 12, 0.2)
    motif = [(r.src, r.dst) for r in generators.motif_shape(spark, "clique", 5).collect()]
    pairs, truth = generators.plant(parents, motif, 5)
    pos = pairs.filter("role = 'pos'").select("graph_id", "src", "dst").distinct()
    top = graphs.cliques(pos, 5).select("graph_id", F.explode("nodes").alias("node")).distinct()
    got = scoring.micro_jaccard(top.withColumn("bucket", F.lit("k5")), truth, ["bucket"]).first()
    assert got.jaccard == 1.0


def test_planes_separate_classes(spark):
    rng = np.random.default_rng(10)
    rows = [("pos" if i % 2 else "neg", (rng.normal(0, 1, 6) + (3 if i % 2 else 0) * np.eye(6)[2]).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "role string, z array<double>")
    planes, separation = vectors.lda_planes(df, 6, 4)
    assert abs(planes[0][2]) > 0.9 and separation > 1.2 and planes.shape == (4, 6)
    assert np.allclose(planes[1:] @ planes[0], 0, atol=1e-8)
    axes, share = vectors.pca_planes(df, 6, 2)
    assert abs(axes[0][2]) > 0.9 and share[0] > share[1]
    leaves = vectors.tree_leaves(df, 6)
    assert leaves.groupBy("leaf").count().agg(F.min("count")).first()[0] >= 20


def test_splits_and_folds(spark):
    g = spark.range(25).toDF("graph_id")
    for split in (src.ordered_split(g), src.random_split(g), src.ordered_split(g, lexicographic=True)):
        assert sorted(r["count"] for r in split.groupBy("split").count().collect()) == [5, 20]
    assert {r.graph_id for r in src.ordered_split(g, n_graphs=10).filter("split = 'train'").collect()} == set(range(8))
    folds = src.stratified_folds(g.withColumn("class", F.col("graph_id") % 2), 5)
    assert folds.groupBy("fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 2
    assert {r.role: r["count"] for r in src.validation_slice(folds, 1).groupBy("role").count().collect()}["val"] == 2


def test_graphs_from_edges_ignores_loops_and_repeats(spark):
    df = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 3, 3), (None, 1, 2)], "g long, a long, b long")
    assert {tuple(r) for r in src.graphs_from_edges(df, "g", "a", "b").collect()} == {(1, 1, 2), (None, 1, 2)}
    assert graphs.triangles(edges(spark, SQUARE).limit(0)).count() == 0


def test_result_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7)], "name string, level int, j double")
    assert results.markdown(rows.limit(1)).splitlines()[2] == "| a | 1 | 0.5 |"
    results.append_csv(rows, str(tmp_path / "x"))
    results.append_csv(rows, str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 4
    e = edges(spark, SQUARE)
    src.write_mfinder(src.mfinder_lines(e, graphs.nodes_of(e)), str(tmp_path / "m"))
    assert {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {f"{a} {b} 1" for a, b in SQUARE}


def test_forest_learns(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(i % 2) + rng.normal(0, 0.1), 0.0]) for i in range(60)]
    features = spark.createDataFrame(rows, "graph_id long, x array<double>")
    folds = spark.createDataFrame([(i, i % 2, (i // 2) % 3) for i in range(60)], "graph_id long, class int, fold int")
    assert min(r.accuracy for r in classification.cross_validate(features, folds, 3, trees=5).collect()) > 0.9
    levels = [spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "graph_id long, vec array<double>")] * 2
    assert classification.level_embeddings(levels).first().x == [4.0, 6.0, 4.0, 6.0]
