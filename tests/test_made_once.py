"""What equal patterns share is made once, and equals what is made row by row."""

import numpy as np
from pyspark.sql import functions as F

from lacewing.operators import classification, graphs, pooling, subgraphs, vectors
from lacewing.plans import registry
from lacewing.sources import collections as src

SF = "/root/testdata/sf0.001"


def test_codes_of_all_folds_equal_simhash(spark):
    rng = np.random.default_rng(3)
    planes = [rng.normal(size=(5, 6)), np.zeros((5, 6)), rng.normal(size=(2, 6)), np.round(rng.normal(size=(16, 6)))]
    z = np.round(rng.normal(size=(300, 6)) * 3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "graph_id long, z array<double>").select("z", "graph_id")
    coded = classification._coded(rows, planes)
    want = [vectors.simhash(F.col("z"), p.tolist()).alias(f"w{f}") for f, p in enumerate(planes)]
    got = coded.select("*", *want).collect()
    assert len(got) == 300 and all(r[f"c{f}"] == r[f"w{f}"] for r in got for f in range(len(planes)))


def test_labelled_patterns_are_labelled_once(spark):
    e = src.event_week(spark, SF)
    labels = graphs.degrees(e).select("graph_id", "node", F.col("deg").cast("string").alias("label"))
    ind = subgraphs.induced(subgraphs.enumerate_subgraphs(e, 3), e)
    seen = []

    def made(p):
        seen.append(p.count())
        return subgraphs.wl_histograms(subgraphs.wl_rounds(p, 4), 32)

    rows = lambda df: sorted((r.graph_id, r.nodes, r.vec) for r in df.select("graph_id", "nodes", "vec").collect())
    labelled = subgraphs.first_labels(ind, labels)
    got = rows(subgraphs.by_labelled_pattern(labelled, made))
    assert got == rows(subgraphs.wl_histograms(subgraphs.wl_labels(ind, labels, 4), 32))
    assert seen == [labelled.select("local", "lab").distinct().count()] and seen[0] < len(got)


def test_matching_takes_a_chain_in_one_pass(spark, monkeypatch):
    """Scores fall along the chain, so that rounds would take an edge each; other graphs are random."""
    rng = np.random.default_rng(7)
    rows = [(0, f"v{i:03d}", f"v{i + 1:03d}", 1.0 - i / 400) for i in range(300)]
    rows += [(g, f"v{a:02d}", f"v{b:02d}", float(rng.integers(1, 4))) for g in range(1, 9) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.4]
    scored = spark.createDataFrame(rows, "graph_id long, src string, dst string, s double").repartition(3)
    spark.sparkContext.setJobGroup("chain", "matching")
    got = sorted(map(tuple, pooling.greedy_matching(scored).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "")
    assert [r[1] for r in got if r[0] == 0] == [f"v{i:03d}" for i in range(0, 300, 2)] and jobs < 30
    monkeypatch.setattr(pooling, "LARGE", 20)
    few = scored.filter("graph_id > 0")
    counts = {r.graph_id: r["count"] for r in few.groupBy("graph_id").count().collect()}
    assert min(counts.values()) < 20 <= max(counts.values())
    assert sorted(map(tuple, pooling.greedy_matching(few).collect())) == [r for r in got if r[0] > 0]


def test_graphs_of_short_lists_are_not_peeled(spark, monkeypatch):
    edges = spark.createDataFrame([(g, a, b) for g in (1, 2) for a in range(12) for b in range(a + 1, 12) if (a * b + g) % 3], "graph_id long, src long, dst long")
    count = lambda: sorted((r.graph_id, *r.nodes) for r in graphs.cliques(edges, 4).collect())
    rounds, peeled = [], graphs.peeled
    monkeypatch.setattr(graphs, "peeled", lambda e: rounds.append(1) or peeled(e))
    want = count()
    assert want and not rounds
    monkeypatch.setattr(graphs, "LONG", 5)
    assert count() == want and rounds


def test_classes_are_named_once_a_pattern(spark, monkeypatch):
    """Labels are made for the 63 graphs on four places, not for the sets."""
    sizes, made = [], subgraphs.wl_labels
    monkeypatch.setattr(subgraphs, "wl_labels", lambda ind, *rest: sizes.append(ind.count()) or made(ind, *rest))
    kernel = registry.QUERIES["g2_wwl_kernel"](spark, SF).collect()
    counts = {r.i: r["count"] for r in registry.QUERIES["g2_wwl_classes"](spark, SF).groupBy("i").count().collect()}
    assert sizes == [63, 63] and counts == {r.i: r.n_i for r in kernel}
