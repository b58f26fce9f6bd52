"""The transport kernel of sets of labelled nodes, against the assignment of one pair at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.operators import graphs, subgraphs, vectors
from lacewing.plans import registry
from lacewing.sources import collections as src

SF = "/root/testdata/sf0.001"


def rounds_of(labelled):
    return {(r.graph_id, tuple(r.nodes)): np.array(r.rounds).T for r in labelled.collect()}


def test_kernel_covers_every_set(spark):
    e = src.event_week(spark, SF)
    labels = rounds_of(subgraphs.wl_labels(subgraphs.induced(subgraphs.enumerate_subgraphs(e, 4), e), None, 4))
    own = {(r.graph_id, tuple(r.nodes.split(","))): r.i for r in registry.QUERIES["g2_wwl_classes"](spark, SF).collect()}
    rows = registry.QUERIES["g2_wwl_kernel"](spark, SF).collect()
    kernel = {(r.i, r.j): r.kernel for r in rows}
    sizes = {(r.i, r.n_i) for r in rows}
    assert own.keys() == labels.keys() and sum(n for _, n in sizes) == len(own)
    some = sorted(labels)[::40]
    for x in some:
        for y in some:
            pair = tuple(sorted((own[x], own[y])))
            assert kernel.get(pair, math.exp(-1)) == pytest.approx(math.exp(-vectors.wasserstein(labels[x], labels[y])), abs=1e-6)


def test_sets_of_all_sizes_and_richer_labels(spark):
    """Labels are the nodes' degrees in the whole graph; sets have three to five nodes."""
    e = src.event_week(spark, SF).filter("graph_id % 5 = 0")
    labels = graphs.degrees(e).select("graph_id", "node", F.col("deg").cast("string").alias("label"))
    sets = None
    for k in (3, 4, 5):
        s = subgraphs.enumerate_subgraphs(e, k)
        sets = s if sets is None else sets.union(s)
    labelled = subgraphs.wl_labels(subgraphs.induced(sets, e), labels, 2).filter(F.pmod(F.xxhash64("graph_id", "nodes"), F.lit(9)) == 0)
    numbered = labelled.withColumn("id", F.xxhash64("graph_id", "nodes")).cache()
    known = {r.id: np.array(r.rounds).T for r in numbered.collect()}
    kernel = {(r.i, r.j): r.kernel for r in vectors.wwl_kernel(numbered, 0.7).collect()}
    assert 20 < len(known) and all(kernel[i, i] == pytest.approx(1.0) for i in known)
    ids = sorted(known)[:60]
    for i in ids:
        for j in [x for x in ids if x >= i]:
            assert kernel.get((i, j), math.exp(-0.7)) == pytest.approx(math.exp(-0.7 * vectors.wasserstein(known[i], known[j])))


def test_pairs_within_a_group_only(spark):
    rows = spark.createDataFrame([(1, 1, [["a", "b"]]), (1, 2, [["a", "a", "b"]]), (2, 3, [["a"]])], "batch long, id long, rounds array<array<string>>")
    got = {(r.batch, r.i, r.j): r.kernel for r in vectors.wwl_kernel(rows, within=("batch",)).collect()}
    assert got == {(1, 1, 1): pytest.approx(1.0), (1, 2, 2): pytest.approx(1.0), (2, 3, 3): pytest.approx(1.0), (1, 1, 2): pytest.approx(math.exp(-(1 - 5 / 6)))}


def test_first_pairs(spark):
    rows = spark.createDataFrame([(level, i) for level, n in ((1, 50), (2, 4), (3, 1)) for i in range(n)], "level int, id long")
    got = {}
    for r in vectors.first_pairs(rows, "level", 20).collect():
        got.setdefault(r.level, []).append((r.a, r.b))
    pairs = lambda n: [(a, b) for a in range(n) for b in range(a + 1, n)][:20]
    assert {k: sorted(v) for k, v in got.items()} == {1: pairs(50), 2: pairs(4)}
