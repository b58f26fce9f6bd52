"""Sets that know their induced edges as they grow, and what is made once a pattern."""

import pytest
from pyspark.sql import functions as F

from lacewing.operators import graphs, subgraphs

GRAPHS = [(1, [("b", "a"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c")]), (2, [("x", "m"), ("m", "a"), ("a", "z"), ("z", "x"), ("z", "k"), ("k", "m"), ("q", "r")]), (3, [("a", "b")])]


def edges(spark):
    return spark.createDataFrame([(g, min(p), max(p)) for g, es in GRAPHS for p in es], "graph_id long, src string, dst string")


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_growth_gathers_the_induced_edges(spark, k):
    e = edges(spark)
    rows = lambda df: sorted((r.graph_id, r.nodes, [tuple(x) for x in r.local]) for r in df.collect())
    assert rows(subgraphs.induced_subgraphs(e, k)) == rows(subgraphs.induced(subgraphs.enumerate_subgraphs(e, k), e))


def test_growth_joins_no_pairs_of_a_set_with_edges(spark):
    """The sets meet neighbours once a step, and no edges afterwards."""
    plan = subgraphs.induced_subgraphs(edges(spark), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2


@pytest.mark.parametrize("k", [3, 4])
def test_patterns_give_what_the_sets_give(spark, k):
    ind = subgraphs.induced_subgraphs(edges(spark), k)
    made = lambda df: subgraphs.wwl_vectors(subgraphs.wl_labels(df, None, 4), 32, 4)
    rows = lambda df: sorted((r.graph_id, r.nodes, r.vec) for r in df.select("graph_id", "nodes", "vec").collect())
    assert rows(subgraphs.by_pattern(ind, k, made)) == rows(made(ind))


def test_labels_are_made_once_a_pattern(spark):
    """Of many sets only the patterns pass through what is made."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda n: seen.add(1) or len(n), "int", useArrow=False).asNondeterministic()
    ind = subgraphs.induced_subgraphs(edges(spark), 3)
    got = subgraphs.by_pattern(ind, 3, lambda p: p.withColumn("size", count("nodes")))
    assert {r["size"] for r in got.collect()} == {3}
    assert seen.value <= 7


def test_triangles_meet_lists_once(spark):
    """Lists of later neighbours close all triangles; no wedge is a row."""
    import itertools
    import random

    rng = random.Random(4)
    es = {p for p in itertools.combinations(range(12), 2) if rng.random() < 0.4}
    df = graphs.triangles(spark.createDataFrame([(1, a, b) for a, b in es], "graph_id long, src long, dst long"))
    want = {t for t in itertools.combinations(range(12), 3) if all(p in es for p in itertools.combinations(t, 2))}
    assert sorted((r.a, r.b, r.c) for r in df.collect()) == sorted(want)
    assert "array_intersect" in df._jdf.queryExecution().optimizedPlan().toString()


def test_sampling_hashes_are_not_shuffled(spark):
    plan = subgraphs.sample_subgraphs(subgraphs.enumerate_subgraphs(edges(spark), 3), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("row_number()") < plan.index("md5") < plan.index("count(1)")
