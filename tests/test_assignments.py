"""Assignments of predictions to true motifs, random planes and stochastic matching, against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.functions.hashing import md5_uniform
from lacewing.operators import pooling, scoring, vectors
from lacewing.plans import registry
from lacewing.sources import collections as src

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(3))
def test_best_assignment_is_the_best_of_all(spark, seed):
    rng = random.Random(seed)
    pairs = [(p, t, rng.random()) for p in range(5) for t in (1, 2, 3) if rng.random() < 0.7]
    table = dict(((p, t), j) for p, t, j in pairs)
    want = max(sum(table.get((p, t), 0.0) for t, p in enumerate(ps, 1)) for ps in itertools.permutations(range(-3, 5), 3))
    got = scoring.assigned_jaccard(spark.createDataFrame(pairs, "pred int, truth int, jaccard double")).first().jaccard
    assert got == pytest.approx(want) == pytest.approx(scoring.permutation_jaccard(pairs, 3))


def test_nothing_to_assign_and_too_much(spark):
    schema = "pred int, truth int, jaccard double"
    assert scoring.assigned_jaccard(spark.createDataFrame([], schema)).first().jaccard == 0.0
    with pytest.raises(ValueError):
        scoring.assigned_jaccard(spark.createDataFrame([(p, 1, 0.1) for p in range(30)], schema))


def test_background_is_a_prediction(spark):
    nodes = spark.createDataFrame([(1, i, p, t) for i, (p, t) in enumerate([(0, 1), (0, 1), (1, 1), (1, 2), (0, 0)])], "graph_id long, node long, pred int, truth int")
    got = {(r.pred, r.truth): r.jaccard for r in scoring.pairwise_jaccard(nodes, background=True).collect()}
    assert got == {(0, 1): 0.5, (1, 1): 0.25, (1, 2): 0.5}
    assert scoring.assigned_jaccard(scoring.pairwise_jaccard(nodes, background=True)).first().jaccard == 1.0


def test_decode_by_random_planes(spark):
    e = src.event_week(spark, SF)
    hist = {(r.graph_id, r.node): r.hist for r in pooling.degree_histograms(pooling.pool(e, 2)[1]["spot"], e, 16).collect()}
    planes = np.array(vectors.random_planes(8, 16))
    codes = {k: "".join("1" if x > 0 else "0" for x in planes @ np.array(h)) for k, h in hist.items()}
    number = {c: i for i, c in enumerate(sorted(set(codes.values())), 1)}
    rows = registry.QUERIES["g2_decode_random_planes"](spark, SF).collect()
    assert len(number) > 3 and all(r.motif == number[codes[r.graph_id, r.spotlight]] for r in rows)


def test_stochastic_matching_skips_by_score(spark):
    e = src.event_week(spark, SF).withColumn("s", pooling.edge_weight())
    drawn = e.filter(md5_uniform(F.concat_ws("|", F.lit(5), "graph_id", "src", "dst")) <= F.col("s"))
    rows = lambda df: {(r.graph_id, r.src, r.dst) for r in df.collect()}
    got = rows(pooling.greedy_matching(e, stochastic=True, seed=5))
    assert got == rows(pooling.greedy_matching(drawn)) and got != rows(pooling.greedy_matching(e)) and len(got) > 20
