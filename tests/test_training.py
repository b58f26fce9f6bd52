"""Training of the edge scorer: gradients against finite differences, falling losses, restarts, pooling with trained scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.operators import graphs, pooling, training
from lacewing.sources import collections as src

SF = "/root/testdata/sf0.001"


def features(edges, width):
    labels = graphs.degrees(edges).select("graph_id", "node", F.least(F.col("deg") - 1, F.lit(width - 1)).alias("label"))
    return graphs.one_hot(labels, width)


@pytest.fixture(scope="module")
def data(spark):
    e = src.event_week(spark, SF)
    even = F.floor(F.col("graph_id") / 100) % 2 == 0
    pos, neg = e.filter(even & (F.col("graph_id") % 4 == 0)).cache(), e.filter(~even & (F.col("graph_id") % 4 == 0)).cache()
    return pos, neg, features(pos, 4).cache(), features(neg, 4).cache()


@pytest.mark.parametrize("merge", ["sum", "cat"])
def test_gradients_equal_finite_differences(data, merge):
    pos, neg, x_pos, x_neg = data
    scorer = training.Scorer(4, 3, 1, merge)
    laid = training.coarsening(pos, neg, x_pos, x_neg, scorer, batch_size=4, k=3, seed=1)
    assert len(laid.rows) == 2 and laid.edges[0] == pos.count() and laid.batches[0] > 1
    rng = np.random.default_rng(0)
    for phase in ("rec", "mot"):
        loss, g = training.loss_and_gradient(laid, x_pos, scorer, phase, 0.5)
        assert math.isfinite(loss) and np.abs(g).max() > 0
        way, ends = rng.normal(size=len(g)), []
        for h in (1e-5, -1e-5):
            moved = training.Scorer(4, 3, 1, merge, scorer.theta + h * way)
            ends.append(training.loss_and_gradient(laid, x_pos, moved, phase, 0.5, gradient=False)[0])
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(float(g @ way), rel=1e-5, abs=1e-9)


def test_reconstruction_loss_is_that_of_all_pairs(data):
    """The loss against a plain loop over a batch's first edges."""
    pos, neg, x_pos, x_neg = data
    scorer = training.Scorer(4, 3, 0)
    laid = training.coarsening(pos, neg, x_pos, x_neg, scorer, batch_size=4, seed=1, phase="rec")
    w, b, _, _ = scorer.layer(0)
    x = {(r.graph_id, r.node): np.array(r.x) for r in x_pos.collect()}
    batches = {}
    for r in laid.rows[0].filter("place is not null").collect():
        batches.setdefault(r.batch, []).append((r.place, w @ (x[r.graph_id, r.src] + x[r.graph_id, r.dst]) + b))
    total = 0.0
    for rows in batches.values():
        assert len(rows) <= training.FIRST and [p for p, _ in sorted(rows)] == list(range(1, len(rows) + 1))
        for _, a in rows:
            for _, c in rows:
                # at the first level every edge covers two tied nodes: all kernels are 1
                total += (a @ c / np.linalg.norm(a) / np.linalg.norm(c) - 1) ** 2 / len(rows) ** 2 / len(batches)
    assert training.loss_and_gradient(laid, x_pos, scorer, "rec", gradient=False)[0] == pytest.approx(total)


def test_losses_fall_and_a_restored_run_goes_on_alike(spark, data, tmp_path):
    pos, neg, x_pos, x_neg = data
    options = dict(steps_an_epoch=1, batch_size=8, k=3, seed=5)
    run = training.Run(training.Scorer(4, 4, 1), training.Adam(0.02), patience=1)
    training.train(run, pos, neg, x_pos, x_neg, 1, path=str(tmp_path / "run"), **options)
    again = training.Run.load(str(tmp_path / "run"), spark)
    assert again.epoch == run.epoch == 1 and np.array_equal(again.scorer.theta, run.scorer.theta) and again.history == run.history
    training.train(run, pos, neg, x_pos, x_neg, 2, **options)
    training.train(again, pos, neg, x_pos, x_neg, 2, **options)
    assert np.allclose(again.scorer.theta, run.scorer.theta, atol=1e-9) and again.history[-1][1] == run.history[-1][1]
    for phase in ("rec", "mot"):
        scorer = training.Scorer(4, 4, 1)
        laid = training.coarsening(pos, neg, x_pos, x_neg, scorer, batch_size=8, k=3, seed=9, phase=phase)
        adam, losses = training.Adam(0.02), []
        for _ in range(3):
            loss, g = training.loss_and_gradient(laid, x_pos, scorer, phase)
            losses.append(loss)
            scorer.theta = adam.moved(scorer.theta, g)
        assert losses == sorted(losses, reverse=True)


def test_phases_follow_each_other():
    run = training.Run(training.Scorer(2, 2, 0), patience=2)
    assert run.phase() == "rec"
    run.history = [(i, "rec", 0.0, x) for i, x in enumerate([3.0, 2.0, 2.5, 2.6])]
    assert run.phase() == "mot"
    run.history += [(i, "mot", 0.0, 1.0) for i in range(4, 7)]
    assert run.phase() is None


def test_pool_takes_trained_scores(spark, data):
    pos, _, x_pos, _ = data
    scorer = training.Scorer(4, 3, 1)
    hook = training.TrainedScores(scorer, x_pos)
    levels = pooling.pool(pos, 2, trained=hook)
    w, b, v, c = scorer.layer(0)
    x = {(r.graph_id, r.node): np.array(r.x) for r in x_pos.collect()}
    best = {}
    for r in pos.collect():
        s = 1 / (1 + math.exp(-(v @ (w @ (x[r.graph_id, r.src] + x[r.graph_id, r.dst]) + b) + c)))
        best.setdefault(r.graph_id, []).append((-s, r.src, r.dst))
    want = set()
    for g, edges in best.items():
        used = set()
        for s, a, z in sorted(edges, key=lambda e: (round(e[0], 12), e[1], e[2])):
            if a not in used and z not in used:
                used |= {a, z}
                want.add((g, a, z))
    got = {(r.graph_id, r.src, r.dst) for r in hook.rows[0].filter("edge and cluster is not null").collect()}
    assert got == want and len(levels) == 2
    # every node is in one cluster, and its features went up with it
    assert hook.rows[1].select("graph_id", F.explode(F.array("src", "dst")).alias("n")).distinct().count() == levels[0]["cluster"].select("graph_id", "cluster").distinct().count()
