"""Graph convolutions by joins, against dense matrices and finite differences."""

import numpy as np
import pytest

from lacewing.operators import message_passing as M

GRAPHS = {1: [(0, 1), (1, 2), (2, 3)], 2: [(0, 1), (0, 2), (1, 2)], 3: [(0, i) for i in range(1, 6)], 4: [(0, 1)]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    nodes = {g: sorted({v for e in es for v in e}) for g, es in GRAPHS.items()}
    x = {(g, v): rng.normal(size=3) for g in GRAPHS for v in nodes[g]}
    edges = spark.createDataFrame([(g, a, b) for g, es in GRAPHS.items() for a, b in es], "graph_id long, src long, dst long").cache()
    values = spark.createDataFrame([(g, v, z.tolist()) for (g, v), z in x.items()], "graph_id long, node long, x array<double>").cache()
    return edges, values, nodes, x


def dense(g, nodes):
    n = len(nodes[g])
    a = np.eye(n)
    for i, j in GRAPHS[g]:
        a[i, j] = a[j, i] = 1
    d = a.sum(1)
    return a / np.sqrt(d[:, None] * d[None])


def forward(model, nodes, x):
    w1, b1, w2, b2, u, c = model.parts()
    out = {}
    for g in GRAPHS:
        a, h = dense(g, nodes), np.array([x[g, v] for v in nodes[g]])
        for f in range(model.folds):
            one = np.maximum(a @ h @ w1[f] + b1[f], 0)
            two = np.maximum(a @ one @ w2[f] + b2[f], 0)
            out[g, f] = 1 / (1 + np.exp(-(two.mean(0) @ u[f] + c[f])))
    return out


def test_one_product_equals_the_dense_one(data):
    edges, values, nodes, x = data
    got = {(r.graph_id, r.node): r.x for r in M.propagated(M.normalised(edges), values, "x", 3).collect()}
    for g in GRAPHS:
        want = dense(g, nodes) @ np.array([x[g, v] for v in nodes[g]])
        assert all(np.allclose(got[g, v], want[i]) for i, v in enumerate(nodes[g]))


def test_outputs_and_gradients_of_all_folds(spark, data):
    edges, values, nodes, x = data
    rng = np.random.default_rng(1)
    model = M.Convolutions(3, 4, 2)
    model.theta = model.theta + 0.2 * rng.normal(size=model.theta.shape)
    norm = M.normalised(edges).cache()
    first = M.propagated(norm, values.withColumnRenamed("x", "s0"), "s0", 3).cache()
    want = forward(model, nodes, x)
    got = {r.graph_id: r.p for r in M.outputs(model, norm, first).collect()}
    assert all(np.isclose(got[g][f], want[g, f]) for g, f in want)
    y, weight = {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0}, {1: [0.5, 0.0], 2: [0.5, 0.3], 3: [0.0, 0.3], 4: [0.2, 0.3]}
    targets = spark.createDataFrame([(g, y[g], weight[g]) for g in GRAPHS], "graph_id long, y double, weight array<double>")

    def losses(theta):
        p = forward(M.Convolutions(3, 4, 2, theta), nodes, x)
        return np.array([sum(-weight[g][f] * np.log(p[g, f] if y[g] else 1 - p[g, f]) for g in GRAPHS) for f in range(2)])

    loss, gradient = M.loss_and_gradient(model, norm, first, targets)
    assert np.allclose(loss, losses(model.theta))
    for _ in range(5):
        way = rng.normal(size=model.theta.shape)
        slope = (losses(model.theta + 1e-6 * way) - losses(model.theta - 1e-6 * way)) / 2e-6
        assert np.allclose(slope, (gradient * way).sum(1), rtol=1e-4, atol=1e-7)


def test_validation_keeps_the_best_step(spark, data):
    edges, values, _, _ = data
    folds = spark.createDataFrame([(g, g % 3, g % 2) for g in GRAPHS], "graph_id long, fold int, class int")
    rows = M.validated(edges, values, folds, 3, 3, dim=3, steps=2, every=1).orderBy("fold").collect()
    assert [r.fold for r in rows] == [0, 1, 2] and all(1 <= r.step <= 2 and 0 <= r.accuracy <= 1 for r in rows)


def test_nodes_and_graphs_alike_stand_for_all(spark, data):
    """One node and one graph of each name give the losses and gradients of all; twenty copies of the graphs add no rows to a step."""
    edges, _, nodes, _ = data
    copies = 20
    x = spark.createDataFrame([(g + 10 * k, v, [1.0, float(sum(v in e for e in GRAPHS[g]))]) for k in range(copies) for g in GRAPHS for v in nodes[g]], "graph_id long, node long, x array<double>").cache()
    many = spark.createDataFrame([(g + 10 * k, a, b) for k in range(copies) for g, es in GRAPHS.items() for a, b in es], "graph_id long, src long, dst long").cache()
    rows = [(g + 10 * k, k % 2, float((g + k) % 3 == 0), [0.1 * (g % 2), 0.05]) for k in range(copies) for g in GRAPHS]
    targets = spark.createDataFrame(rows, "graph_id long, fold int, y double, weight array<double>")
    laid, kinds = M.alike(many, x, targets, 2)
    # ends and middles of the path; a triangle; a hub and its leaves; an edge
    assert laid.first.count() == laid.members.count() == 6 and laid.members.select("graph").distinct().count() == len(GRAPHS)
    assert sum(r.n for r in kinds.collect()) == len(rows)
    model = M.Convolutions(2, 3, 2)
    model.theta = model.theta + 0.2 * np.random.default_rng(3).normal(size=model.theta.shape)
    norm = M.normalised(many)
    first = M.propagated(norm, x.withColumnRenamed("x", "s0"), "s0", 2)
    for got, want in zip(M._loss_and_gradient(model, laid, kinds), M.loss_and_gradient(model, norm, first, targets), strict=True):
        assert np.allclose(got, want)
