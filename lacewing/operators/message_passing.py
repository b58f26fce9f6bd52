"""Graph convolutions trained by gradient descent, for all folds at once.

A layer averages a node's features with its neighbours', each divided by the
roots of both degrees, and maps them linearly: a sparse product as a join and a
sum. The normalised adjacency is symmetric, so the backward pass is the same
product. Each fold has parameters of its own; a node carries the features of
all folds side by side, and one pass over the edges serves them all. Partial
gradients leave each task as one row, and the driver holds only vectors of the
parameters' size.

Nodes whose surroundings are equal have equal features in every step, and so
have graphs of equal nodes. ``validated`` names each by a hash of the multiset of
its neighbours' names, and works on one node and one graph of each name, with
their numbers; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .graphs import adjacency, degrees
from .training import Adam, _lists, _matrix, _summed

VECTOR = "array<double>"


def normalised(edges: DataFrame) -> DataFrame:
    """graph_id, a, b, w: adjacency with loops, divided by the roots of both ends' degrees (loops counted)."""
    deg = degrees(edges).select("graph_id", F.col("node").alias("a"), (F.col("deg") + 1).alias("d"))
    both = adjacency(edges).join(deg, ["graph_id", "a"]).join(deg.toDF("graph_id", "b", "e"), ["graph_id", "b"])
    loops = deg.select("graph_id", "a", F.col("a").alias("b"), (1 / F.col("d")).alias("w"))
    return both.select("graph_id", "a", "b", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("w")).unionByName(loops)


def propagated(norm: DataFrame, values: DataFrame, column: str, width: int) -> DataFrame:
    """graph_id, node, column: the sparse product of the normalised adjacency with the nodes' vectors."""
    near = norm.join(values.select("graph_id", F.col("node").alias("b"), column), ["graph_id", "b"])
    weighed = near.select("graph_id", F.col("a").alias("node"), F.transform(column, lambda x: x * F.col("w")).alias(column))
    return _summed(weighed, column, ["graph_id", "node"], width)


@dataclass
class Convolutions:
    """Two layers, a mean over the graph and a logistic output, for each of ``folds``; theta is folds x size."""

    n_features: int
    dim: int
    folds: int
    theta: np.ndarray | None = None

    def __post_init__(self):
        if self.theta is None:
            rng, parts = np.random.default_rng(0), []
            for n in (self.n_features, self.dim):
                parts += [rng.normal(0, np.sqrt(2 / n), n * self.dim), np.full(self.dim, 0.01)]
            self.theta = np.tile(np.concatenate([*parts, rng.normal(0, np.sqrt(1 / self.dim), self.dim), [0.0]]), (self.folds, 1))

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([0, self.n_features * self.dim, self.dim, self.dim * self.dim, self.dim, self.dim, 1]).tolist()

    def parts(self) -> list[np.ndarray]:
        """W1 (folds, features, dim), b1, W2, b2, u (folds, dim), c (folds)."""
        p = [self.theta[:, a:z] for a, z in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        return [p[0].reshape(self.folds, self.n_features, self.dim), p[1], p[2].reshape(self.folds, self.dim, self.dim), p[3], p[4], p[5][:, 0]]


@dataclass
class Laid:
    """Where features go: ``links`` (to, near, w) from the first layer to the second, ``first`` (near, s0), ``members`` (graph, to, share)."""

    links: DataFrame
    first: DataFrame
    members: DataFrame


def _node_by_node(norm: DataFrame, first: DataFrame) -> Laid:
    key = lambda c: F.struct("graph_id", F.col(c).alias("node"))
    sizes = first.groupBy("graph_id").agg((1 / F.count("*")).alias("share"))
    members = first.join(sizes, "graph_id").select(F.col("graph_id").alias("graph"), key("node").alias("to"), "share")
    return Laid(norm.select(key("a").alias("to"), key("b").alias("near"), "w"), first.select(key("node").alias("near"), "s0"), members)


def _named(rows: DataFrame, by: list[str], *of: str) -> DataFrame:
    """by, name: a name of 128 bits that equal multisets of the columns ``of`` share; summed up wherever rows are, so no list is made."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *of).cast("decimal(20,0)")).alias(f"_{seed}") for seed in (0, 1)]
    return rows.groupBy(*by).agg(F.count("*").alias("_n"), *sums).select(*by, F.md5(F.concat_ws("|", "_n", "_0", "_1")).alias("name"))


def _spread(links: DataFrame, values: DataFrame, to: str, near: str, weight: str, column: str, width: int) -> DataFrame:
    """to, column: the sum over links of the weight times the vector of ``near``."""
    met = links.join(values, near).select(to, F.transform(column, lambda x: x * F.col(weight)).alias(column))
    return _summed(met, column, [to], width)


def alike(edges: DataFrame, x: DataFrame, targets: DataFrame, n_features: int) -> tuple[Laid, DataFrame]:
    """(one node and one graph of each name, the graphs' targets): ``targets`` has graph_id, fold, y and weight; what comes back graph, fold, y, weight times n, and n.

    Only graphs with a target count.
    """
    norm = cut(normalised(edges.join(targets.select("graph_id"), "graph_id", "left_semi")))
    zero = x.select("graph_id", F.col("node").alias("b"), F.md5(F.concat_ws(",", F.col("x").cast("array<string>"))).alias("name"))
    one = cut(_named(norm.join(zero, ["graph_id", "b"]), ["graph_id", "a"], "w", "name"))
    near = one.select("graph_id", F.col("a").alias("b"), F.col("name").alias("near"))
    two = cut(_named(norm.join(near, ["graph_id", "b"]), ["graph_id", "a"], "w", "near"))
    # a node stands for all of its name
    pick = F.min(F.struct("graph_id", "a")).alias("p")
    lowest = one.groupBy("name").agg(pick).select("p.graph_id", "p.a", F.col("name").alias("near"))
    values = norm.join(lowest, ["graph_id", "a"]).join(x.select("graph_id", F.col("node").alias("b"), F.col("x").alias("s0")), ["graph_id", "b"])
    first = _summed(values.select("near", F.transform("s0", lambda v: v * F.col("w")).alias("s0")), "s0", ["near"], n_features)
    upper = two.groupBy("name").agg(pick).select("p.graph_id", "p.a", F.col("name").alias("to"))
    links = norm.join(upper, ["graph_id", "a"]).join(near, ["graph_id", "b"]).groupBy("to", "near").agg(F.sum("w").alias("w"))
    graphs = cut(_named(two, ["graph_id"], "name"))
    # graphs of one name are one in each fold, class and weight
    kinds = targets.join(graphs, "graph_id").groupBy("name", "fold", "y", "weight").agg(F.count("*").alias("n"))
    kinds = kinds.select(F.col("name").alias("graph"), "fold", "y", F.transform("weight", lambda v: v * F.col("n")).alias("weight"), "n")
    chosen = graphs.groupBy("name").agg(F.min("graph_id").alias("graph_id")).withColumnRenamed("name", "graph")
    counts = two.join(chosen, "graph_id").groupBy("graph", F.col("name").alias("to")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy("graph").agg(F.sum("c").alias("size"))
    members = counts.join(sizes, "graph").select("graph", "to", (F.col("c") / F.col("size")).alias("share"))
    return Laid(cut(links), cut(first), cut(members)), cut(kinds)


def _mapped(rows: DataFrame, use: list[str], schema: str, f) -> DataFrame:
    """``f`` over the vectors in columns ``use`` of each batch; it gives the columns of ``schema`` after the key."""
    kinds = {x.name: x.dataType.simpleString() for x in rows.schema.fields}
    keys = [c for c in ("graph", "to", "near") if c in rows.columns]
    names = [*keys, *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(*[_matrix(b.column(len(keys) + i)) for i in range(len(use))])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *map(_lists, out)], names=names)

    return rows.select(*keys, *use).mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], schema]))


def _gathered(rows: DataFrame, use: list[str], size: int, f) -> np.ndarray:
    """The sum over all batches of the vector that ``f`` makes of the columns ``use``; one row a task goes to Spark's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = f(*[_matrix(b.column(i)) for i in range(len(use))])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([_lists(total[None, :])], names=["g"])

    parts = rows.select(*use).mapInArrow(run, f"g {VECTOR}").select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(size)
    for r in parts:
        out[r.i] = r.g
    return out


def _hidden(model: Convolutions, laid: Laid) -> tuple[DataFrame, DataFrame]:
    """(to, s1; graph, h): the inputs of the last layer, and each graph's mean of its outputs."""
    w1, b1, w2, b2, _, _ = model.parts()
    folds, dim = model.folds, model.dim
    one = lambda s0: [np.maximum(np.einsum("ri,fio->rfo", s0, w1) + b1, 0.0).reshape(len(s0), -1)]
    nodes = cut(_spread(laid.links, _mapped(laid.first, ["s0"], f"s1 {VECTOR}", one), "to", "near", "w", "s1", folds * dim))
    two = lambda s: [np.maximum(np.einsum("rfi,fio->rfo", s.reshape(len(s), folds, dim), w2) + b2, 0.0).reshape(len(s), -1)]
    return nodes, _spread(laid.members, _mapped(nodes, ["s1"], f"h {VECTOR}", two), "graph", "to", "share", "h", folds * dim)


def outputs(model: Convolutions, norm: DataFrame, first: DataFrame) -> DataFrame:
    """graph_id, p: each graph's probability of class 1 under each fold's parameters."""
    return _judged(model, _node_by_node(norm, first)).withColumnRenamed("graph", "graph_id")


def _judged(model: Convolutions, laid: Laid) -> DataFrame:
    """graph, p."""
    u, c = model.parts()[4:]
    p = lambda h: [1 / (1 + np.exp(-(np.einsum("rfo,fo->rf", h.reshape(len(h), *u.shape), u) + c)))]
    return _mapped(_hidden(model, laid)[1], ["h"], f"p {VECTOR}", p)


def loss_and_gradient(model: Convolutions, norm: DataFrame, first: DataFrame, targets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(loss of each fold, folds x size gradient) of the cross entropy.

    ``first`` is graph_id, node, s0: the features propagated once. ``targets``
    is graph_id, y and weight, an array of each fold's weight of the graph: zero
    where it is held out of the fold.
    """
    return _loss_and_gradient(model, _node_by_node(norm, first), targets.withColumnRenamed("graph_id", "graph"))


def _loss_and_gradient(model: Convolutions, laid: Laid, targets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of graph, y and weight; a graph may have several rows."""
    w1, b1, w2, b2, u, c = model.parts()
    folds, dim = model.folds, model.dim
    nodes, pooled = _hidden(model, laid)
    judged = cut(pooled.join(targets.select("graph", F.array("y").alias("y"), "weight"), "graph"))

    def error(h, y, weight):
        h = h.reshape(len(h), folds, dim)
        p = 1 / (1 + np.exp(-(np.einsum("rfo,fo->rf", h, u) + c)))
        return h, p, weight * (p - y)

    def top(h, y, weight):
        h, p, d = error(h, y, weight)
        q = np.clip(np.where(y > 0.5, p, 1 - p), 1e-12, 1.0)
        return np.concatenate([np.einsum("rf,rfo->fo", d, h).ravel(), d.sum(0), (-weight * np.log(q)).sum(0)])

    found = _gathered(judged, ["h", "y", "weight"], folds * dim + 2 * folds, top)
    back = _mapped(judged, ["h", "y", "weight"], f"d {VECTOR}", lambda h, y, weight: [(error(h, y, weight)[2][:, :, None] * u).reshape(len(h), -1)])
    back = _summed(back, "d", ["graph"], folds * dim)
    level = cut(nodes.join(_spread(laid.members, back, "to", "graph", "share", "d", folds * dim), "to"))

    def last(s1, d):
        s1 = s1.reshape(len(s1), folds, dim)
        on = np.einsum("rfi,fio->rfo", s1, w2) + b2 > 0
        return s1, d.reshape(len(d), folds, dim) * on

    def second(s1, d):
        s1, dz = last(s1, d)
        return np.concatenate([np.einsum("rfi,rfo->fio", s1, dz).reshape(folds, -1), dz.sum(0)], 1).ravel()

    g2 = _gathered(level, ["s1", "d"], folds * (dim * dim + dim), second).reshape(folds, -1)
    down = _mapped(level, ["s1", "d"], f"d {VECTOR}", lambda s1, d: [np.einsum("rfo,fio->rfi", last(s1, d)[1], w2).reshape(len(d), -1)])
    reached = laid.first.join(_spread(laid.links, down, "near", "to", "w", "d", folds * dim), "near")

    def lowest(s0, d):
        dz = d.reshape(len(d), folds, dim) * (np.einsum("ri,fio->rfo", s0, w1) + b1 > 0)
        return np.concatenate([np.einsum("ri,rfo->fio", s0, dz).reshape(folds, -1), dz.sum(0)], 1).ravel()

    g1 = _gathered(reached, ["s0", "d"], folds * (model.n_features * dim + dim), lowest).reshape(folds, -1)
    du, dc, loss = found[: folds * dim].reshape(folds, dim), found[folds * dim : folds * dim + folds], found[-folds:]
    return loss, np.concatenate([g1, g2, du, dc[:, None]], 1)


def validated(edges: DataFrame, x: DataFrame, folds: DataFrame, n_folds: int, n_features: int, dim: int = 8, steps: int = 20, rate: float = 0.02, every: int = 5) -> DataFrame:
    """fold, step, validation, accuracy: of the step at which a fold did best on its validation graphs, the next fold's; trained on the rest.

    ``x`` has graph_id, node, x; ``folds`` graph_id, fold, class (0 or 1).
    """
    held = F.array(*[(F.col("fold") == f) | (F.col("fold") == (f + 1) % n_folds) for f in range(n_folds)])
    counts = folds.groupBy("fold").count().collect()  # a row a fold
    size = {r.fold: r["count"] for r in counts}
    total = sum(size.values())
    share = [1 / max(1, total - size.get(f, 0) - size.get((f + 1) % n_folds, 0)) for f in range(n_folds)]
    weight = F.zip_with(held, F.array(*map(F.lit, share)), lambda h, w: F.when(h, 0.0).otherwise(w))
    targets = cut(folds.select("graph_id", "fold", F.col("class").cast("double").alias("y"), weight.alias("weight")))
    laid, targets = alike(edges, x, targets, n_features)
    model, adam = Convolutions(n_features, dim, n_folds), Adam(rate)
    best = [(-1.0, 0, 0.0)] * n_folds  # validation, step, test
    for step in range(1, steps + 1):
        _, gradient = _loss_and_gradient(model, laid, targets)
        model.theta = adam.moved(model.theta, gradient)
        if step % every and step < steps:
            continue
        right = _judged(model, laid).join(targets, "graph").select("fold", "n", F.transform("p", lambda p: ((p > 0.5).cast("double") == F.col("y")).cast("double")).alias("right"))
        got = {r.fold: r.right for r in right.groupBy("fold").agg(F.array(*[F.sum(F.get("right", F.lit(f)) * F.col("n")) / F.sum("n") for f in range(n_folds)]).alias("right")).collect()}
        for f in range(n_folds):
            judged = got.get((f + 1) % n_folds, [0.0] * n_folds)[f]
            if judged > best[f][0]:
                best[f] = (judged, step, got.get(f, [0.0] * n_folds)[f])
    rows = [(f, step, float(v), float(t)) for f, (v, step, t) in enumerate(best)]
    return edges.sparkSession.createDataFrame(rows, "fold int, step int, validation double, accuracy double")
