"""Training of the edge scorer: a gradient step is a set of joins, its sum a Spark aggregation.

A level maps a pair of merged node features to a vector m (a linear map) and a
score s (a sigmoid of another). Matched edges and nodes that stay alone give the
next level's features. Two losses train it: the reconstruction loss holds the
cosine of a batch's first edges at each level against the transport kernel of
the subgraphs that those edges cover; the frequency loss raises the scores of
edges that are dense among the positive graphs' and sparse among the others'.

A coarsening (matchings, densities, kernels) is laid down once per epoch. A step
then goes up the levels by two joins each, and down again: each row passes its
gradient to its two ends, where Spark adds them up. Partial gradients of the
parameters leave each task as one row. Only vectors of the size of the
parameters and of the losses reach the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from . import pooling, subgraphs, vectors
from .results import StopController

#: Edges of a batch and level whose vectors are held against the kernel.
FIRST = 20
#: Rounds of labels that the kernel compares.
KERNEL_ROUNDS = 4


@dataclass
class Scorer:
    """Parameters of all levels: W (dim x inputs), b, v and c of each, one after the other in ``theta``."""

    n_features: int
    dim: int
    steps: int
    merge: str = "sum"
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        if not len(self.theta):
            self.theta = self.initial(0)

    def inputs(self, level: int) -> int:
        return (self.n_features if level == 0 else self.dim) * (2 if self.merge == "cat" else 1)

    def size(self, level: int) -> int:
        return self.dim * (self.inputs(level) + 2) + 1

    def initial(self, seed: int) -> np.ndarray:
        """Uniform within 1 / sqrt(inputs) of each linear map."""
        rng, parts = np.random.default_rng(seed), []
        for level in range(self.steps + 1):
            a, b = 1 / math.sqrt(self.inputs(level)), 1 / math.sqrt(self.dim)
            first = self.dim * (self.inputs(level) + 1)
            parts += [rng.uniform(-a, a, first), rng.uniform(-b, b, self.dim + 1)]
        return np.concatenate(parts)

    def start(self, level: int) -> int:
        return sum(self.size(i) for i in range(level))

    def layer(self, level: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(W, b, v, c) of a level, read from ``theta`` or from a vector like it."""
        x = (self.theta if of is None else of)[self.start(level) : self.start(level) + self.size(level)]
        n = self.dim * self.inputs(level)
        return x[:n].reshape(self.dim, -1), x[n : n + self.dim], x[n + self.dim : -1], float(x[-1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


_VECTOR = T.ArrayType(T.DoubleType())


def merged(rows: DataFrame, x: DataFrame, scorer: Scorer, level: int) -> DataFrame:
    """``rows`` (graph_id, src, dst and others) with xin, the merged features of both ends, m and s."""
    a, b = x.select("graph_id", F.col("node").alias("src"), F.col("x").alias("_a")), x.select("graph_id", F.col("node").alias("dst"), F.col("x").alias("_b"))
    both = rows.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).select(*rows.columns, pooling.merge_features(scorer.merge, F.col("_a"), F.col("_b")).alias("xin"))
    w, bias, v, c = scorer.layer(level)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(batch.num_columns - 1)) @ w.T + bias
                s = 1 / (1 + np.exp(-(m @ v + c)))
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(m), pa.array(s)], names=[*batch.schema.names, "m", "s"])

    return both.mapInArrow(score, T.StructType([*both.schema.fields, T.StructField("m", _VECTOR), T.StructField("s", T.DoubleType())]))


class TrainedScores:
    """Scores for ``pooling.pool``: of the merged features of an edge's ends, which travel up with the clusters.

    ``rows`` keeps each level's edges and nodes that stay alone (src = dst, not
    ``edge``): graph_id, src, dst, edge, and the cluster that they become; null
    for an edge that isn't contracted.
    """

    def __init__(self, scorer: Scorer, x: DataFrame):
        self.scorer, self.x, self.rows = scorer, x, []

    def scores(self, level: int, edges: DataFrame) -> DataFrame:
        self.scored = cut(merged(edges.select("graph_id", "src", "dst"), self.x, self.scorer, level))
        return self.scored.select("graph_id", "src", "dst", "s")

    def contracted(self, level: int, matching: DataFrame, cluster: DataFrame) -> None:
        taken = matching.select("graph_id", "src", "dst", F.col("src").alias("cluster"))
        edges = self.scored.join(taken, ["graph_id", "src", "dst"], "left").withColumn("edge", F.lit(True))
        alone = cluster.select("graph_id", "node", "cluster").join(taken, ["graph_id", "cluster"], "left_anti")
        alone = alone.select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"), "cluster", F.lit(False).alias("edge"))
        rows = cut(edges.unionByName(merged(alone, self.x, self.scorer, level)))
        self.rows.append(rows)
        self.x = rows.filter("cluster is not null").select("graph_id", F.col("cluster").alias("node"), F.col("m").alias("x"))


@dataclass
class Coarsening:
    """What a step holds fixed: each level's rows with weights, places among the batch's first edges, and their kernels."""

    rows: list[DataFrame]  # graph_id, src, dst, edge, cluster, weight, batch, place
    kernels: list[DataFrame]  # batch, kernel: (p, q, k) of its first edges
    edges: list[int]
    batches: list[int]


def _kernels(firsts: DataFrame, spot: DataFrame, edges: DataFrame) -> DataFrame:
    """batch, kernel: the transport kernel of each two of a batch's first edges, over the subgraphs that they cover, labelled by degree.

    Edges without a common label aren't listed.
    """
    own = firsts.select("graph_id", "batch", "place", F.explode(F.array("src", "dst")).alias("node")).distinct()
    sets = own.join(spot, ["graph_id", "node"]).groupBy("graph_id", "batch", "place").agg(F.array_sort(F.collect_set("base")).alias("nodes"))
    labelled = subgraphs.wl_labels(subgraphs.induced(sets.select("graph_id", "nodes").distinct(), edges), None, KERNEL_ROUNDS)
    named = sets.join(labelled, ["graph_id", "nodes"]).select("batch", F.col("place").alias("id"), "rounds")
    pairs = vectors.wwl_kernel(cut(named), within=("batch",)).filter("i < j")
    return pairs.groupBy("batch").agg(F.collect_list(F.struct(F.col("i").alias("p"), F.col("j").alias("q"), F.col("kernel").alias("k"))).alias("kernel"))


def _weights(own: DataFrame, other: DataFrame | None, k: int, beta: float) -> DataFrame:
    """graph_id, src, dst, weight: exp(-beta * (distance to the k-th nearest among own less that among others))."""
    keyed = lambda df: df.filter("edge").select("graph_id", "src", "dst", F.xxhash64("graph_id", "src", "dst").alias("id"), F.col("m").alias("z"))
    a = cut(keyed(own))
    near = lambda refs: vectors.distance_stats(a.select("id", "z"), refs.select("id", "z"), k, None).select("id", "kth")
    found = near(a).withColumnRenamed("kth", "f_pos")
    if other is None or not keyed(other).limit(1).count():
        found = found.withColumn("f_neg", F.lit(0.0))
    else:
        found = found.join(near(cut(keyed(other))).withColumnRenamed("kth", "f_neg"), "id")
    return a.join(found, "id").select("graph_id", "src", "dst", F.exp(-F.lit(beta) * (F.col("f_pos") - F.col("f_neg"))).alias("weight"))


def coarsening(pos: DataFrame, neg: DataFrame, x_pos: DataFrame, x_neg: DataFrame, scorer: Scorer, batch_size: int = 16, k: int = 30, beta: float = 1.0, seed: int = 0, phase: str = "both") -> Coarsening:
    """Both collections coarsened with the scorer's present scores, drawn by ``seed``.

    ``pos`` and ``neg`` are edges (graph_id, src, dst), features have graph_id,
    node, x. A batch is about ``batch_size`` graphs, chosen by hash.
    """
    graphs = pos.select("graph_id").distinct()
    n = max(1, graphs.count() // batch_size)
    hook_pos, hook_neg = TrainedScores(scorer, x_pos), TrainedScores(scorer, x_neg)
    tops = pooling.pool(pos, scorer.steps + 1, trained=hook_pos, stochastic=True, seed=seed)
    if phase != "rec":
        pooling.pool(neg, scorer.steps + 1, trained=hook_neg, stochastic=True, seed=seed)
    out = Coarsening([], [], [], [])
    spots = [pos.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().select("graph_id", "node", F.col("node").alias("base")), *[t["spot"] for t in tops]]
    batch = F.pmod(F.xxhash64("graph_id"), F.lit(n)).cast("int")
    first = Window.partitionBy("batch").orderBy("graph_id", "src", "dst")
    for t, rows in enumerate(hook_pos.rows):
        firsts = rows.filter("edge").select("graph_id", "src", "dst", batch.alias("batch")).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= FIRST)
        firsts = cut(firsts)
        if phase != "rec":
            weights = _weights(rows, hook_neg.rows[t] if t < len(hook_neg.rows) else None, k, beta)
        else:
            weights = rows.filter("edge").select("graph_id", "src", "dst", F.lit(0.0).alias("weight"))
        plain = rows.select("graph_id", "src", "dst", "edge", "cluster")
        # a node that stays alone has src = dst and no partner in either table
        out.rows.append(cut(plain.join(weights, ["graph_id", "src", "dst"], "left").join(firsts, ["graph_id", "src", "dst"], "left")))
        out.kernels.append(cut(_kernels(firsts, spots[t], pos)) if phase != "mot" else None)
        out.edges.append(rows.filter("edge").count())
        out.batches.append(firsts.select("batch").distinct().count())
    return out


def _forward(laid: Coarsening, x: DataFrame, scorer: Scorer) -> list[DataFrame]:
    """Each level's rows with xin, m and s under the scorer's present parameters."""
    out = []
    for t, rows in enumerate(laid.rows):
        out.append(cut(merged(rows, x, scorer, t)))
        x = out[-1].filter("cluster is not null").select("graph_id", F.col("cluster").alias("node"), F.col("m").alias("x"))
    return out


def _cosine_gradient(m: np.ndarray, kernel: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """(scale * mean square of cosine less kernel over all pairs of rows, its gradient)."""
    size = np.maximum(np.sqrt((m**2).sum(1)), 1e-8)
    u = m / size[:, None]
    diff = u @ u.T - kernel
    loss = scale * float((diff**2).mean())
    g = 4 * scale / len(m) ** 2 * (diff @ u)
    return loss, (g - (g * u).sum(1, keepdims=True) * u) / size[:, None]


def _reconstruction(level: DataFrame, kernels: DataFrame, scale: float) -> DataFrame:
    """batch, place, loss, up: the loss of a batch, on its first row, and each first edge's gradient of it.

    A group holds FIRST rows at most.
    """
    groups = level.filter("place is not null").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("x")).join(kernels, "batch", "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, xs, pairs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places = [r["place"] for r in xs]
                at = {p: i for i, p in enumerate(places)}
                kernel = np.full((len(xs), len(xs)), math.exp(-1.0))
                np.fill_diagonal(kernel, 1.0)
                for r in pairs or []:
                    kernel[at[r["p"]], at[r["q"]]] = kernel[at[r["q"]], at[r["p"]]] = r["k"]
                loss, up = _cosine_gradient(np.array([r["m"] for r in xs]), kernel, scale)
                cells = [pa.array([batch] * len(xs), pa.int32()), pa.array(places, pa.int32()), pa.array([loss] + [0.0] * (len(xs) - 1)), _lists(up)]
                yield pa.RecordBatch.from_arrays(cells, names=["batch", "place", "loss", "up"])

    return groups.select("batch", "x", "kernel").mapInArrow(compare, "batch int, place int, loss double, up array<double>")


def _down(level: DataFrame, scorer: Scorer, t: int, share: float, lam: float) -> DataFrame:
    """The rows' gradients at both ends (graph_id, src, dst, a, b) and, in rows of their own, each task's gradient of the level's parameters and its loss (g)."""
    w, _, v, _ = scorer.layer(t)
    merge = scorer.merge
    columns = ["graph_id", "src", "dst", "xin", "m", "s", "weight", "above", "up"]
    fields = {f.name: f for f in level.schema.fields}
    schema = T.StructType([*[fields[c] for c in columns[:3]], T.StructField("a", _VECTOR), T.StructField("b", _VECTOR), T.StructField("g", _VECTOR)])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, names = None, 0.0, ["graph_id", "src", "dst", "a", "b", "g"]
        kinds = None
        for b in batches:
            kinds = [c.type for c in b.columns[:3]]
            if not b.num_rows:
                continue
            xin, m = _matrix(b.column(3)), _matrix(b.column(4))
            s = b.column(5).to_numpy(zero_copy_only=False)
            weight = b.column(6).to_numpy(zero_copy_only=False)  # NaN where there is no frequency loss
            has = ~np.isnan(weight)
            ds = np.where(has, share * (2 * lam * s - np.where(has, weight, 0.0)), 0.0)
            loss += float((share * (lam * s**2 - s * weight))[has].sum())
            dz = ds * s * (1 - s)
            dm = dz[:, None] * v
            for c in (7, 8):
                known = np.flatnonzero(b.column(c).is_valid().to_numpy(zero_copy_only=False))
                if len(known):
                    dm[known] += _matrix(b.column(c).take(pa.array(known)))
            g = np.concatenate([(dm.T @ xin).ravel(), dm.sum(0), (dz[:, None] * m).sum(0), [dz.sum()]])
            total = g if total is None else total + g
            dx = dm @ w
            ends = (dx[:, : dx.shape[1] // 2], dx[:, dx.shape[1] // 2 :]) if merge == "cat" else (dx, dx)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(_lists, map(np.ascontiguousarray, ends)), pa.nulls(b.num_rows, pa.list_(pa.float64()))], names=names)
        if total is not None:
            none = pa.nulls(1, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], none, none, _lists(np.append(total, loss)[None, :])], names=names)

    return level.select(*columns).mapInArrow(back, schema)


def _summed(rows: DataFrame, column: str, by: list[str], width: int) -> DataFrame:
    """by, column: the sum of arrays of ``width`` numbers; added up before rows move."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(width)]).alias(column))


def loss_and_gradient(laid: Coarsening, x: DataFrame, scorer: Scorer, phase: str, lam: float = 1.0, gradient: bool = True) -> tuple[float, np.ndarray]:
    """(loss, gradient) of a phase, ``rec`` or ``mot``, under a coarsening; the gradient is left at zero where it isn't asked for."""
    levels = _forward(laid, x, scorer)
    steps = max(1, scorer.steps)
    total, loss, above = np.zeros(len(scorer.theta)), 0.0, None
    for t in reversed(range(len(levels))):
        level = levels[t]
        if phase == "rec":
            back = cut(_reconstruction(level, laid.kernels[t], 1 / (steps * max(1, laid.batches[t]))))
            loss += back.agg(F.sum("loss")).first()[0] or 0.0
            level = level.join(back.drop("loss"), ["batch", "place"], "left").withColumn("weight", F.lit(None).cast("double"))
        else:
            level = level.withColumn("up", F.lit(None).cast(_VECTOR))
        level = level.withColumn("above", F.lit(None).cast(_VECTOR)) if above is None else level.join(above, ["graph_id", "cluster"], "left")
        if phase == "rec" and not gradient:
            continue
        down = cut(_down(level, scorer, t, 1 / (steps * max(1, laid.edges[t])), lam))
        # one row a task; their sum has the size of the level's parameters
        parts = down.filter("g is not null").select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g")).collect()
        g = np.zeros(scorer.size(t) + 1)
        for r in parts:
            g[r.i] = r.g
        total[scorer.start(t) : scorer.start(t) + scorer.size(t)] = g[:-1]
        loss += float(g[-1])
        if t:
            ends = down.filter("g is null").select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("cluster"), F.col("a").alias("above")), F.struct(F.col("dst").alias("cluster"), F.col("b").alias("above")))).alias("e")).select("graph_id", "e.*")
            above = _summed(ends, "above", ["graph_id", "cluster"], scorer.dim)
    return loss, total


@dataclass
class Adam:
    """Moment estimates of a vector of parameters."""

    rate: float = 1e-3
    step: int = 0
    first: np.ndarray | None = None
    second: np.ndarray | None = None

    def moved(self, theta: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.first = np.zeros_like(theta) if self.first is None else self.first
        self.second = np.zeros_like(theta) if self.second is None else self.second
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        return theta - self.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)


@dataclass
class Run:
    """A training run: reconstruction first, until it no longer improves, then frequency."""

    scorer: Scorer
    adam: Adam = field(default_factory=Adam)
    patience: int = 30
    epoch: int = 0
    history: list[tuple[int, str, float, float]] = field(default_factory=list)  # epoch, phase, training loss, held-out loss

    def phase(self) -> str | None:
        """The phase of the next epoch; None when both have stopped."""
        for name in ("rec", "mot"):
            stop = StopController(self.patience)
            if not any([stop.step(h[3]) for h in self.history if h[1] == name]):
                return name
        return None

    def save(self, path: str, spark: SparkSession) -> None:
        """The state after an epoch, beside those of earlier ones."""
        state = {
            "scorer": asdict(self.scorer) | {"theta": self.scorer.theta.tolist()},
            "adam": asdict(self.adam) | {k: None if v is None else v.tolist() for k, v in (("first", self.adam.first), ("second", self.adam.second))},
            "patience": self.patience, "epoch": self.epoch, "history": self.history,
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={self.epoch}")

    @staticmethod
    def load(path: str, spark: SparkSession) -> Run:
        """The latest saved state."""
        state = json.loads(spark.read.parquet(path).orderBy(F.desc("epoch")).first().state)
        array = lambda x: None if x is None else np.array(x)
        adam = state["adam"]
        return Run(
            Scorer(**{**state["scorer"], "theta": array(state["scorer"]["theta"])}),
            Adam(adam["rate"], adam["step"], array(adam["first"]), array(adam["second"])),
            state["patience"], state["epoch"], [tuple(h) for h in state["history"]],
        )


def train(run: Run, pos: DataFrame, neg: DataFrame, x_pos: DataFrame, x_neg: DataFrame, epochs: int, steps_an_epoch: int = 1, held: tuple[DataFrame, DataFrame] | None = None, path: str | None = None, seed: int = 0, **options) -> Run:
    """The run after epochs up to number ``epochs``; saved after each under ``path``.

    An epoch coarsens anew, drawn by seed and epoch, and takes steps_an_epoch
    full steps on it. ``held`` has edges and features of positive graphs whose
    loss decides when a phase stops; without it, the training loss does.
    Options are those of ``coarsening``, and ``lam``.
    """
    lam = options.pop("lam", 1.0)
    while run.epoch < epochs and (phase := run.phase()):
        draw = seed * 1_000_003 + run.epoch
        laid = coarsening(pos, neg, x_pos, x_neg, run.scorer, seed=draw, phase=phase, **options)
        losses = []
        for _ in range(steps_an_epoch):
            loss, gradient = loss_and_gradient(laid, x_pos, run.scorer, phase, lam)
            losses.append(loss)
            run.scorer.theta = run.adam.moved(run.scorer.theta, gradient)
        test = sum(losses) / len(losses)
        if held:
            out = coarsening(held[0], neg, held[1], x_neg, run.scorer, seed=draw, phase=phase, **options)
            test = loss_and_gradient(out, held[1], run.scorer, phase, lam, gradient=False)[0]
        run.history.append((run.epoch, phase, sum(losses) / len(losses), test))
        run.epoch += 1
        if path:
            run.save(path, pos.sparkSession)
    return run
