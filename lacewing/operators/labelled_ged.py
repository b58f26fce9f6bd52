"""Edit distance of labelled graphs with costs of the caller's choice, within a budget of search states."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ged import assignment


@dataclass(frozen=True)
class Costs:
    """What each edit costs; a node's substitution is free where labels agree."""

    node_substitution: float = 1.0
    node_insertion: float = 1.0
    node_deletion: float = 1.0
    edge_insertion: float = 1.0
    edge_deletion: float = 1.0

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if not value >= 0 or value == float("inf"):
                raise ValueError(f"{f.name} is {value}: costs are finite and not negative")


def label_mismatch(a: list, b: list) -> np.ndarray:
    """0 where labels agree, 1 elsewhere."""
    return np.array([[float(x != y) for y in b] for x in a]).reshape(len(a), len(b))


def mismatches(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, u, v, cost: the substitution matrix of each pair of graphs, from nodes (graph_id, node, label)."""
    left, right = nodes.toDF("a", "u", "x"), nodes.toDF("b", "v", "y")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "u", "v", (~F.col("x").eqNullSafe(F.col("y"))).cast("double").alias("cost"))


def node_matrix(substitution: np.ndarray, deletion: np.ndarray, insertion: np.ndarray) -> np.ndarray:
    """The square assignment matrix: each node meets one of the other graph, its own deletion or insertion, or nothing."""
    n, m = substitution.shape
    out = np.zeros((n + m, n + m))
    out[:n, :m] = substitution
    out[:n, m:] = np.where(np.eye(n, dtype=bool), deletion[:, None], 1e9)
    out[n:, :m] = np.where(np.eye(m, dtype=bool), insertion[None, :], 1e9)
    return out


def normalised(mapping: list[int], n: int, m: int) -> tuple[list[int | None], list[int | None]]:
    """Each node's partner in the other graph, or None, both ways round."""
    forward: list[int | None] = [j if 0 <= j < m else None for j in mapping[:n]]
    back: list[int | None] = [None] * m
    for i, j in enumerate(forward):
        if j is not None:
            back[j] = i
    return forward, back


def cost_of(a: np.ndarray, b: np.ndarray, sub: np.ndarray, mapping: list[int], costs: Costs) -> float:
    """The cost of the edits that a node mapping of two undirected graphs stands for; -1 deletes."""
    n, m = len(a), len(b)
    forward, back = normalised(mapping, n, m)
    total = costs.node_deletion * forward.count(None) + costs.node_insertion * back.count(None)
    total += costs.node_substitution * sum(sub[i, j] for i, j in enumerate(forward) if j is not None)
    for i, k in itertools.combinations(range(n), 2):
        kept = forward[i] is not None and forward[k] is not None and b[forward[i], forward[k]]
        total += costs.edge_deletion * bool(a[i, k] and not kept)
    for i, k in itertools.combinations(range(m), 2):
        kept = back[i] is not None and back[k] is not None and a[back[i], back[k]]
        total += costs.edge_insertion * bool(b[i, k] and not kept)
    return float(total)


def upper_bound(a: np.ndarray, b: np.ndarray, sub: np.ndarray, costs: Costs) -> tuple[float, list[int]]:
    """(cost, mapping) of one assignment of nodes, each with half of the edits that its own edges need at least."""
    n, m = len(a), len(b)
    if not n or not m:
        return cost_of(a, b, sub, [-1] * n, costs), [-1] * n
    da, db = a.sum(1).astype(float), b.sum(1).astype(float)
    more = db[None, :] - da[:, None]
    context = np.where(more > 0, more * costs.edge_insertion, -more * costs.edge_deletion) / 2
    matrix = node_matrix(costs.node_substitution * sub + context, costs.node_deletion + da * costs.edge_deletion / 2, costs.node_insertion + db * costs.edge_insertion / 2)
    got, _ = assignment(matrix)
    mapping = [int(j) if j < m else -1 for j in got[:n]]
    return cost_of(a, b, sub, mapping, costs), mapping


def distance(a: np.ndarray, b: np.ndarray, labels_a: list, labels_b: list, costs: Costs | None = None, budget: int = 20_000) -> tuple[float, bool, list[int]]:
    """(distance, exact, mapping): best-first search over node mappings, or the upper bound where more than ``budget`` states would be opened.

    What is left of both graphs costs at least the cheapest assignment of its
    nodes and the difference of its numbers of edges.
    """
    costs = costs or Costs()
    a, b = np.asarray(a, bool), np.asarray(b, bool)
    n, m, sub = len(a), len(b), label_mismatch(labels_a, labels_b)
    bound, best = upper_bound(a, b, sub, costs)
    order = sorted(range(n), key=lambda i: -int(a[i].sum()))

    def rest(mapping: tuple[int, ...]) -> float:
        left = order[len(mapping) :]
        free = [j for j in range(m) if j not in mapping]
        nodes = 0.0
        if left and free:
            matrix = node_matrix(costs.node_substitution * sub[np.ix_(left, free)], np.full(len(left), costs.node_deletion), np.full(len(free), costs.node_insertion))
            nodes = float(assignment(matrix)[1])
        else:
            nodes = len(left) * costs.node_deletion + len(free) * costs.node_insertion
        more = int(b[np.ix_(free, free)].sum()) // 2 - int(a[np.ix_(left, left)].sum()) // 2
        return nodes + (more * costs.edge_insertion if more > 0 else -more * costs.edge_deletion)

    def step(mapping: tuple[int, ...], j: int) -> float:
        i = order[len(mapping)]
        cost = costs.node_deletion if j < 0 else costs.node_substitution * sub[i, j]
        for k, t in zip(order, mapping, strict=False):
            here, there = bool(a[i, k]), j >= 0 and t >= 0 and bool(b[j, t])
            cost += costs.edge_deletion * (here and not there) + costs.edge_insertion * (there and not here)
        return cost

    def full(mapping: tuple[int, ...]) -> list[int]:
        out = [-1] * n
        for i, j in zip(order, mapping, strict=True):
            out[i] = j
        return out

    count, opened = itertools.count(), 0
    heap = [(rest(()), 0, next(count), 0.0, ())]
    while heap:
        total, _, _, cost, mapping = heapq.heappop(heap)
        if total >= bound - 1e-12:
            break
        opened += 1
        if opened > budget:
            return bound, False, best
        if len(mapping) == n:
            own = cost_of(a, b, sub, full(mapping), costs)  # what is left of b is inserted
            if own < bound:
                bound, best = own, full(mapping)
            continue
        for j in [*(j for j in range(m) if j not in mapping), -1]:
            new, c = (*mapping, j), cost + step(mapping, j)
            if (low := c + rest(new)) < bound:
                heapq.heappush(heap, (low, -len(new), next(count), c, new))
    return bound, True, best


def pair_distances(pairs: DataFrame, costs: Costs | None = None, budget: int = 20_000) -> DataFrame:
    """a, b, ged, exact of pairs of graphs, given as a, n_a, edges_a, labels_a and the same for b; edges join places in the label lists."""

    def matrix(n: int, edges: list) -> np.ndarray:
        out = np.zeros((n, n), bool)
        for x, y in edges:
            out[x, y] = out[y, x] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            got = [distance(matrix(len(r["labels_a"]), r["edges_a"]), matrix(len(r["labels_b"]), r["edges_b"]), r["labels_a"], r["labels_b"], costs, budget) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["a"] for r in rows], pa.int64()), pa.array([r["b"] for r in rows], pa.int64()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.bool_())],
                names=["a", "b", "ged", "exact"],
            )

    return pairs.select("a", "b", "edges_a", "labels_a", "edges_b", "labels_b").mapInArrow(run, "a long, b long, ged double, exact boolean")
