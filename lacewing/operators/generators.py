"""Synthetic graphs with planted motifs, null models and parameter grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_uniform
from ..functions.lineage import cut

SHAPES = ("star", "barbell", "wheel", "clique", "lollipop", "random")


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def motif_shape(spark: SparkSession, shape: str, size: int) -> DataFrame:
    """src < dst of a motif. Each shape is a condition on pairs of numbers.

    star has size + 1 nodes; barbell is two cliques of size // 2 with two nodes
    on the way between them; lollipop a clique of size // 2 with a tail of
    ``size`` nodes; wheel a hub in a cycle of size - 1.
    """
    n = {"star": size + 1, "barbell": 2 * (size // 2) + 2, "lollipop": size // 2 + size}.get(shape, size)
    h = size // 2
    ids = spark.range(n)
    pairs = ids.toDF("src").select("src", F.explode_outer(_upto(n)).alias("dst")).filter("src < dst")
    chain = F.col("dst") == F.col("src") + 1
    rule = {
        "star": F.col("src") == 0,
        "clique": F.lit(True),
        "wheel": (F.col("src") == 0) | ((F.col("src") > 0) & chain) | ((F.col("src") == 1) & (F.col("dst") == n - 1)),
        "barbell": (F.col("dst") < h) | (F.col("src") >= h + 2) | ((F.col("src") >= h - 1) & (F.col("dst") <= h + 2) & chain),
        "lollipop": (F.col("dst") < h) | ((F.col("src") >= h - 1) & chain),
        "random": chain | (md5_uniform(F.concat_ws("|", F.lit(size), "src", "dst")) < 0.3),
    }[shape]
    return pairs.filter(rule)


def _linked(ids: DataFrame, nodes: int, p: float, seed: int) -> DataFrame:
    """graph_id, src, dst: each pair of a graph's nodes with probability p, by a hash of seed, graph and pair."""
    pairs = ids.select("graph_id", F.explode(_upto(nodes)).alias("src")).select("graph_id", "src", F.explode(_upto(nodes)).alias("dst")).filter("src < dst")
    return pairs.filter(md5_uniform(F.concat_ws("|", F.lit(seed), "graph_id", "src", "dst")) < p)


def random_parents(spark: SparkSession, n_graphs: int, nodes: int, p: float, seed: int = 42) -> DataFrame:
    """graph_id, src, dst: each pair linked with probability p, by a hash of seed, graph and pair."""
    return _linked(spark.range(n_graphs).toDF("graph_id"), nodes, p, seed)


def accepted(edges: DataFrame, nodes: DataFrame, max_degree: int) -> DataFrame:
    """graph_id of the graphs that are connected over ``nodes`` and have degrees below the bound."""
    from .graphs import components, degrees

    whole = components(edges, nodes).groupBy("graph_id").agg(F.countDistinct("comp").alias("c")).filter("c = 1").select("graph_id")
    low = degrees(edges).groupBy("graph_id").agg(F.max("deg").alias("d")).filter(F.col("d") < max_degree)
    return whole.join(low, "graph_id", "left_semi")


#: Tries of a graph after which a collection counts as impossible.
TRIES = 1 << 14


def connected_parents(spark: SparkSession, n_graphs: int, nodes: int, p: float, seed: int = 42, max_degree: int = 25, ids: DataFrame | None = None) -> DataFrame:
    """graph_id, src, dst: of each graph's tries the first that is connected with degrees below the bound.

    ``ids`` names the graphs wanted of the n_graphs, where not all are.

    Graphs without one are tried again, twice as often each round, until none is
    missing; where TRIES don't bring a graph forth an error says so.
    """
    missing = spark.range(n_graphs).toDF("graph_id") if ids is None else ids.select("graph_id")
    found, begun, batch = None, 0, 8
    while missing.limit(1).count():
        if begun >= TRIES:
            raise ValueError(f"{missing.count()} of {n_graphs} graphs were not connected in {begun} tries: raise p or max_degree")
        tried = missing.select("graph_id", F.explode(F.sequence(F.lit(begun), F.lit(begun + batch - 1))).alias("k"))
        # a try's number stands for the graph while it is drawn
        tried = tried.select((F.col("graph_id") + F.col("k").cast("long") * F.lit(n_graphs)).alias("graph_id"))
        drawn = cut(_linked(tried, nodes, p, seed))
        every = tried.select("graph_id", F.explode(_upto(nodes)).alias("node"))
        own = F.pmod("graph_id", F.lit(n_graphs))
        good = accepted(drawn, every, max_degree).groupBy(own.alias("g")).agg(F.min("graph_id").alias("graph_id"))
        new = cut(drawn.join(good, "graph_id").select(F.col("g").alias("graph_id"), "src", "dst"))
        found = new if found is None else found.union(new)
        missing = cut(missing.join(new.select("graph_id").distinct(), "graph_id", "left_anti"))
        begun, batch = begun + batch, batch * 2
    return _linked(missing, nodes, p, seed) if found is None else found


FAMILIES = ("uniform", "preferential", "small_world")


def mixed_parents(spark: SparkSession, n_graphs: int, nodes: int, seed: int = 42) -> DataFrame:
    """graph_id, family, src, dst: connected graphs, each of a family and with parameters drawn for it.

    uniform: a random tree and further pairs, all as likely. preferential: each
    node ties itself to earlier ones, likelier to those with more ties.
    small_world: a ring with near neighbours, some ties moved.
    """

    def one(g: int) -> tuple[str, set[tuple[int, int]]]:
        rng = np.random.default_rng([seed, g])
        family = FAMILIES[int(rng.integers(len(FAMILIES)))]
        ties: set[tuple[int, int]] = set()
        tie = lambda a, b: ties.add((min(a, b), max(a, b))) if a != b else None
        if family == "uniform":
            p = rng.uniform(0.02, 0.2)
            for v in range(1, nodes):
                tie(v, int(rng.integers(v)))
                for u in np.flatnonzero(rng.random(v) < p).tolist():
                    tie(u, v)
        elif family == "preferential":
            each, ends = int(rng.integers(1, 4)), [0]
            for v in range(1, nodes):
                for u in {int(rng.choice(ends)) for _ in range(min(v, each))}:
                    tie(u, v)
                    ends += [u, v]
        else:
            reach, p = int(rng.integers(1, 3)), rng.uniform(0, 0.3)
            for v in range(nodes):
                tie(v, (v + 1) % nodes)  # the ring itself stays, so the graph is connected
                for k in range(2, reach + 1):
                    tie(v, int(rng.integers(nodes)) if rng.random() < p else (v + k) % nodes)
        return family, ties

    def run(batches):
        for pdf in batches:
            rows = [(g, f, a, b) for g in pdf["graph_id"].tolist() for f, ties in [one(g)] for a, b in sorted(ties)]
            yield pd.DataFrame(rows, columns=["graph_id", "family", "src", "dst"])

    return spark.range(n_graphs).toDF("graph_id").mapInPandas(run, "graph_id long, family string, src long, dst long")


def distort(edges: DataFrame, nodes: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Each pair of a motif's nodes flips between edge and no edge with probability p; below 0 nothing changes."""
    if p < 0:
        return edges.select("graph_id", "src", "dst")
    a, b = nodes.select("graph_id", F.col("node").alias("src")), nodes.select("graph_id", F.col("node").alias("dst"))
    pairs = a.join(b, "graph_id").filter("src < dst")
    state = pairs.join(edges.select("graph_id", "src", "dst", F.lit(1).alias("e")), ["graph_id", "src", "dst"], "left")
    flip = md5_uniform(F.concat_ws("|", F.lit(seed), "graph_id", "src", "dst")) < p
    return state.filter(F.col("e").isNotNull() != flip).select("graph_id", "src", "dst")


PLANTED = "graph_id long, role string, src long, dst long"


def plant(parents: DataFrame, motif: list[tuple[int, int]], n_motif: int, link_p: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(edges by role, truth): the motif takes the place of one node of each parent.

    The anchor is drawn by a generator seeded with seed and graph; its links are
    dealt to motif nodes, each kept with probability link_p and one at least.
    pos has the motif, neg is the parent. truth lists graph_id, node of pos.
    """
    size = n_motif

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        rng = np.random.default_rng([seed, g])
        nodes = sorted(set(pdf["src"]) | set(pdf["dst"]))
        anchor = int(rng.choice(nodes))
        base = max(nodes) + 1
        out = [(g, "neg", int(s), int(d)) for s, d in zip(pdf["src"], pdf["dst"], strict=True)]
        out += [(g, "pos", int(s), int(d)) for s, d in zip(pdf["src"], pdf["dst"], strict=True) if anchor not in (s, d)]
        out += [(g, "pos", base + a, base + b) for a, b in motif]
        ends = [int(d if s == anchor else s) for s, d in zip(pdf["src"], pdf["dst"], strict=True) if anchor in (s, d)]
        keep = rng.random(len(ends)) < link_p
        if len(ends) and not keep.any():
            keep[0] = True
        out += [(g, "pos", e, base + int(rng.integers(size))) for e, k in zip(ends, keep, strict=True) if k]
        return pd.DataFrame(out, columns=["graph_id", "role", "src", "dst"])

    edges = parents.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(run, PLANTED)
    base = parents.groupBy("graph_id").agg((F.max(F.greatest("src", "dst")) + 1).alias("base"))
    truth = base.select("graph_id", F.explode(F.sequence(F.col("base"), F.col("base") + size - 1)).alias("node"))
    return edges, truth


def swap_null(edges: DataFrame, swaps: int = 100, seed: int = 0, connected: bool = False) -> DataFrame:
    """Degree-preserving null model: double edge swaps within each graph.

    A swap that would make a loop or a double edge is refused, and, where
    ``connected``, one that would break the graph apart.
    """
    schema = edges.select("graph_id", "src", "dst").schema

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, abs(int(key[0]))])
        e = sorted(zip(pdf["src"], pdf["dst"], strict=True))
        have = {frozenset(x) for x in e}

        def whole(edges_now: list) -> bool:
            near: dict = {}
            for a, b in edges_now:
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
            seen, stack = set(), [next(iter(near))]
            while stack:
                v = stack.pop()
                if v not in seen:
                    seen.add(v)
                    stack += near[v]
            return len(seen) == len(near)

        for _ in range(swaps):
            if len(e) < 2:
                break
            i, j = (int(x) for x in rng.choice(len(e), 2, replace=False))
            (a, b), (c, d) = e[i], e[j] if rng.random() < 0.5 else e[j][::-1]
            new = frozenset((a, d)), frozenset((c, b))
            if len({a, b, c, d}) < 4 or new[0] in have or new[1] in have:
                continue
            old = e[i], e[j]
            e[i], e[j] = (a, d), (c, b)
            if connected and not whole(e):
                e[i], e[j] = old
                continue
            have -= {frozenset(old[0]), frozenset(old[1])}
            have |= set(new)
        rows = [(key[0], min(x), max(x)) for x in e]
        return pd.DataFrame(rows, columns=["graph_id", "src", "dst"])

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(run, schema)


def parameter_grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(axis)
    return out


def esu_sample(neighbours: dict, rng: np.random.Generator, p: float, k_min: int, k_max: int, budget: int) -> set[tuple]:
    """Connected sets found by extending from each root with larger nodes, each branch followed with probability p."""
    out: set[tuple] = set()

    def extend(sub: frozenset, ext: list, root) -> None:
        if k_min <= len(sub):
            out.add(tuple(sorted(sub)))
        if len(sub) == k_max or len(out) >= budget:
            return
        closed = sub | {u for v in sub for u in neighbours[v]}
        for i, w in enumerate(ext):
            if rng.random() <= p:
                extend(sub | {w}, ext[i + 1 :] + [u for u in neighbours[w] if u > root and u not in closed], root)

    for v in sorted(neighbours):
        extend(frozenset([v]), [u for u in neighbours[v] if u > v], v)
    return out


def esu_sampled(edges: DataFrame, k_min: int = 3, k_max: int = 4, target: int = 50, seed: int = 0) -> DataFrame:
    """graph_id, nodes: sampled connected sets of each graph, in up to five rounds of about ``target`` a size."""
    kind = dict(edges.dtypes)["src"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        near = {v: sorted(x) for v, x in near.items()}
        n, top = len(near), min(k_max, len(near) - 1)
        found: set[tuple] = set()
        if top >= k_min:
            mean = sum(map(len, near.values())) / n
            p = min(1.0, (target / max(1.0, n * max(mean, 1.0) ** 2 / 3)) ** 0.5)
            rng = np.random.default_rng([seed, abs(int(key[0]))])
            for _ in range(5):
                found |= esu_sample(near, rng, p, k_min, top, 100 * target)
                sizes = [sum(len(s) == k for s in found) for k in range(k_min, top + 1)]
                if p == 1.0 or min(sizes) >= target:
                    break
        return pd.DataFrame({"graph_id": [key[0]] * len(found), "nodes": pd.Series([list(s) for s in sorted(found)], dtype=object)})

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(run, f"graph_id long, nodes array<{kind}>")
