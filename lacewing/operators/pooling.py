"""Edge-contraction coarsening: edge scores, matching, merge trees, spotlights and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_uniform
from ..functions.lineage import cut
from .graphs import adjacency, nodes_of


#: Edges of a graph from which it is matched in rounds, over many tasks.
LARGE = 100_000


def edge_weight(level: int = 0) -> Column:
    """A score in (0, 1) that graph, level and edge determine; stands in for a trained one."""
    return md5_uniform(F.concat_ws("|", F.lit(level), F.col("graph_id"), "src", "dst"))


def edge_softmax(scored: DataFrame, by: list[str]) -> DataFrame:
    """Adds p: softmax of ``s`` over the edges of a group (a graph, or a graph's target node)."""
    top = scored.groupBy(*by).agg(F.max("s").alias("_m"))
    e = scored.join(top, by).withColumn("_e", F.exp(F.col("s") - F.col("_m")))
    total = e.groupBy(*by).agg(F.sum("_e").alias("_z"))
    return e.join(total, by).withColumn("p", F.col("_e") / F.col("_z")).drop("_m", "_e", "_z")


EDGE_SCORE = {
    "sigmoid": lambda s: 1 / (1 + F.exp(-s)),
    "tanh": lambda s: F.tanh(s),
    "dummy": lambda s: F.lit(0.5),
}


def merge_features(kind: str, a: Column, b: Column) -> Column:
    """Features of a merged pair: the sum, or both in a row; a node by itself merges with itself."""
    return F.concat(a, b) if kind == "cat" else F.zip_with(a, b, lambda x, y: x + y)


def linear(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    rows = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) + F.lit(c) for w, c in zip(weights, bias, strict=True)]
    return F.array(*rows)


def greedy_matching(scored: DataFrame, stochastic: bool = False, seed: int = 0) -> DataFrame:
    """graph_id, src, dst, s of a maximal matching that takes edges by descending score.

    Ties go by src, then dst. A graph of fewer than LARGE edges passes a task in
    that order; the task remembers the nodes that the graph at hand has used.
    Larger graphs are matched in rounds. ``stochastic`` first skips an edge when
    a hash-drawn number exceeds its score.
    """
    left = scored.select("graph_id", "src", "dst", "s")
    if stochastic:
        left = left.filter(md5_uniform(F.concat_ws("|", F.lit(seed), "graph_id", "src", "dst")) <= F.col("s"))
    left = cut(left)
    large = cut(left.groupBy("graph_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LARGE).select("graph_id"))
    if not large.limit(1).count():
        return cut(_in_order(left))
    return _in_order(left.join(large, "graph_id", "left_anti").select(*left.columns)).union(_in_rounds(left.join(large, "graph_id", "left_semi").select(*left.columns)))


def _in_order(scored: DataFrame) -> DataFrame:
    """The greedy matching, each graph in one task."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, used = None, set()
        for b in batches:
            own = []
            for g, u, v in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if g != graph:
                    graph, used = g, set()
                free = u not in used and v not in used
                if free:
                    used.update((u, v))
                own.append(free)
            yield b.filter(pa.array(own, pa.bool_()))

    return scored.repartition("graph_id").sortWithinPartitions("graph_id", -F.col("s"), "src", "dst").mapInArrow(take, scored.schema)


def _in_rounds(scored: DataFrame) -> DataFrame:
    """The same over many tasks: each round takes every edge that beats all edges touching it and drops what touches it."""
    left, taken = cut(scored), None
    key = F.struct((-F.col("s")).alias("s"), "src", "dst")
    while left.limit(1).count():
        ends = left.select("graph_id", F.explode(F.array("src", "dst")).alias("v"), key.alias("k"))
        best = ends.groupBy("graph_id", "v").agg(F.min("k").alias("k"))
        won = left.withColumn("k", key)
        for end in ("src", "dst"):
            won = won.join(best.select("graph_id", F.col("v").alias(end), "k"), ["graph_id", end, "k"], "left_semi")
        won = cut(won.select("graph_id", "src", "dst", "s"))
        used = won.select("graph_id", F.explode(F.array("src", "dst")).alias("v"))
        for end in ("src", "dst"):
            left = left.join(used.withColumnRenamed("v", end), ["graph_id", end], "left_anti")
        left = cut(left.select("graph_id", "src", "dst", "s"))
        taken = won if taken is None else taken.union(won)
    return scored.select("graph_id", "src", "dst", "s").limit(0) if taken is None else taken


def clusters(nodes: DataFrame, matching: DataFrame) -> DataFrame:
    """graph_id, node, cluster, score: matched nodes share their first node's name; others stay, with score 1."""
    a = matching.select("graph_id", F.explode(F.array("src", "dst")).alias("node"), F.col("src").alias("cluster"), "s")
    return nodes.join(a, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("s", F.lit(1.0)).alias("score"))


def coarsen(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """Edges between different clusters, once."""
    c = cluster.select("graph_id", "node", "cluster")
    a, b = c.toDF("graph_id", "src", "a"), c.toDF("graph_id", "dst", "b")
    both = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).filter("a <> b")
    return both.select("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def unpool(values: DataFrame, cluster: DataFrame) -> DataFrame:
    """graph_id, node, x: each node gets its cluster's value."""
    return cluster.select("graph_id", "node", "cluster").join(values, ["graph_id", "cluster"]).select("graph_id", "node", "x")


def next_spotlights(spot: DataFrame, cluster: DataFrame) -> DataFrame:
    """graph_id, node, base of the next level: the union of what the merged nodes cover."""
    c = cluster.select("graph_id", "node", "cluster")
    return spot.join(c, ["graph_id", "node"]).select("graph_id", F.col("cluster").alias("node"), "base").distinct()


def expand_spotlights(spot: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's spotlight with those of its neighbours."""
    adj = adjacency(edges)
    near = adj.join(spot.withColumnRenamed("node", "b"), ["graph_id", "b"]).select("graph_id", F.col("a").alias("node"), "base")
    return spot.union(near).distinct()


def sigma_step(sigma: DataFrame, cluster: DataFrame) -> DataFrame:
    """graph_id, node, sigma of the next level: the merge's own score and its children's totals.

    A node that stayed alone passes its total on.
    """
    c = sigma.join(cluster, ["graph_id", "node"]).groupBy("graph_id", "cluster").agg(F.count("*").alias("m"), F.sum("sigma").alias("below"), F.max("score").alias("own"))
    return c.select("graph_id", F.col("cluster").alias("node"), (F.col("below") + F.when(F.col("m") > 1, F.col("own")).otherwise(0.0)).alias("sigma"))


def pool(edges: DataFrame, levels: int, nodes: DataFrame | None = None, trained=None, stochastic: bool = False, seed: int = 0) -> list[dict[str, DataFrame]]:
    """Levels of coarsening: edges, cluster, spot, sigma; stops when a level has no edges left.

    Scores are those of ``edge_weight``, or of ``trained`` (``training.TrainedScores``).
    """
    nodes = nodes_of(edges) if nodes is None else nodes
    spot = nodes.select("graph_id", "node", F.col("node").alias("base"))
    sigma = nodes.select("graph_id", "node", F.lit(0.0).alias("sigma"))
    out = []
    for level in range(levels):
        scored = edges.withColumn("s", edge_weight(level)) if trained is None else trained.scores(level, edges)
        matching = greedy_matching(scored, stochastic, seed * 31 + level)
        cluster = cut(clusters(nodes, matching))
        if trained is not None:
            trained.contracted(level, matching, cluster)
        edges = cut(coarsen(edges, cluster))
        spot, sigma = cut(next_spotlights(spot, cluster)), cut(sigma_step(sigma, cluster))
        nodes = cluster.select("graph_id", F.col("cluster").alias("node")).distinct()
        out.append({"edges": edges, "cluster": cluster, "spot": spot, "sigma": sigma})
        if not edges.limit(1).count():
            break
    return out


def merge_tree(levels: list[dict[str, DataFrame]]) -> DataFrame:
    """graph_id, level, node, parent: each node of each level with the node of the next that it became part of; the top has no parent."""
    out = None
    for t, level in enumerate(levels):
        own = level["cluster"].select("graph_id", F.lit(t).alias("level"), "node", F.col("cluster").alias("parent"))
        out = own if out is None else out.unionByName(own)
    top = levels[-1]["cluster"].select("graph_id", F.lit(len(levels)).alias("level"), F.col("cluster").alias("node")).distinct()
    return out.unionByName(top.withColumn("parent", F.lit(None).cast(top.schema["node"].dataType)))


def ancestors(tree: DataFrame, depth: int) -> DataFrame:
    """graph_id, level, node, top: each node's ancestor at the last level; pointers double in length each round."""
    up = tree.select("graph_id", "level", "node", F.when(F.col("parent").isNull(), F.col("level")).otherwise(F.col("level") + 1).alias("above"), F.coalesce("parent", "node").alias("top"))
    reach = 1
    while reach < depth:
        up = cut(up)
        further = up.select("graph_id", F.col("level").alias("above"), F.col("node").alias("top"), F.col("above").alias("_a"), F.col("top").alias("_t"))
        up = up.join(further, ["graph_id", "above", "top"]).select("graph_id", "level", "node", F.col("_a").alias("above"), F.col("_t").alias("top"))
        reach *= 2
    return up.select("graph_id", "level", "node", "top")


def hierarchy(edges: DataFrame, levels: list[dict[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(graph_id, top, level, node; graph_id, top, level, source, target, merge): the tree below each top node, with the edges of each level inside it.

    A merge link goes from a node to one of the level below, at ``level``; the
    others lie in one level.
    """
    tree = cut(merge_tree(levels))
    under = cut(ancestors(tree, len(levels)))
    merges = under.filter(F.col("level") < len(levels)).join(tree, ["graph_id", "level", "node"])
    links = merges.select("graph_id", "top", "level", F.col("parent").alias("source"), F.col("node").alias("target"), F.lit(True).alias("merge"))
    for t, own in enumerate([edges, *[level["edges"] for level in levels[:-1]]]):
        here = under.filter(F.col("level") == t).select("graph_id", "node", "top")
        a, b = here.toDF("graph_id", "src", "top"), here.toDF("graph_id", "dst", "top")
        inner = own.select("graph_id", "src", "dst").join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst", "top"])
        links = links.unionByName(inner.select("graph_id", "top", F.lit(t).alias("level"), F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(False).alias("merge")))
    return under.select("graph_id", "top", "level", "node"), links


def hierarchy_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """graph_id, top, json: each top node's tree as nodes and links, both ordered; a node is named level:node."""
    named = lambda level, node: F.concat_ws(":", level, node)
    n = nodes.select("graph_id", "top", F.struct("level", named(F.col("level"), F.col("node")).alias("id")).alias("x"))
    n = n.groupBy("graph_id", "top").agg(F.sort_array(F.collect_list("x")).alias("n"))
    source = named(F.col("level") + F.col("merge").cast("int"), F.col("source"))
    e = links.select("graph_id", "top", F.struct("merge", source.alias("source"), named(F.col("level"), F.col("target")).alias("target")).alias("x"))
    e = e.groupBy("graph_id", "top").agg(F.sort_array(F.collect_list("x")).alias("e"))
    both = n.join(e, ["graph_id", "top"], "left")
    id_and_level = F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["level"].alias("level")))
    ends = F.transform(F.coalesce("e", F.array().cast("array<struct<merge:boolean,source:string,target:string>>")), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["merge"].alias("merge")))
    return both.select("graph_id", "top", F.to_json(F.struct(id_and_level.alias("nodes"), ends.alias("links"))).alias("json"))


def filter_sigma(sigma: DataFrame, k: int, best: bool = True) -> DataFrame:
    """The k merged nodes of each graph with the largest (or smallest) totals."""
    order = F.desc("sigma") if best else F.asc("sigma")
    return sigma.withColumn("rn", F.row_number().over(Window.partitionBy("graph_id").orderBy(order, "node"))).filter(F.col("rn") <= k).drop("rn")


def filter_random(sigma: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k merged nodes of each graph, chosen by a hash of seed, graph and node."""
    order = F.md5(F.concat_ws("|", F.lit(seed), "graph_id", "node"))
    return sigma.withColumn("rn", F.row_number().over(Window.partitionBy("graph_id").orderBy(order, "node"))).filter(F.col("rn") <= k).drop("rn")


def pair_subgraphs(pairs: DataFrame, spot: DataFrame, edges: DataFrame, features: DataFrame, hops: int = 0) -> tuple[DataFrame, DataFrame]:
    """(graph_id, u, v, src, dst; graph_id, u, v, feats): the subgraph that each pair's two spotlights induce, and its nodes' features.

    ``pairs`` has graph_id, u, v; equal ones stand for a node's own spotlight.
    ``features`` has graph_id, node, x; feats lists node and x in node order.
    With ``hops`` the base nodes' neighbours are taken in too.
    """
    own = pairs.select("graph_id", "u", "v", F.explode(F.array("u", "v")).alias("node")).join(spot, ["graph_id", "node"]).select("graph_id", "u", "v", "base").distinct()
    adj = adjacency(edges)
    for _ in range(hops):
        near = own.join(adj.withColumnRenamed("a", "base"), ["graph_id", "base"]).select("graph_id", "u", "v", F.col("b").alias("base"))
        own = own.union(near).distinct()
    keys = ["graph_id", "u", "v"]
    inside = own.withColumnRenamed("base", "src").join(edges.select("graph_id", "src", "dst"), ["graph_id", "src"]).join(own.withColumnRenamed("base", "dst"), [*keys, "dst"], "left_semi")
    feats = own.withColumnRenamed("base", "node").join(features, ["graph_id", "node"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node", "x"))).alias("feats"))
    return inside.select(*keys, "src", "dst"), feats


def pair_tree_nodes(cluster: DataFrame) -> DataFrame:
    """Clusters with exactly two children."""
    return cluster.groupBy("graph_id", "cluster").agg(F.count("*").alias("m")).filter("m = 2").select("graph_id", F.col("cluster").alias("node"))


def degree_histograms(spot: DataFrame, edges: DataFrame, width: int = 32) -> DataFrame:
    """graph_id, node, hist: how many base nodes of a spotlight have each degree inside it."""
    s = spot.select("graph_id", "node", "base")
    adj = adjacency(edges)
    inside = s.join(adj.withColumnRenamed("a", "base"), ["graph_id", "base"]).join(s.withColumnRenamed("base", "b"), ["graph_id", "node", "b"], "left_semi")
    deg = inside.groupBy("graph_id", "node", "base").agg(F.count("*").alias("d"))
    deg = s.join(deg, ["graph_id", "node", "base"], "left").select("graph_id", "node", F.coalesce("d", F.lit(0)).alias("d"))
    counts = deg.groupBy("graph_id", "node").agg(F.collect_list("d").alias("ds"))
    return counts.select("graph_id", "node", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.size(F.filter("ds", lambda x: x == k))).alias("hist"))


def decode(level: dict[str, DataFrame], edges: DataFrame, code: Column, planes_width: int = 32) -> DataFrame:
    """graph_id, node, motif, sigma, spotlight of each base node.

    A spotlight's bucket is ``code`` over its degree histogram ``hist``; motifs
    are the buckets numbered from 1 in order. Graphs that ended before the level
    keep the nodes they had.
    """
    hist = degree_histograms(level["spot"], edges, planes_width).withColumn("code", code)
    codes = hist.select("code").distinct().withColumn("motif", F.dense_rank().over(Window.orderBy("code")))  # a row a bucket
    found = hist.join(codes, "code").join(level["sigma"], ["graph_id", "node"]).select("graph_id", F.col("node").alias("spotlight"), "motif", "sigma")
    return level["spot"].select("graph_id", F.col("node").alias("spotlight"), F.col("base").alias("node")).join(found, ["graph_id", "spotlight"])


def neighbour_mean(values: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node, x: a node's own value averaged with its neighbours'; one round of message passing."""
    near = adjacency(edges).join(values.withColumnRenamed("node", "b"), ["graph_id", "b"]).select("graph_id", F.col("a").alias("node"), "x")
    return values.select("graph_id", "node", "x").unionByName(near).groupBy("graph_id", "node").agg(F.avg("x").alias("x"))


POOL = {"sum": F.sum, "mean": F.avg, "max": F.max}


def global_pool(values: DataFrame, kind: str) -> DataFrame:
    return values.groupBy("graph_id").agg(POOL[kind]("x").alias("x"))
