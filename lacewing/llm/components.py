"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_unique
from .store import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of it and its neighbours.

    Edges are (a, b) with a > b, so the node is b, and only the smaller
    neighbours of b matter. A node with very many larger ones is a heavy key.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    return join_unique(edges, least, ["b"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = join_unique(edges, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Is every node tied to one smaller node at most, and no node above and below others?"""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.filter("below > 1 or (below = 1 and above = 1)").isEmpty()


def connected_components(edges: DataFrame, workspace: Workspace, tag: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b); root is the component's smallest node.

    Rounds end when the edge list is a set of stars, which then stand around their
    components' smallest nodes, after a number logarithmic in the longest path. Each step is written to the
    shared folder, so lost executors never cause earlier ones to run again, and a
    hub's rows never meet in one task.
    """
    edges = workspace.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    step = 0
    while not _are_stars(edges):
        step += 1
        names = f"{tag}-{step}l", f"{tag}-{step}"
        large = workspace.keep(_large_star(edges), names[0])
        edges = workspace.keep(_small_star(large), names[1])
        workspace.drop(names[0], f"{tag}-{step - 1}")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
