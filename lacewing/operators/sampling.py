"""Sampling of connected node sets within a budget, level by level.

Every set is reached along one path only. A path starts at the set's smallest
node; a node enters the list of candidates with the first path node that it is
tied to, and candidates are taken in the order (place of that path node, node).
So a candidate w may follow a path exactly if its place and itself come after
those of the path's last node. The rule needs no list of candidates, only the
place: a level is a join of path nodes with their neighbours and a minimum.

A branch lives if a hash of its path is below the graph's probability, and a
graph keeps at most its budget of each level, those with the smallest hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .graphs import adjacency, degrees
from .subgraphs import extension_probability

#: Sets a size that a graph should yield, paths of a level that it may keep, and tries of a graph whose branches are thinned.
TARGET, BUDGET, ROUNDS = 50, 5000, 5


def _uniform(*values: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11) / F.lit(float(1 << 53))


def extension_tree(edges: DataFrame, k_min: int, k_max: int, target: int = TARGET, budget: int = BUDGET, rounds: int = ROUNDS, seed: int = 0, p: float | None = None) -> DataFrame:
    """graph_id, round, nodes (ascending): connected sets of k_min to k_max nodes, never all of a graph's; each at most once a round.

    ``p`` is the chance of a branch; without it a graph's size and mean degree
    give it for about ``target`` sets. A graph with p = 1 has one round, in
    which it finds every set unless the budget is reached.
    """
    deg = degrees(edges)
    facts = deg.groupBy("graph_id").agg(F.count("*").alias("n"), F.avg("deg").alias("mean"))
    chance = F.lit(float(p)) if p is not None else extension_probability(F.col("n"), F.col("mean"), target)
    facts = cut(facts.select("graph_id", "n", chance.alias("p")))
    # the graph's facts come with the neighbours, paths don't carry them
    adj = cut(adjacency(edges).join(facts, "graph_id"))
    roots = deg.select("graph_id", F.array("node").alias("path"), F.lit(-1).alias("place")).join(facts, "graph_id")
    tries = F.sequence(F.lit(0), F.when(F.col("p") < 1, F.lit(rounds - 1)).otherwise(F.lit(0)))
    paths = roots.select("graph_id", "path", "place", F.explode(tries).alias("round"))
    found = None
    kept = Window.partitionBy("graph_id", "round").orderBy("h", "path")
    for size in range(2, k_max + 1):
        tips = paths.select("*", F.posexplode("path").alias("j", "a"))
        met = tips.join(adj.filter(F.col("n") > size), ["graph_id", "a"]).filter((F.col("b") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("b")))
        draw = _uniform(F.lit(seed), F.lit(size), F.col("round"), F.col("graph_id"), F.col("path"), F.col("b"))
        met = met.filter(draw < F.col("p"))
        # the place is the first path node that w is tied to; all its rows have one hash, so none is missed
        placed = met.groupBy("graph_id", "round", "path", "b", F.col("place").alias("before")).agg(F.min("j").alias("place"))
        after = (F.col("place") > F.col("before")) | ((F.col("place") == F.col("before")) & (F.col("b") > F.element_at("path", -1)))
        # the hash follows from the row: it is made again rather than carried
        grown = placed.filter(after).select("graph_id", "round", F.concat("path", F.array("b")).alias("path"), "place", draw.alias("h"))
        # tasks drop what exceeds the budget before a graph's paths meet
        paths = cut(grown.withColumn("_r", F.row_number().over(kept)).filter(F.col("_r") <= budget).drop("_r", "h"))
        if size >= k_min:
            own = paths.select("graph_id", "round", F.array_sort("path").alias("nodes"))
            found = own if found is None else found.unionByName(own)
    return found


def sampled_sets(edges: DataFrame, k_min: int, k_max: int, target: int = TARGET, budget: int = BUDGET, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """graph_id, nodes: the different sets that all rounds found."""
    return extension_tree(edges, k_min, k_max, target, budget, rounds, seed).select("graph_id", "nodes").distinct()
