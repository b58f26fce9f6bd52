"""Patterns of any shape in the graphs of a collection, as joins that Catalyst orders.

A pattern is a list of edges between small whole numbers. A mapping gives each
of them a different node so that every pattern edge is an edge of the graph;
further edges between the nodes may be there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import adjacency


def in_joining_order(pattern: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pattern's edges, each after the first sharing a node with those before; the shared node first."""
    if not pattern:
        raise ValueError("a pattern has an edge at least")
    left, out = [tuple(x) for x in pattern[1:]], [tuple(pattern[0])]
    seen = set(out[0])
    while left:
        # closing edges filter, so they come as soon as they can
        best = max(left, key=lambda x: (len(seen & set(x)), -left.index(x)))
        if not seen & set(best):
            raise ValueError("a pattern is connected")
        left.remove(best)
        out.append(best if best[0] in seen else best[::-1])
        seen |= set(best)
    return out


def mappings(edges: DataFrame, pattern: list[tuple[int, int]], budget: int | None = None) -> DataFrame:
    """graph_id and a column n<i> a pattern node: every mapping of the pattern.

    Graphs of more than ``budget`` edges aren't searched; see ``found``.
    """
    e = edges.select("graph_id", "src", "dst")
    if budget is not None:
        e = e.join(e.groupBy("graph_id").agg(F.count("*").alias("_m")).filter(F.col("_m") <= budget), "graph_id", "left_semi")
    adj, out, bound = adjacency(e), None, []
    for a, b in in_joining_order(pattern):
        step = adj.toDF("graph_id", f"n{a}", f"n{b}")
        if out is None:
            out, bound = step, [a, b]
        elif b in bound:
            out = out.join(step, ["graph_id", f"n{a}", f"n{b}"], "left_semi")
        else:
            out = out.join(step, ["graph_id", f"n{a}"])
            for x in bound:
                if x != a:
                    out = out.filter(F.col(f"n{x}") != F.col(f"n{b}"))
            bound.append(b)
    return out.select("graph_id", *[f"n{x}" for x in sorted(bound)])


def occurrences(edges: DataFrame, pattern: list[tuple[int, int]], budget: int | None = None) -> DataFrame:
    """graph_id, edges: every subgraph that the pattern maps to, once, as its sorted edges."""
    pairs = [F.array(F.least(f"n{a}", f"n{b}"), F.greatest(f"n{a}", f"n{b}")) for a, b in pattern]
    return mappings(edges, pattern, budget).select("graph_id", F.sort_array(F.array(*pairs)).alias("edges")).distinct()


def counts(edges: DataFrame, pattern: list[tuple[int, int]], budget: int | None = None) -> DataFrame:
    """graph_id, n_mappings of the graphs that have the pattern."""
    return mappings(edges, pattern, budget).groupBy("graph_id").agg(F.count("*").alias("n_mappings"))


def found(edges: DataFrame, pattern: list[tuple[int, int]], budget: int | None = None) -> DataFrame:
    """graph_id, found of every graph; null where the budget left it undecided."""
    sizes = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    hits = mappings(edges, pattern, budget).select("graph_id").distinct().withColumn("hit", F.lit(True))
    rows = sizes.join(hits, "graph_id", "left")
    undecided = F.lit(False) if budget is None else F.col("m") > budget
    return rows.select("graph_id", F.when(~undecided, F.coalesce("hit", F.lit(False))).alias("found"))


def frequency(edges: DataFrame, pattern: list[tuple[int, int]], norm: str = "log", budget: int | None = None, least: int = 3) -> DataFrame:
    """n_graphs, n_hits, freq over the graphs that were decided; an error below ``least`` of them."""
    from .subgraphs import pattern_frequency

    decided = found(edges, pattern, budget).filter("found is not null")
    if decided.limit(least).count() < least:
        raise ValueError(f"fewer than {least} graphs could be searched")
    return pattern_frequency(decided, decided.filter("found"), norm)
