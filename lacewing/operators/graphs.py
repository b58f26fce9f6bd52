"""Operators on whole graphs of a collection; every join carries graph_id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Later neighbours by degree order of some node from which a graph is peeled instead.
LONG = 64
#: Nodes of a graph, and squared sizes of its groups in all, up to which it is counted in one pass.
NODES, TIES = 1024, 1 << 16


def fenced(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row, which filters aren't moved through: its other uses have the same plan, and Spark shuffles once for all."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions: graph_id, a, b."""
    forward = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    return forward.union(edges.select("graph_id", "dst", "src"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return adjacency(edges).select("graph_id", F.col("a").alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node, deg."""
    return adjacency(edges).groupBy("graph_id", F.col("a").alias("node")).agg(F.count("*").alias("deg"))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("graph_id", F.col("a").alias("node")).agg(F.sort_array(F.collect_list("b")).alias("nbrs"))


def local_index(nodes: DataFrame) -> DataFrame:
    """idx: each node's place in its graph, from 0."""
    return nodes.withColumn("idx", (F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1).cast("long"))


def triangles(edges: DataFrame) -> DataFrame:
    """graph_id and the three nodes of each triangle, ascending.

    Edges point from the node of smaller degree, so no node has many outgoing
    ones. An edge carries its first node's list of later neighbours to the
    second's, and what they share closes it.
    """
    deg = fenced(degrees(edges))
    d1, d2 = deg.toDF("graph_id", "src", "d1"), deg.toDF("graph_id", "dst", "d2")
    both = edges.join(d1, ["graph_id", "src"]).join(d2, ["graph_id", "dst"])
    swap = (F.col("d1") > F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") > F.col("dst")))
    out = both.select("graph_id", F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("u"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("v"))
    lists = out.filter("u is not null and v is not null").groupBy("graph_id", "u").agg(F.collect_list("v").alias("_near"))
    ties = lists.filter(F.size("_near") > 1).select("graph_id", "u", "_near", F.explode("_near").alias("v"))
    closed = ties.join(lists.toDF("graph_id", "v", "_l"), ["graph_id", "v"]).select("graph_id", "u", "v", F.explode(F.array_intersect("_near", "_l")).alias("w"))
    t = F.sort_array(F.array("u", "v", "w"))
    return closed.select("graph_id", t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def peeled(edges: DataFrame) -> DataFrame:
    """graph_id, node, round: when a node is peeled off; each round takes from every graph the nodes of at most twice its mean degree.

    At least half of a graph's nodes go in a round. An edge that points to the
    end that goes later, or is larger in the same round, leaves a node as often
    as it had edges when it went: at most four times the largest density of a
    subgraph, however large hubs are.
    """
    left, found, step = cut(edges.select("graph_id", "src", "dst")), None, 0
    while left.limit(1).count():
        deg = degrees(left)
        mean = deg.groupBy("graph_id").agg(F.avg("deg").alias("mean"))
        gone = cut(deg.join(mean, "graph_id").filter(F.col("deg") <= 2 * F.col("mean")).select("graph_id", "node", F.lit(step).alias("round")))
        for end in ("src", "dst"):
            left = left.join(gone.select("graph_id", F.col("node").alias(end)), ["graph_id", end], "left_anti")
        left = cut(left.select("graph_id", "src", "dst"))
        found = gone if found is None else found.union(gone)
        step += 1
    if found is None:
        return edges.select("graph_id", F.col("src").alias("node"), F.lit(0).alias("round"))
    # a node whose last neighbours went before it has no round yet
    return nodes_of(edges).join(found, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("round", F.lit(step)).alias("round"))


def _pointed(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """graph_id, a, later: a node's neighbours that come later by ``rank`` (graph_id, node and a number), ties by node."""
    r = rank.toDF("graph_id", "node", "_r")
    both = edges.join(r.toDF("graph_id", "src", "_s"), ["graph_id", "src"]).join(r.toDF("graph_id", "dst", "_d"), ["graph_id", "dst"])
    up = F.struct("_s", "src") < F.struct("_d", "dst")
    pointed = both.select("graph_id", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    return pointed.groupBy("graph_id", "a").agg(F.collect_list("b").alias("later"))


def later_neighbours(edges: DataFrame) -> DataFrame:
    """graph_id, a, later: a node's neighbours that come later, as a list of bounded length.

    Nodes go by degree, which takes no rounds; a graph in which that leaves some
    node more than LONG is peeled, and its nodes go in that order.
    """
    edges = cut(edges.select("graph_id", "src", "dst"))
    lists = cut(_pointed(edges, fenced(degrees(edges))))
    long = cut(lists.filter(F.size("later") > LONG).select("graph_id").distinct())
    if not long.limit(1).count():
        return lists
    rest = cut(edges.join(long, "graph_id", "left_semi").select("graph_id", "src", "dst"))
    return lists.join(long, "graph_id", "left_anti").unionByName(_pointed(rest, cut(peeled(rest))))


def cliques(edges: DataFrame, size: int) -> DataFrame:
    """graph_id, nodes (ascending): every clique of the size, once.

    Nodes are taken in the order of ``later_neighbours``. A partial clique carries the nodes that
    are tied to all of it; one join a node cuts that list with the node's own.
    """
    if size == 2:
        return edges.select("graph_id", F.array("src", "dst").alias("nodes"))
    lists = later_neighbours(edges)
    step = lists.select("graph_id", F.col("a").alias("next"), F.col("later").alias("_l"))
    grown = lists.select("graph_id", F.array("a").alias("nodes"), F.col("later").alias("ties"))
    for k in range(2, size):
        # fewer ties than nodes still missing can't complete a clique
        grown = grown.filter(F.size("ties") >= size - k + 1).select("graph_id", "nodes", "ties", F.explode("ties").alias("next"))
        grown = grown.join(step, ["graph_id", "next"]).select("graph_id", F.concat("nodes", F.array("next")).alias("nodes"), F.array_intersect("ties", "_l").alias("ties"))
    return grown.select("graph_id", "nodes", F.explode("ties").alias("next")).select("graph_id", F.array_sort(F.concat("nodes", F.array("next"))).alias("nodes"))


def group_counts(groups: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((graph_id, w, t, q), graph_ids of larger graphs, or None): wedges, triangles and cliques of four of graphs whose edges tie all nodes of a group.

    ``groups`` has graph_id, group and node, with repeats; a null ties nothing.
    Its rows are shuffled once and no edge is: a graph's arrive in order of
    groups, and each node's neighbours are the bits of a number. Of a graph
    beyond NODES or TIES nothing is kept but its graph_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, group, larger, ties = None, None, False, 0
        place: dict[int, int] = {}
        near: list[int] = []
        part: set[int] = set()
        out: list[tuple] = []

        def close() -> None:
            """Ties the nodes of the group that ends."""
            nonlocal larger, ties
            ties += len(part) ** 2
            larger = larger or len(part) > NODES or ties > TIES
            if not larger and len(part) > 1:
                for v in part:
                    if v not in place:
                        place[v] = len(near)
                        near.append(0)
                larger = len(near) > NODES
                bits = 0
                for v in part:
                    bits |= 1 << place[v]
                for v in part:
                    near[place[v]] |= bits
            if larger:
                place.clear()
                near.clear()
            part.clear()

        def finish() -> None:
            close()
            if larger:
                out.append((graph, None, None, None))
            elif near:
                out.append((graph, *_counted(near)))
            place.clear()
            near.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["graph_id", "w", "t", "q"])
            out.clear()
            return batch

        for b in batches:
            for g, c, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if g != graph:
                    if graph is not None:
                        finish()
                    graph, group, larger, ties = g, c, False, 0
                elif c != group:
                    close()
                    group = c
                if len(part) <= NODES:
                    part.add(v)
            if len(out) >= 10_000:
                yield made()
        if graph is not None:
            finish()
        if out:
            yield made()

    rows = groups.select("graph_id", "group", F.col("node").cast("long").alias("node")).dropna()
    rows = rows.repartition("graph_id").sortWithinPartitions("graph_id", "group")
    counts = cut(rows.mapInArrow(run, "graph_id long, w long, t long, q long"))
    larger = counts.filter("w is null").select("graph_id")
    return counts.filter("w is not null"), larger if larger.limit(1).count() else None


def _counted(near: list[int]) -> tuple[int, int, int]:
    """Wedges, triangles and cliques of four, from each node's neighbours as bits, its own among them or not."""
    w = t = q = 0
    for u, bits in enumerate(near):
        d = (bits & ~(1 << u)).bit_count()
        w += d * (d - 1) // 2
        later = bits >> u + 1 << u + 1
        while later:
            low = later & -later
            later ^= low
            both = later & near[low.bit_length() - 1]
            t += both.bit_count()
            while both:
                low = both & -both
                both ^= low
                q += (both & near[low.bit_length() - 1]).bit_count()
    return w, t, q


def line_graph(edges: DataFrame) -> DataFrame:
    """Edges between edges that share an endpoint; an edge is named 'src|dst'."""
    name = edges.select("graph_id", F.concat_ws("|", "src", "dst").alias("e"), F.explode(F.array("src", "dst")).alias("v"))
    pairs = name.toDF("graph_id", "e1", "v").join(name.toDF("graph_id", "e2", "v"), ["graph_id", "v"]).filter("e1 < e2")
    return pairs.select("graph_id", F.col("e1").alias("src"), F.col("e2").alias("dst")).distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """graph_id, node, hop: nodes within so many hops of the seeds, with the smallest distance."""
    adj = adjacency(edges)
    reached = seeds.select("graph_id", "node", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        ring = reached.filter(F.col("hop") == h - 1).join(adj.withColumnRenamed("a", "node"), ["graph_id", "node"]).select("graph_id", F.col("b").alias("node")).distinct()
        reached = reached.union(ring.join(reached, ["graph_id", "node"], "left_anti").withColumn("hop", F.lit(h)))
    return reached


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    keep = nodes.select("graph_id", "node").distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_semi")


def edges_touching(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges with at least one end among the roots."""
    r = roots.select("graph_id", "node").distinct()
    ends = [edges.join(r.withColumnRenamed("node", end), ["graph_id", end], "left_semi").select(*edges.columns) for end in ("src", "dst")]
    return ends[0].union(ends[1]).distinct()


def neighbourhood_edges(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """graph_id, root, src, dst: the edges inside each root's own ball; balls of several roots aren't united."""
    adj = adjacency(edges)
    ball = roots.select("graph_id", F.col("node").alias("root"), "node").distinct()
    for _ in range(hops):
        ring = ball.join(adj.withColumnRenamed("a", "node"), ["graph_id", "node"]).select("graph_id", "root", F.col("b").alias("node"))
        ball = ball.union(ring).distinct()
    a, b = ball.withColumnRenamed("node", "src"), ball.withColumnRenamed("node", "dst")
    return edges.select("graph_id", "src", "dst").join(a, ["graph_id", "src"]).join(b, ["graph_id", "root", "dst"]).select("graph_id", "root", "src", "dst")


def one_hot(labels: DataFrame, width: int) -> DataFrame:
    """graph_id, node, x: 1.0 at the node's whole-number ``label``, in an array of so many places; none at a label outside."""
    return labels.select("graph_id", "node", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k == F.col("label"), 1.0).otherwise(0.0)).alias("x"))


def labelled_line_graph(edges: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(line graph, labels of its nodes): an edge's label is its ends' labels in order, or 1 without ``labels`` (graph_id, node, label)."""
    name = edges.select("graph_id", F.concat_ws("|", "src", "dst").alias("node"), "src", "dst")
    if labels is None:
        return line_graph(edges), name.select("graph_id", "node", F.lit("1").alias("label"))
    a, b = labels.toDF("graph_id", "src", "x"), labels.toDF("graph_id", "dst", "y")
    both = name.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return line_graph(edges), both.select("graph_id", "node", F.concat_ws(",", F.sort_array(F.array(F.col("x").cast("string"), F.col("y").cast("string")))).alias("label"))


def context_view(edges: DataFrame, motif: DataFrame) -> DataFrame:
    """A motif's nodes with their neighbours, without edges between context nodes."""
    hood = expand(edges, motif, 1)
    return edges_touching(induced_edges(edges, hood), motif)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node, comp: the smallest node of the connected component inside ``nodes``.

    Each round takes the smallest label of a node, its neighbours, and of the
    node that its label names, so labels travel in doubling steps. Rounds are
    checkpointed and end when nothing changes.
    """
    inner = cut(adjacency(induced_edges(edges, nodes)))
    labels = cut(nodes.select("graph_id", "node", F.col("node").alias("comp")).distinct())
    while True:
        near = inner.join(labels.withColumnRenamed("node", "b"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        new = labels.join(near, ["graph_id", "node"], "left").select("graph_id", "node", F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        jump = new.toDF("graph_id", "comp", "up")
        new = cut(new.join(jump, ["graph_id", "comp"]).select("graph_id", "node", F.least("comp", "up").alias("comp")))
        if not new.join(labels, ["graph_id", "node", "comp"], "left_anti").limit(1).count():
            return new
        labels = new


def largest_component(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node of each graph's largest component; the one with the smallest node on a tie."""
    comp = components(edges, nodes)
    size = comp.groupBy("graph_id", "comp").agg(F.count("*").alias("n"))
    best = size.groupBy("graph_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "comp")).alias("b")).select("graph_id", F.col("b.comp").alias("comp"))
    return comp.join(best, ["graph_id", "comp"]).select("graph_id", "node")
