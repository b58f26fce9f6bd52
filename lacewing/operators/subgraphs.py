"""Connected subgraphs of fixed size: enumeration, certificates and vectors."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket
from ..functions.lineage import cut
from .graphs import adjacency, degrees, fenced, triangles


#: Nodes of a set whose pairs fit the bits of a long.
MOST_NODES = 11


def _bit(i: Column, j: Column) -> Column:
    """The bit of the pair of places i < j."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (j * (j - 1) / 2 + i).cast("int"))


def _grown(edges: DataFrame, k: int) -> DataFrame:
    """graph_id, nodes (ascending), bits: every connected node set of size k, once, and the pairs of its places that are induced edges.

    A set comes from each of its connected sets of one node less, which knows
    its own edges and meets the new node by one more. For every edge some node
    other than its ends can be left out, so together they know them all.
    """
    if k > MOST_NODES:
        raise ValueError(f"sets of {MOST_NODES} nodes at most")
    adj = adjacency(edges)
    subs = edges.select("graph_id", F.array("src", "dst").alias("nodes"), F.lit(1).cast("long").alias("bits"))
    for size in range(2, k):
        tips = subs.select("graph_id", "nodes", "bits", F.posexplode("nodes").alias("at", "a"))
        grown = tips.join(adj, ["graph_id", "a"]).filter(~F.array_contains("nodes", F.col("b")))
        before = sum((F.when(F.get("nodes", F.lit(i)) < F.col("b"), 1).otherwise(0) for i in range(size)), F.lit(0))
        grown = grown.select("graph_id", "nodes", "bits", "at", "b", before.alias("p"))
        place = lambda i: i + F.when(i >= F.col("p"), 1).otherwise(0)
        bits = _bit(F.least(place(F.col("at")), F.col("p")), F.greatest(place(F.col("at")), F.col("p")))
        for i, j in itertools.combinations(range(size), 2):
            known = F.col("bits").bitwiseAND(F.lit(1 << (j * (j - 1) // 2 + i))) != 0
            bits = bits.bitwiseOR(F.when(known, _bit(place(F.lit(i)), place(F.lit(j)))).otherwise(0))
        grown = grown.select("graph_id", F.sort_array(F.concat("nodes", F.array("b"))).alias("nodes"), bits.alias("bits"))
        subs = grown.groupBy("graph_id", "nodes").agg(F.bit_or("bits").alias("bits"))
    return subs


def enumerate_subgraphs(edges: DataFrame, k: int) -> DataFrame:
    """graph_id, nodes (ascending): every connected node set of size k, once."""
    adj = adjacency(edges)
    subs = edges.select("graph_id", F.array("src", "dst").alias("nodes"))
    for _ in range(k - 2):
        tips = subs.select("graph_id", "nodes", F.explode("nodes").alias("a"))
        grown = tips.join(adj, ["graph_id", "a"]).filter(~F.array_contains("nodes", F.col("b")))
        subs = grown.select("graph_id", F.array_sort(F.concat("nodes", F.array("b"))).alias("nodes")).distinct()
    return subs


def induced_subgraphs(edges: DataFrame, k: int) -> DataFrame:
    """graph_id, nodes, local: ``induced`` of all connected sets of size k, whose edges are gathered as the sets grow."""
    pairs = F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << (j * (j - 1) // 2 + i))) != 0, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i, j in itertools.combinations(range(k), 2)])
    return _grown(edges, k).select("graph_id", "nodes", F.array_compact(pairs).alias("local"))


def extension_probability(n: Column, mean_degree: Column, budget: int = 50) -> Column:
    """The chance with which a sampler follows a branch so that about ``budget`` sets come out."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(budget)) / F.greatest(F.lit(1.0), n * F.pow(F.greatest(mean_degree, F.lit(1.0)), F.lit(2.0)) / 3)))


def sample_subgraphs(subs: DataFrame, n: int) -> DataFrame:
    """n sets a graph, chosen by hash; a graph with fewer repeats its own in turn."""
    key = F.concat_ws("|", F.col("graph_id").cast("string"), F.array_join("nodes", ","))
    counted = subs.withColumn("m", F.count("*").over(Window.partitionBy("graph_id")))  # first, so that the hashes are made where a graph's sets have met
    ranked = counted.withColumn("rn", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.md5(key), "nodes")))
    copies = F.when(F.col("m") >= n, F.when(F.col("rn") <= n, 1).otherwise(0)).otherwise((F.lit(n) - F.col("rn") + F.col("m")) / F.col("m")).cast("int")
    return ranked.withColumn("pick", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select("graph_id", "nodes", "pick")


def induced(subs: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, nodes, local: the induced edges as pairs (i, j) of places in ``nodes``, i < j."""
    places = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.filter(F.transform("nodes", lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda x: x["j"] > i), lambda x: F.struct(a.alias("src"), x["b"].alias("dst"), i.alias("i"), x["j"].alias("j")))))
    pairs = subs.select("graph_id", "nodes", F.explode(places).alias("p")).select("graph_id", "nodes", "p.*")
    found = pairs.join(edges, ["graph_id", "src", "dst"])
    return found.groupBy("graph_id", "nodes").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("local"))


def by_pattern(ind: DataFrame, k: int, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sets of size k with what ``made`` adds to (graph_id, nodes, local), made once for every graph on k places: right where induced edges alone decide it."""
    pairs = list(itertools.combinations(range(k), 2))
    rows = [(x, list(range(k)), [p for b, p in enumerate(pairs) if x >> b & 1]) for x in range(1, 1 << len(pairs))]
    patterns = ind.sparkSession.createDataFrame(rows, "graph_id long, nodes array<int>, local array<struct<i:int,j:int>>")
    added = made(patterns).drop("nodes", "local")
    known = patterns.select("graph_id", F.col("local").alias("_l")).join(added, "graph_id").drop("graph_id")
    return ind.join(F.broadcast(known), F.col("local") == F.col("_l")).drop("_l")  # 2 ** (k * (k - 1) / 2) rows


def _degree(local: str, i: Column) -> Column:
    return F.size(F.filter(local, lambda e: (e["i"] == i) | (e["j"] == i)))


def _triangles(local: str, i: Column) -> Column:
    """Edges whose two ends are both neighbours of node i."""
    joined = lambda x: F.exists(local, lambda e: ((e["i"] == i) & (e["j"] == x)) | ((e["j"] == i) & (e["i"] == x)))
    return F.size(F.filter(local, lambda e: (e["i"] != i) & (e["j"] != i) & joined(e["i"]) & joined(e["j"])))


def profiles(ind: DataFrame) -> DataFrame:
    """Adds prof: (deg, tri) of each node, ascending. Tells all connected graphs apart up to five nodes."""
    prof = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.struct(_degree("local", i).alias("deg"), _triangles("local", i).alias("tri")))
    return ind.withColumn("prof", F.sort_array(prof))


def certificates(ind: DataFrame) -> DataFrame:
    """graph_id, nodes, cert."""
    cert = F.array_join(F.transform("prof", lambda p: F.concat_ws(":", p["deg"], p["tri"])), ",")
    return profiles(ind).select("graph_id", "nodes", cert.alias("cert"))


PATH3, TRIANGLE = "1:0,1:0,2:0", "2:1,2:1,2:1"


def certificate_counts_k3(edges: DataFrame) -> DataFrame:
    """graph_id, cert, n for size 3 without making the sets.

    Sets that are paths are the neighbour pairs that no edge closes: the sum of
    deg * (deg - 1) / 2, less three for each triangle.
    """
    edges = fenced(edges)
    wedges = degrees(edges).groupBy("graph_id").agg(F.sum(F.col("deg") * (F.col("deg") - 1) / 2).cast("long").alias("w"))
    closed = triangles(edges).groupBy("graph_id").agg(F.count("*").alias("t"))
    return certified(wedges.join(closed, "graph_id", "left").withColumn("t", F.coalesce("t", F.lit(0))))


def certified(both: DataFrame) -> DataFrame:
    """graph_id, cert, n of the sets of three, from each graph's wedges w and triangles t."""
    rows = both.select("graph_id", F.explode(F.array(F.struct(F.lit(PATH3).alias("cert"), (F.col("w") - 3 * F.col("t")).alias("n")), F.struct(F.lit(TRIANGLE).alias("cert"), F.col("t").alias("n")))).alias("x"))
    return rows.select("graph_id", "x.cert", F.col("x.n").cast("long").alias("n")).filter("n > 0")


def structural_vectors(ind: DataFrame, width: int = 16) -> DataFrame:
    """graph_id, nodes, vec: size, least degree, triangles, density, then degrees downwards, padded."""
    n, m = F.size("nodes"), F.size("local")
    degs = F.transform("prof", lambda p: p["deg"].cast("double"))
    down = F.slice(F.concat(F.reverse(degs), F.array_repeat(F.lit(0.0), width)), 1, width)
    tri = F.aggregate("prof", F.lit(0), lambda a, p: a + p["tri"]) / 3
    vec = F.concat(F.array(n.cast("double"), F.array_min(degs), tri, 2.0 * m / F.greatest(n * (n - 1), F.lit(1))), down)
    return profiles(ind).select("graph_id", "nodes", vec.alias("vec"))


def wl_labels(ind: DataFrame, labels: DataFrame | None, iterations: int) -> DataFrame:
    """Adds rounds: the nodes' labels after each round, the first ones included.

    A round's label is the MD5 of the own label and the sorted labels of the
    neighbours inside the set. First labels come from ``labels`` (graph_id,
    node, label), or are induced degrees.
    """
    return wl_rounds(first_labels(ind, labels), iterations)


def first_labels(ind: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds lab: the nodes' labels (graph_id, node, label) in order, or without any their induced degrees."""
    if labels is None:
        return ind.withColumn("lab", F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: _degree("local", i).cast("string")))
    flat = ind.select("graph_id", "nodes", "local", F.posexplode("nodes").alias("pos", "node")).join(labels, ["graph_id", "node"])
    return flat.groupBy("graph_id", "nodes", "local").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("lab"))


def by_labelled_pattern(start: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sets (graph_id, nodes, local, lab) with what ``made`` adds to them, made once for all sets of equal induced edges and labels: right where those alone decide it."""
    start = cut(start)
    patterns = start.select("local", "lab").distinct()
    patterns = cut(patterns.select(F.monotonically_increasing_id().alias("graph_id"), F.transform("lab", lambda _, i: i).alias("nodes"), "local", "lab"))
    added = made(patterns).drop("nodes", "local", "lab")
    known = cut(patterns.select("graph_id", "local", "lab").join(added, "graph_id").drop("graph_id"))
    return start.join(known, ["local", "lab"])


def wl_rounds(start: DataFrame, iterations: int) -> DataFrame:
    """``wl_labels`` from the first labels ``lab``."""
    out = start.withColumn("rounds", F.array("lab"))
    for _ in range(iterations):
        near = lambda i: F.transform(F.filter("local", lambda e: (e["i"] == i) | (e["j"] == i)), lambda e: F.get(F.col("lab"), F.when(e["i"] == i, e["j"]).otherwise(e["i"])))
        new = F.transform("lab", lambda own, i: F.md5(F.concat(own, F.lit("|"), F.array_join(F.sort_array(near(i)), ","))))
        out = out.select(*[c for c in out.columns if c != "lab"], F.inline(F.array(F.struct(new.alias("lab")))))
        out = out.withColumn("rounds", F.concat("rounds", F.array("lab")))
    return out.drop("lab")


def wl_histograms(labelled: DataFrame, dim: int) -> DataFrame:
    """graph_id, nodes, vec: labels of all rounds counted in ``dim`` hash buckets."""
    buckets = F.transform(F.flatten("rounds"), lambda x: md5_bucket(x, dim))
    # a generator of one row: the buckets' definition isn't moved into the lambda, where it would run for each of them
    fenced = labelled.select("graph_id", "nodes", F.inline(F.array(F.struct(buckets.alias("_b")))))
    return fenced.select("graph_id", "nodes", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter("_b", lambda b: b == d))).alias("vec"))


def wwl_vectors(labelled: DataFrame, dim: int, iterations: int) -> DataFrame:
    """graph_id, nodes, vec: for each round the mean over nodes of a vector that the label names, padded to dim.

    A label's vector has components uniform in [-1, 1), from MD5 of label and
    place, scaled to unit length.
    """
    width = max(1, dim // (iterations + 1))
    raw = lambda label: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.conv(F.substring(F.md5(F.concat_ws("#", label, j)), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1.0)
    unit = lambda v: F.transform(v, lambda x: x / (F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)) + 1e-8))
    vectors = F.transform("rounds", lambda r: F.transform(r, lambda label: unit(raw(label))))
    pooled = F.transform("_v", lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(r, F.lit(0.0), lambda a, v: a + F.get(v, j)) / F.size(r)))
    out = labelled.select("graph_id", "nodes", F.inline(F.array(F.struct(vectors.alias("_v")))))
    return out.select("graph_id", "nodes", F.slice(F.concat(F.flatten(pooled), F.array_repeat(F.lit(0.0), dim)), 1, dim).alias("vec"))


def graph_wl_hash(edges: DataFrame, iterations: int = 3) -> DataFrame:
    """graph_id, wl_hash: MD5 of the sorted labels of all nodes after so many rounds, from degrees."""
    adj = adjacency(edges)
    labels = degrees(edges).select("graph_id", "node", F.col("deg").cast("string").alias("label"))
    for _ in range(iterations):
        near = adj.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "l"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("l")), ",").alias("ls"))
        labels = labels.join(near, ["graph_id", "node"]).select("graph_id", "node", F.md5(F.concat("label", F.lit("|"), "ls")).alias("label"))
    return labels.groupBy("graph_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list("label")), ",")).alias("wl_hash"))


def pattern_frequency(edges: DataFrame, hits: DataFrame, norm: str = "log") -> DataFrame:
    """n_graphs, n_hits, freq: the share of graphs with a hit, normalised for the number of graphs."""
    n = edges.agg(F.countDistinct("graph_id").alias("n_graphs"))
    c = hits.agg(F.countDistinct("graph_id").alias("n_hits"))
    raw = F.col("n_hits") / (F.col("n_graphs") + 0.001)
    power = {"log": 1 / (F.log(F.col("n_graphs").cast("double")) + 1), "sqrt": 1 / F.sqrt(F.col("n_graphs").cast("double")) / 5, "raw": F.lit(1.0)}[norm]
    return n.join(F.broadcast(c)).withColumn("freq", F.pow(raw, power))  # one row each


def squares(edges: DataFrame) -> DataFrame:
    """graph_id, nodes of every cycle of four nodes (as a subgraph), once a cycle."""
    adj = adjacency(edges)
    # two opposite corners x < y with common neighbours u < v
    fork = adj.toDF("graph_id", "u", "x").join(adj.toDF("graph_id", "u", "y"), ["graph_id", "u"]).filter("x < y")
    pairs = fork.toDF("graph_id", "u", "x", "y").join(fork.toDF("graph_id", "v", "x", "y"), ["graph_id", "x", "y"]).filter("u < v and x < u")
    return pairs.select("graph_id", F.array("x", "u", "y", "v").alias("nodes"))
