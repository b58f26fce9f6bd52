"""Graph collections derived from relational tables, and loaders and sinks for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_int
from ..functions.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graphs_from_edges(df: DataFrame, graph_id: str, src: str, dst: str) -> DataFrame:
    """Any table of links as undirected edges: src < dst, distinct, without loops."""
    a, b = F.col(src), F.col(dst)
    return df.filter(a != b).select(F.col(graph_id).cast("long").alias("graph_id"), F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def cust_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: a graph a customer, a node a supplier, an edge two suppliers of one order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()  # orders meet once for both
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("graph_id"))
    a = items.select("l_orderkey", F.col("l_suppkey").alias("src"))
    b = items.select("l_orderkey", F.col("l_suppkey").alias("dst"))
    pairs = a.join(b, "l_orderkey").filter("src < dst").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.select("graph_id", "src", "dst").distinct()


def cust_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 as groups: graph_id, group, node. A supplier of one order is tied to all others of it."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_suppkey").alias("node"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group"), F.col("o_custkey").cast("long").alias("graph_id"))
    return items.join(orders, "group").select("graph_id", "group", "node")


def cust_roles(spark: SparkSession, sf_dir: str, segment: str = "BUILDING") -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), F.when(F.col("c_mktsegment") == segment, "pos").otherwise("neg").alias("role"), F.col("c_mktsegment").alias("class"))


def event_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: a graph a user's week, a node an event type with its hundreds, an edge two successive events."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    g = (F.col("user_id") * 100 + F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7)).cast("long")
    nodes = events.select(g.alias("graph_id"), F.concat("event_type", F.floor(F.col("value") / 100).cast("int").cast("string")).alias("a"), "ts", "event_id")
    following = F.lead("a").over(Window.partitionBy("graph_id").orderBy("ts", "event_id"))
    return graphs_from_edges(nodes.withColumn("b", following).filter("b is not null"), "graph_id", "a", "b")


def event_role() -> Column:
    """Even users are positive."""
    return F.when(F.floor(F.col("graph_id") / 100) % 2 == 0, "pos").otherwise("neg")


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3: a graph a labelled document, a node a word, an edge two adjacent words."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    words = docs.select("doc_id", F.filter(F.split("text", "[ \n]+"), lambda w: w != "").alias("w"))
    pairs = words.select("doc_id", F.explode_outer(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b"))).alias("p"))
    return graphs_from_edges(pairs.filter("p is not null").select("doc_id", "p.a", "p.b"), "doc_id", "a", "b")


#: Name -> edges of a collection.
COLLECTIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"cust_supplier": cust_supplier, "event_week": event_week, "doc_words": doc_words}


def load_graphs(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """A named collection, or else the Parquet table at the name as a path."""
    if name in COLLECTIONS:
        return COLLECTIONS[name](spark, sf_dir)
    return graphs_from_edges(spark.read.parquet(name), "graph_id", "src", "dst")


def numbered(df: DataFrame, *order: Column, size: str | None = None) -> DataFrame:
    """df with rn, each row's number from 1 in the order, and, with ``size``, the sum of that column over the rows before, as before.

    Ranges of the order are numbered side by side; only one row a range is
    ordered in a single task.
    """
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    placed = cut(df.select("*", *[c.alias(k) for k, c in keys.items()]).repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    amount = F.col(size) if size else F.lit(0)
    first = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"))
    starts = totals.select("_p", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(first), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_p").orderBy(*keys)
    out = placed.join(F.broadcast(starts), "_p").withColumn("rn", F.row_number().over(within) + F.col("_n"))  # a row a range
    if size:
        out = out.withColumn("before", F.col("_s") + F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_p", "_n", "_s", *keys)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """graph_id, fold from index files ``test_idx-<fold>.txt`` under the path, one id a line."""
    lines = spark.read.text(f"{path}/test_idx-*.txt").select("value", F.input_file_name().alias("f"))
    fold = F.regexp_extract("f", r"test_idx-(\d+)\.txt$", 1).cast("int")
    return lines.filter(F.trim("value") != "").select(F.trim("value").cast("long").alias("graph_id"), fold.alias("fold"))


def ordered_split(graphs: DataFrame, share: float = 0.8, lexicographic: bool = False, n_graphs: int = 0) -> DataFrame:
    """graph_id, split: the first floor(share * n) graphs train, after an optional head limit."""
    order = F.col("graph_id").cast("string") if lexicographic else F.col("graph_id")
    ids = graphs.select("graph_id").distinct()
    if n_graphs:
        ids = ids.orderBy(order).limit(n_graphs)
    ranked = numbered(ids, order)
    return ranked.withColumn("split", F.when(F.col("rn") <= F.floor(F.lit(share) * ids.count()), "train").otherwise("test")).select("graph_id", "split")


def random_split(graphs: DataFrame, share: float = 0.8) -> DataFrame:
    """graph_id, split: floor(share * n) graphs with the smallest hash of their id train."""
    ids = graphs.select("graph_id").distinct()
    ranked = numbered(ids, F.md5(F.col("graph_id").cast("string")), F.col("graph_id"))
    return ranked.withColumn("split", F.when(F.col("rn") <= F.floor(F.lit(share) * ids.count()), "train").otherwise("test")).select("graph_id", "split")


def stratified_folds(labelled: DataFrame, n_folds: int = 10) -> DataFrame:
    """graph_id, fold: shuffled by hash inside each class and dealt round.

    All rows are numbered at once, side by side; a class starts at its first number.
    """
    ranked = cut(numbered(labelled, F.col("class"), F.md5(F.col("graph_id").cast("string")), F.col("graph_id")))
    first = ranked.groupBy("class").agg(F.min("rn").alias("_first"))
    return ranked.join(first, "class").select("graph_id", "class", ((F.col("rn") - F.col("_first")) % n_folds).cast("int").alias("fold"))


def validation_slice(folds: DataFrame, fold: int, ninth: int = 9) -> DataFrame:
    """graph_id, role: a fold's test ids, and the last n // 9 of the others for validation."""
    rest = folds.filter(F.col("fold") != fold)
    n = rest.count() // ninth
    back = numbered(rest, -F.col("graph_id"))
    return back.select("graph_id", F.when(F.col("rn") <= n, "val").otherwise("train").alias("role")).unionByName(folds.filter(F.col("fold") == fold).select("graph_id", F.lit("test").alias("role")))


def node_offsets(nodes: DataFrame) -> DataFrame:
    """graph_id, n_nodes, node_offset: nodes of all graphs before it."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    return numbered(sizes, F.col("graph_id"), size="n_nodes").select("graph_id", "n_nodes", F.col("before").cast("long").alias("node_offset"))


def mfinder_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One ``u v 1`` line an edge, over node numbers that run through all graphs."""
    local = nodes.withColumn("i", F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1)
    number = local.join(node_offsets(nodes), "graph_id").select("graph_id", "node", (F.col("node_offset") + F.col("i")).alias("id"))
    a, b = number.toDF("graph_id", "src", "u"), number.toDF("graph_id", "dst", "v")
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).select("u", "v", F.concat_ws(" ", "u", "v", F.lit("1")).alias("line"))


def write_mfinder(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def shuffled(ids: DataFrame, seed: int) -> DataFrame:
    """ids in an order that depends on seed and id only."""
    return ids.orderBy(md5_int(F.concat_ws("|", F.lit(seed), "graph_id")))
