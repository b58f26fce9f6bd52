"""Motif discovery end to end: sample, embed, bucket, score, predict, measure.

    python -m lacewing.plans.discovery --data DIR --embed-mode canonical

DIR holds ``edges`` (graph_id, role, src, dst) and ``truth`` (graph_id, node),
as ``python -m lacewing.plans.generate --out DIR`` writes them. ``--load-model``
measures a saved model instead of fitting one.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import generators, graphs, sampling, scoring, subgraphs, vectors
from ..sources import collections as src


#: Rounds in which ``generate`` replaces graphs that were not accepted.
ROUNDS = 50


@dataclass
class Config:
    n_samples: int = 20
    k_min: int = 3
    k_max: int = 4
    hash_dim: int = 16
    embed_dim: int = 32
    n_graphs: int = 0
    embed_mode: str = "wl"  # wl, wwl, tree, canonical
    clf: str = "auto"  # auto, lda, tree, knn
    score: str = "gstat"  # gstat, count
    tree_depth: int = 5
    score_alpha: float = 1.5
    knn_k: int = 30
    top_k: int = 3
    pred_mode: str = "bucket"  # bucket, subgraph
    cc_filter: bool = False
    seed: int = 0

    def classifier(self) -> str:
        return self.clf if self.clf != "auto" else "tree" if self.embed_mode == "tree" else "lda"


def sampled(edges: DataFrame, c: Config) -> DataFrame:
    """graph_id, nodes, pick: n_samples connected sets a graph over all sizes; a graph with fewer gives its own several times."""
    found = sampling.sampled_sets(edges, c.k_min, c.k_max, seed=c.seed)
    return subgraphs.sample_subgraphs(cut(found), c.n_samples).select("graph_id", "nodes", "pick")


def embedded(edges: DataFrame, c: Config) -> DataFrame:
    """graph_id, nodes and vec, or cert in canonical mode; sets that were drawn twice stand twice."""
    subs = sampled(edges, c)
    ind = subgraphs.induced(subs.select("graph_id", "nodes").distinct(), edges)
    if c.embed_mode == "canonical":
        out = subgraphs.certificates(ind)
    elif c.embed_mode == "tree":
        out = subgraphs.structural_vectors(subgraphs.profiles(ind))
    else:
        labels = graphs.degrees(edges).select("graph_id", "node", F.col("deg").cast("string").alias("label"))
        rounds = subgraphs.wl_labels(ind, labels, 4)
        out = subgraphs.wl_histograms(rounds, c.embed_dim) if c.embed_mode == "wl" else subgraphs.wwl_vectors(rounds, c.embed_dim, 4)
    return subs.select("graph_id", "nodes").join(out, ["graph_id", "nodes"])


@dataclass
class Model:
    """Hash planes or a tree (both absent in canonical mode), and scored buckets."""

    planes: list[list[float]] | None
    tree: object | None
    buckets: DataFrame

    def assign(self, rows: DataFrame) -> DataFrame:
        """rows with their bucket."""
        if self.tree is not None:
            from pyspark.ml.functions import array_to_vector

            done = self.tree.transform(rows.withColumn("features", array_to_vector(F.col("vec").cast("array<double>"))))
            return done.withColumn("bucket", F.col("leaf").cast("int").cast("string")).select(*rows.columns, "bucket")
        if self.planes is not None:
            return rows.withColumn("bucket", vectors.simhash(F.col("vec"), self.planes))
        return rows.withColumn("bucket", F.col("cert"))

    def save(self, path: str) -> None:
        spark = self.buckets.sparkSession
        self.buckets.write.mode("overwrite").parquet(f"{path}/buckets")
        spark.createDataFrame([(json.dumps(self.planes),)], "planes string").write.mode("overwrite").parquet(f"{path}/planes")
        if self.tree is not None:
            self.tree.write().overwrite().save(f"{path}/tree")

    @staticmethod
    def load(spark: SparkSession, path: str, with_tree: bool = False) -> Model:
        from pyspark.ml.classification import DecisionTreeClassificationModel

        planes = json.loads(spark.read.parquet(f"{path}/planes").first().planes)
        return Model(planes, DecisionTreeClassificationModel.load(f"{path}/tree") if with_tree else None, spark.read.parquet(f"{path}/buckets"))


def fit(pos: DataFrame, neg: DataFrame, c: Config, n_pos: int, n_neg: int) -> Model:
    """Planes or tree from the vectors of both classes, and each bucket's score."""
    both = pos.withColumn("role", F.lit("pos")).unionByName(neg.withColumn("role", F.lit("neg")))
    planes = tree = None
    if c.embed_mode != "canonical":
        rows = both.withColumn("z", F.col("vec").cast("array<double>"))
        if c.classifier() == "tree":
            from pyspark.ml.classification import DecisionTreeClassifier
            from pyspark.ml.functions import array_to_vector

            data = rows.withColumn("features", array_to_vector("z")).withColumn("y", (F.col("role") == "pos").cast("double"))
            tree = DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=c.tree_depth, minInstancesPerNode=20, leafCol="leaf", seed=42).fit(data)
        else:
            fitted, _ = vectors.lda_planes(rows, len(rows.first().z), c.hash_dim)
            planes = np.asarray(fitted).tolist()
    model = Model(planes, tree, both.limit(0))
    counts = scoring.bucket_counts(model.assign(both).groupBy("bucket", "role").agg(F.count("*").alias("n")))
    if c.embed_mode == "canonical":
        model.buckets = scoring.canonical_score(counts, n_pos, n_neg, c.score_alpha)
    elif c.classifier() == "knn":
        numbered = lambda df: df.select(F.xxhash64("graph_id", "nodes").alias("id"), F.col("vec").cast("array<double>").alias("z"), F.size("nodes").alias("k"), "vec")
        p, n = numbered(pos), numbered(neg)
        scored = None
        for r in p.select("k").distinct().collect():
            s = vectors.knn_scores(p.filter(F.col("k") == r.k), n.filter(F.col("k") == r.k), c.knn_k)
            scored = s if scored is None else scored.union(s)
        mean = model.assign(p).join(scored.dropDuplicates(["id"]), "id").groupBy("bucket").agg(F.avg("score").alias("score"))
        model.buckets = counts.join(mean, "bucket")
    else:
        model.buckets = scoring.gstat(counts) if c.score == "gstat" else scoring.count_score(counts, c.score_alpha)
    return model


def evaluate(test: DataFrame, edges: DataFrame, truth: DataFrame, model: Model, c: Config) -> DataFrame:
    """bucket (or null for subgraph mode), n_inter, n_union, jaccard, best first."""
    subs = model.assign(test)
    if c.pred_mode == "subgraph":
        predicted = scoring.predict_subgraphs(subs, model.buckets, c.top_k).withColumn("bucket", F.lit(None).cast("string"))
    else:
        predicted = scoring.predict_buckets(subs, scoring.top_buckets(model.buckets, c.top_k))
    if c.cc_filter:
        # the largest component of each prediction; bucket and graph together name a prediction
        key = F.xxhash64("bucket", "graph_id")
        names = predicted.select(key.alias("p"), "bucket", "graph_id").distinct()
        inner = edges.join(names, "graph_id").select(F.col("p").alias("graph_id"), "src", "dst")
        kept = graphs.largest_component(inner, predicted.select(key.alias("graph_id"), "node"))
        predicted = kept.withColumnRenamed("graph_id", "p").join(names, "p").select("bucket", "graph_id", "node")
    return scoring.micro_jaccard(predicted, truth, ["bucket"]).orderBy(F.desc("jaccard"), "bucket")


def discover(edges: DataFrame, truth: DataFrame, c: Config, model: Model | None = None) -> tuple[Model, DataFrame]:
    """The model fitted on the first 80 % of the graphs, unless one is given, and its measures on the rest."""
    split = src.ordered_split(edges, n_graphs=c.n_graphs)
    part = lambda name, role: edges.filter(F.col("role") == role).join(split.filter(F.col("split") == name), "graph_id", "left_semi").select("graph_id", "src", "dst")
    train_pos, train_neg, test_pos = part("train", "pos"), part("train", "neg"), part("test", "pos")
    n = split.filter("split = 'train'").count()
    model = model or fit(embedded(train_pos, c), embedded(train_neg, c), c, n, n)
    held = truth.join(split.filter("split = 'test'"), "graph_id", "left_semi")
    return model, evaluate(embedded(test_pos, c), test_pos, held, model, c)


def _distorted(edges: DataFrame, truth: DataFrame, p: float, seed: int) -> DataFrame:
    """The edges with each pair inside a planted motif flipped with probability p."""
    pos = edges.filter("role = 'pos'")
    inside = pos.join(truth.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_semi").join(truth.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst")
    rest = pos.select("graph_id", "src", "dst").exceptAll(inside)
    changed = rest.union(generators.distort(inside, truth, p, seed)).select("graph_id", F.lit("pos").alias("role"), "src", "dst")
    return changed.unionByName(edges.filter("role <> 'pos'").select("graph_id", "role", "src", "dst"))


def generate(
    spark: SparkSession, shape: str = "barbell", n_graphs: int = 1000, parent: int = 20, p: float = 0.1, size: int = 10, distort: float = -1.0, seed: int = 42, max_degree: int = 25, rewired: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(edges by role, truth) of a synthetic collection with one planted motif a graph.

    Roles are pos and neg and, where ``rewired``, null, the planted graph with
    swapped edges. A graph counts when each of its roles is connected and has
    degrees below the bound; the others are made again from a new seed, until
    all are there or ROUNDS have passed.
    """
    motif = [(r.src, r.dst) for r in generators.motif_shape(spark, shape, size).collect()]
    n_motif = max(max(x) for x in motif) + 1
    missing, kept, truths = spark.range(n_graphs).toDF("graph_id"), None, None
    for step in range(ROUNDS):
        own = seed + 7919 * step
        parents = generators.connected_parents(spark, n_graphs, parent, p, own, max_degree, missing)
        edges, truth = generators.plant(parents, motif, n_motif, seed=own)
        edges = cut(edges)
        if rewired:
            null = generators.swap_null(edges.filter("role = 'pos'"), seed=own).select("graph_id", F.lit("null").alias("role"), "src", "dst")
            edges = cut(edges.unionByName(null))
        good = missing
        for role in ("pos", "neg", "null") if rewired else ("pos", "neg"):
            one = edges.filter(F.col("role") == role).select("graph_id", "src", "dst")
            nodes = graphs.nodes_of(one)
            good = good.join(generators.accepted(one, nodes, max_degree), "graph_id", "left_semi")
        good = cut(good)
        edges, truth = edges.join(good, "graph_id", "left_semi"), truth.join(good, "graph_id", "left_semi")
        kept, truths = (edges, truth) if kept is None else (kept.unionByName(edges), truths.unionByName(truth))
        missing = cut(missing.join(good, "graph_id", "left_anti"))
        if not missing.limit(1).count():
            return _distorted(kept, truths, distort, seed) if distort >= 0 else kept, truths
    raise ValueError(f"{missing.count()} of {n_graphs} graphs were not accepted in {ROUNDS} rounds: raise p or max_degree")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--save-model")
    parser.add_argument("--load-model")
    for f in fields(Config):
        flag = "--" + f.name.replace("_", "-")
        parser.add_argument(flag, action="store_true") if f.type == "bool" else parser.add_argument(flag, type={"int": int, "float": float}.get(f.type, str), default=f.default)
    args = vars(parser.parse_args(argv))
    data, save, load = args.pop("data"), args.pop("save_model"), args.pop("load_model")
    spark, config = SparkSession.builder.getOrCreate(), Config(**args)
    known = Model.load(spark, load, config.embed_mode != "canonical" and config.classifier() == "tree") if load else None
    model, measures = discover(spark.read.parquet(f"{data}/edges"), spark.read.parquet(f"{data}/truth"), config, known)
    if save:
        model.save(save)
    measures.show(truncate=False)


if __name__ == "__main__":
    main()
