"""Graph classification: features of sampled subgraphs and a random forest over folds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from . import vectors


def bucket_vocabulary(train: DataFrame) -> DataFrame:
    """bucket, idx: the buckets of the training graphs, numbered from 0 in order."""
    seen = train.select("bucket").distinct()
    # one row a bucket; hash planes bound their number
    from pyspark.sql import Window

    return seen.withColumn("idx", F.dense_rank().over(Window.orderBy("bucket")) - 1)


def graph_features(subs: DataFrame, vocabulary: DataFrame, dim: int, n_buckets: int) -> DataFrame:
    """graph_id, x: the mean vector of a graph's subgraphs, and its count in each known bucket."""
    mean = subs.select("graph_id", F.posexplode("vec").alias("pos", "v")).groupBy("graph_id", "pos").agg(F.avg("v").alias("m"))
    mean = mean.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("pool"))
    counts = subs.join(vocabulary, "bucket").groupBy("graph_id", "idx").agg(F.count("*").cast("double").alias("n"))
    counts = counts.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "n"))).alias("m"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(max(0, n_buckets - 1))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    joined = mean.join(counts, "graph_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,double>")))
    return joined.select("graph_id", F.concat("pool", hist).alias("x"))


def cross_validate(features: DataFrame, folds: DataFrame, n_folds: int, trees: int = 500, depth: int = 8) -> DataFrame:
    """fold, accuracy of a random forest trained on the other folds."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = features.join(folds, "graph_id").select("graph_id", "fold", F.col("class").cast("double").alias("y"), array_to_vector("x").alias("features")).cache()
    out = []
    for k in range(n_folds):
        model = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=42).fit(data.filter(F.col("fold") != k))
        got = model.transform(data.filter(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
        out.append((k, None if got is None or math.isnan(got) else float(got)))
    data.unpersist()
    return features.sparkSession.createDataFrame(out, "fold int, accuracy double")


def _coded(rows: DataFrame, planes: list[np.ndarray]) -> DataFrame:
    """Adds c0, c1, ...: ``vectors.simhash`` of z under each of the planes; a batch meets all planes at once, and components are added up in order."""
    own = rows.select(*[c for c in rows.columns if c != "z"], "z")
    every = np.vstack(planes).T

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(every))
            total = np.zeros((len(z), every.shape[1]))
            for j, weights in enumerate(every):
                total += z[:, j, None] * weights
            bits, at, codes = np.where(total > 0, b"1", b"0"), 0, []
            for p in planes:
                part = np.ascontiguousarray(bits[:, at : at + len(p)])
                codes.append(pa.array(part.view(f"S{len(p)}")[:, 0].astype(str)))
                at += len(p)
            yield pa.RecordBatch.from_arrays([*b.columns, *codes], names=[*b.schema.names, *[f"c{f}" for f in range(len(planes))]])

    return own.mapInArrow(code, T.StructType([*own.schema.fields, *[T.StructField(f"c{f}", T.StringType()) for f in range(len(planes))]]))


def fold_codes(rows: DataFrame, folds: DataFrame, n_folds: int, dim: int, hash_dim: int) -> DataFrame:
    """graph_id, fold, class, pool and, for each fold f, buckets_f: a graph's mean vector and its sets' buckets under f's planes.

    ``rows`` has graph_id and vec, one for each sampled set; ``folds`` has
    graph_id, fold and class. The planes of a fold come from the other folds'
    rows alone, class 1 against class 0; one pass of moments serves all folds,
    and one more codes each row once a fold.
    """
    known = cut(rows.join(folds.select("graph_id", "fold", "class"), "graph_id").select("graph_id", "fold", "class", F.col("vec").cast("array<double>").alias("z")))
    role = F.when(F.col("class") == 1, "pos").when(F.col("class") == 0, "neg").alias("role")
    planes = vectors.planes_by_fold(known.select("fold", role, "z"), dim, hash_dim)
    none = np.zeros((hash_dim, dim))
    mean = F.array(*[F.avg(F.get("z", F.lit(i))) for i in range(dim)]).alias("pool")
    coded = _coded(known, [planes.get(f, none) for f in range(n_folds)])
    return coded.groupBy("graph_id", "fold", "class").agg(mean, *[F.sort_array(F.collect_list(f"c{f}")).alias(f"buckets_{f}") for f in range(n_folds)])


def fold_vocabulary(codes: DataFrame, fold: int):
    """A model that counts the buckets of a fold's training graphs; others have no place in it."""
    from pyspark.ml.feature import CountVectorizer

    return CountVectorizer(inputCol=f"buckets_{fold}", outputCol="hist", vocabSize=1 << 18, minDF=1.0).fit(codes.filter(F.col("fold") != fold))


def validate_folds(codes: DataFrame, n_folds: int, trees: int = 500, depth: int = 8, parallel: int = 4) -> DataFrame:
    """fold, accuracy, vocabulary: of a random forest on pooled vector and bucket counts, trained on the other folds.

    Vocabulary and forest of a fold see its training graphs only; folds are
    fitted ``parallel`` at a time.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    codes = cut(codes)

    def one(fold: int) -> tuple[int, float | None, int]:
        counter = fold_vocabulary(codes, fold)
        data = counter.transform(codes.withColumn("pooled", array_to_vector("pool")))
        data = VectorAssembler(inputCols=["pooled", "hist"], outputCol="features").transform(data).select("fold", F.col("class").cast("double").alias("y"), "features")
        model = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=42, cacheNodeIds=True).fit(data.filter(F.col("fold") != fold))
        got = model.transform(data.filter(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
        return fold, None if got is None or math.isnan(got) else float(got), len(counter.vocabulary)

    with ThreadPool(parallel) as pool:
        out = pool.map(one, range(n_folds))
    return codes.sparkSession.createDataFrame(out, "fold int, accuracy double, vocabulary int")


def level_embeddings(levels: list[DataFrame]) -> DataFrame:
    """graph_id, x: sums of the node vectors (graph_id, vec) of each level, one after the other; shallow graphs drop out."""
    out = None
    for df in levels:
        s = df.select("graph_id", F.posexplode("vec").alias("pos", "v")).groupBy("graph_id", "pos").agg(F.sum("v").alias("s"))
        s = s.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("x"))
        out = s if out is None else out.join(s.withColumnRenamed("x", "y"), "graph_id").select("graph_id", F.concat("x", "y").alias("x"))
    return out
