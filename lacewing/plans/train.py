"""Train the edge scorer on a stored collection, or go on with a saved run.

    python -m lacewing.plans.train --data DIR --model MODEL --epochs 200

DIR holds ``edges`` (graph_id, role, src, dst), as ``python -m
lacewing.plans.generate --out DIR`` writes them; roles are pos and neg. MODEL
gets a folder an epoch; a run that is there already is continued. The last
fifth of the graphs is held out and says when a phase stops.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, training
from ..sources import collections as src


def main(argv: list[str] | None = None) -> training.Run:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--model", required=True)
    parser.add_argument("--merge-method", choices=["sum", "cat"], default="sum")
    for name, default in (("steps", 5), ("dim", 32), ("n-features", 16), ("epochs", 200), ("steps-an-epoch", 1), ("batch-size", 16), ("n-neighbors", 30), ("stop-epochs", 30), ("seed", 0)):
        parser.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("rate", 1e-3), ("beta", 1.0), ("lam", 1.0)):
        parser.add_argument(f"--{name}", type=float, default=default)
    parser.add_argument("--restart", action="store_true", help="go on with the run saved under MODEL")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    edges = spark.read.parquet(f"{a.data}/edges")
    split = src.ordered_split(edges)
    part = lambda name, role: edges.filter(F.col("role") == role).join(split.filter(F.col("split") == name), "graph_id", "left_semi").select("graph_id", "src", "dst")

    def features(e):
        return graphs.one_hot(graphs.degrees(e).select("graph_id", "node", F.least(F.col("deg") - 1, F.lit(a.n_features - 1)).alias("label")), a.n_features)

    pos, neg, held = part("train", "pos"), part("train", "neg"), part("test", "pos")
    run = training.Run.load(a.model, spark) if a.restart else training.Run(training.Scorer(a.n_features, a.dim, a.steps, a.merge_method), training.Adam(a.rate), a.stop_epochs)
    options = dict(batch_size=a.batch_size, k=a.n_neighbors, beta=a.beta, lam=a.lam, seed=a.seed)
    training.train(run, pos, neg, features(pos), features(neg), a.epochs, a.steps_an_epoch, (held, features(held)), a.model, **options)
    for epoch, phase, loss, test in run.history:
        print(f"{epoch} {phase} train {loss:.6f} held out {test:.6f}")
    return run


if __name__ == "__main__":
    main()
