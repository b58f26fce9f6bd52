"""Writes a synthetic collection with planted motifs, as the discovery plan reads it.

    python -m lacewing.plans.generate --out DIR --motif-type barbell --n-graphs 1000
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.generators import SHAPES
from . import discovery


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--out", required=True)
    parser.add_argument("--motif-type", choices=SHAPES, default="barbell")
    parser.add_argument("--motif-size", type=int, default=10)
    parser.add_argument("--parent-size", type=int, default=20)
    parser.add_argument("--parent-p", type=float, default=0.1)
    parser.add_argument("--n-graphs", type=int, default=1000)
    parser.add_argument("--distort", type=float, default=-1.0)
    parser.add_argument("--max-degree", type=int, default=25)
    parser.add_argument("--rewired", action="store_true")
    parser.add_argument("--seed", type=int, default=42)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    edges, truth = discovery.generate(spark, a.motif_type, a.n_graphs, a.parent_size, a.parent_p, a.motif_size, a.distort, a.seed, a.max_degree, a.rewired)
    edges.write.mode("overwrite").parquet(f"{a.out}/edges")
    truth.write.mode("overwrite").parquet(f"{a.out}/truth")


if __name__ == "__main__":
    main()
