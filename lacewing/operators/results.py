"""The layer that summarises experiments: grids, best rows, controls, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def still_to_do(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def mean_std(runs: DataFrame, by: list[str], value: str, sample: bool = False) -> DataFrame:
    """by..., mean and standard deviation (of the population unless ``sample``), nulls left out."""
    return runs.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp if sample else F.stddev_pop)(value).alias("std"))


def best_rows(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row a group, the first in the order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def against_control(rows: DataFrame, keys: list[str], flag: str, value: str) -> DataFrame:
    """Rows without the flag beside the value of the flagged row of the same keys, 0 where there is none."""
    control = rows.filter(flag).groupBy(*keys).agg(F.max(value).alias("control"))
    return rows.filter(f"not {flag}").join(control, keys, "left").withColumn("control", F.coalesce("control", F.lit(0.0)))


def last_rows_std(rows: DataFrame, by: list[str], order: str, value: str, n: int = 50) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).groupBy(*by).agg(F.stddev_samp(value).alias("std"))


def pivoted(rows: DataFrame, by: list[str], name: str, values: list, value: str) -> DataFrame:
    return rows.groupBy(*by).pivot(name, values).agg(F.first(value))


def plus_minus(mean: Column, std: Column) -> Column:
    return F.format_string("%.3f ± %.3f", mean, std)


def without_distortion(name: Column) -> Column:
    """A dataset's name without its '-d0.05' part."""
    return F.regexp_replace(name, r"-d[0-9.]+", "")


def motif_count(name: Column) -> Column:
    """The number of motifs in a dataset's name, its '-n3' part; 1 without one."""
    found = F.regexp_extract(name, r"-n([0-9]+)", 1)
    return F.when(found == "", 1).otherwise(found.cast("int"))


def from_key_values(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Rows of key and value, one table row a group: each key becomes a column."""
    return pivoted(rows, by, "key", keys, "value")


def heat_map(rows: DataFrame, names: list[str], value: str) -> DataFrame:
    """train against test: a row a training set, a column a test set, the value's mean; null where there is no run."""
    return rows.groupBy("train").pivot("test", names).agg(F.avg(value))


def by_kept(rows: DataFrame, k: str, value: str) -> DataFrame:
    """The ablation's curve: mean and population deviation of the value for each number of kept subgraphs."""
    return mean_std(rows, [k], value)


def latex(rows: DataFrame) -> str:
    """A small result as the body of a LaTeX table."""
    escape = lambda x: str(x).replace("_", r"\_").replace("%", r"\%").replace("±", r"$\pm$")
    lines = [" & ".join(map(escape, r)) + r" \\" for r in [rows.columns, *rows.collect()]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", *lines, r"\end{tabular}"])


class StopController:
    """Says when a fit has not improved for ``patience`` rounds; a loss that is not a number is no improvement."""

    def __init__(self, patience: int = 10):
        self.patience, self.best, self.best_round, self.round = patience, float("inf"), -1, -1

    def step(self, loss: float) -> bool:
        self.round += 1
        if loss < self.best:
            self.best, self.best_round = loss, self.round
        return self.round - max(self.best_round, 0) >= self.patience


def markdown(rows: DataFrame) -> str:
    """A small result as a text table."""
    got = rows.collect()
    head = rows.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(str(x) for x in r) + " |" for r in got])


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))


def argmax_class(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
