"""Written tables in the cluster's shared folder, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent the context's own checkpoint folder is used.
    Failing that, a new one is made and set if all of Spark runs in this process
    (tests on one machine); on a cluster no other machine could see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lacewing-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, under one shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lacewing/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` as Parquet and return the reread table: no lineage behind it."""
        where = self.path(tag)
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        self.paths[tag] = where
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *tags: str) -> None:
        """Delete tables that nothing unfinished reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for tag in tags:
            where = jvm.org.apache.hadoop.fs.Path(self.path(tag))
            where.getFileSystem(conf).delete(where, True)
            self.paths.pop(tag, None)

    def drop_all_but(self, *tags: str) -> None:
        """Delete every table written so far but these, which the result still reads."""
        self.drop(*[t for t in self.paths if t not in tags])
