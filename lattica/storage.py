"""Where jobs keep intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where it is unset, a session on one machine (master ``local[...]``) gets an own temporary folder; on a cluster
    that is an error, as executors would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here and outlives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job, each dropped once a later one of the same name is written, or by ``drop``.

    What a lazy result still reads must be left: nothing is dropped by itself at the end.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark, self.root, self.paths, self.n = spark, fresh_path(spark, job), {}, 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df`` written and read back; then the table that had this name goes."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
