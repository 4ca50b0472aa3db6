"""Tables written to the folder that all executors share.

Writing a table cuts the lineage in a way that survives the loss of executors,
and gives the optimizer its true size when it is read back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop_path(spark, path)
    return fs.exists(target)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the session names one. A local session gets
    a temporary folder; a cluster without the setting is an error, since no
    folder on one machine would be seen by the others."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="revlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Names and writes intermediate tables under one fresh folder, which is
    removed when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/revlens-{uuid.uuid4().hex}"
        target, fs = hadoop_path(spark, self.root)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        self._written: dict[int, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        where = self.path(name)
        df.write.partitionBy(*partition_by).parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._written[id(out)] = where
        return out

    def path_of(self, table: DataFrame) -> str:
        """Where a table of this folder lies."""
        return self._written[id(table)]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this folder that nothing reads any more."""
        for df in tables:
            where = self._written.pop(id(df), None)
            if where:
                path, fs = hadoop_path(self.spark, where)
                fs.delete(path, True)
