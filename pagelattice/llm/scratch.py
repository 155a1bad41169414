"""Shared working folders.

Every intermediate that must outlive an executor is a Parquet table (or file) in
the folder the cluster names in ``spark.checkpoint.dir``; executors and the
driver both reach it.  Only where the setting is absent and all runs in one process
(``local`` masters, as in tests) a temporary folder is made and set; on a cluster the setting is
required.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pagelattice-")
        spark.conf.set("spark.checkpoint.dir", base)
        _drop_at_exit(spark, base)
    return base.rstrip("/")


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has the file system that holds the folder delete it when the driver's JVM ends, whatever store that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


class Scratch:
    """One folder for the intermediates of one call of an operator.

    The folder stays until the session ends, since the DataFrames handed back
    read from it lazily; ``drop`` removes it before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_base(spark)}/pagelattice-{name}-{uuid.uuid4().hex}"
        self._fs().mkdirs(self._where())
        _drop_at_exit(spark, self.path)
        self._n = 0

    def _where(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self):
        return self._where().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        """Deletes the folder; nothing that reads from it may be used any more."""
        self._fs().delete(self._where(), True)

    def table(self, df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
        """Writes df and reads it back, which cuts its lineage durably."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        writer = df.write
        if codec:
            writer = writer.option("compression", codec)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"
