"""Intermediate tables: where long jobs cut their lineage.

An operator that reads one of its own results more than once writes it as Parquet under the folder that the cluster
names in ``spark.checkpoint.dir`` and reads it back.  All executors share that folder, so the loss of an executor costs
the tasks that ran on it and nothing else.

A result that is a DataFrame still reads its tables when it is used, so they stay until the caller is done: ``clear``
deletes all tables of this application.  Call it when the results have been written or collected.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='spark-papyra-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """A folder of intermediate tables of one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/papyra/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back.  The shuffle files of the write are removed once it is done."""
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def fresh(self, df: DataFrame, label: str) -> DataFrame:
        """A table under a name of its own, for what an operator makes once for each call."""
        return self.table(df, f"{label}-{uuid.uuid4().hex[:12]}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(hadoop).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/papyra/{spark.sparkContext.applicationId}")
    path.getFileSystem(hadoop).delete(path, True)
