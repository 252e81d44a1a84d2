"""Intermediate tables in the folder that the cluster shares, so that a lost executor costs a reread and no recompute."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset and driver and executors are one machine (tests) a
    new temporary one; on a cluster the executors' files would be lost there, so that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stratakv-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that no later plan reads, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside go once it has run. Else they stay until the driver happens to collect its
    garbage, so that many steps' files lie on the disks at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Table:
    """A DataFrame cut from its lineage by a written table; drop() frees the disk once nothing reads it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_folder(self.spark, name)
        with freeing_shuffles(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_folder(self.spark, self.path)


class Scratch:
    """Tables that only the work at hand reads; drop() frees them all."""

    def __init__(self):
        self.held: list[Table] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(Table(df, name))
        return self.held[-1].df

    def drop(self) -> None:
        while self.held:
            self.held.pop().drop()


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application: for the end of a job, as results that weren't written yet may
    read them."""
    drop_folder(spark, f"{shared_root(spark)}/{spark.sparkContext.applicationId}")


#: What all operators ask of a session. It is one set, so a plan that runs late finds what it was made for.
SETTINGS = {
    # bounds what Arrow hands to a Python worker at once, whatever the length of the texts
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # lets Spark drop texts that a join won't need before it moves them, by its own Bloom filters of bounded size
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def prepare(spark: SparkSession) -> None:
    """Sets SETTINGS for the session; they stay, since the operators' results are run by the caller."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
