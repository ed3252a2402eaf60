"""Results of steps as tables in the folder that driver and executors share: computed once, read by each later step with the
columns that it needs, and there if an executor is lost."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    found = f"file://{tempfile.mkdtemp(prefix='cadenza-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def path_of(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    fs, target = path_of(spark, path)
    fs.delete(target, True)


#: Whether the shuffle files of a statement go with its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """Writes one step after another; those that aren't dropped go when the application ends, since any later plan may read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0, {}
        atexit.register(_quietly, spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        """df as a table; the shuffle files that it was made from go, since nothing reads them again."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes what no later plan reads."""
        for df in dfs:
            if id(df) in self.paths:
                delete(self.spark, self.paths.pop(id(df))[0])


def _quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        delete(spark, path)
