"""Helpers that the text operators share: reading tables, staging results, sizes and digests."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import site
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's readers open the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one serves a local
    session (tests); on a cluster that is an error, since each machine would write into its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local") or not found and spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='cadenza-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Staged:
    """Tables written to the shared folder: they cut lineage, outlive executors and are computed once.

    ``drop()`` deletes what nothing reads any more; ``keep()`` leaves the rest until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        # What a staged table was made from needs no shuffle files any more once it is written.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        self.spark, self.root, self.n, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            if df is not None and id(df) in self.paths:
                remove(self.spark, self.paths.pop(id(df))[0])

    def keep(self, df: DataFrame) -> DataFrame:
        """The tables that are left stay as long as the application, since any DataFrame made from df reads them."""
        self.paths.clear()
        # Plans that Python no longer needs are freed in the driver's JVM too, with their classes; else they fill its memory.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        atexit.register(_remove_quietly, self.spark, self.root)
        return df


def _remove_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; the shared folder's owner then cleans it
        remove(spark, path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, unless their search path has it already."""
    root = Path(__file__).resolve().parents[2]
    found = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), *site.getsitepackages()]
    if any(p and Path(p).resolve() == root for p in found) or getattr(spark.sparkContext, "_cadenza_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="cadenza-")
    with zipfile.ZipFile(f"{folder}/cadenza.zip", "w") as z:
        for f in (root / "cadenza").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(f"{folder}/cadenza.zip")
    spark.sparkContext._cadenza_sent = True


def bounded_batches(spark: SparkSession, records: int = 2000, mb: int = 4) -> None:
    """Holds Arrow batches to so many rows and bytes, so that long texts can't fill a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def fresh(df: DataFrame, n: int) -> list[str]:
    """So many column names that df does not have, whatever its columns are called."""
    used, k = [c.lower() for c in df.columns], 0
    while any(c.startswith(f"added{k}_") for c in used):
        k += 1
    return [f"added{k}_{i}" for i in range(n)]


def crc32_text(column) -> F.Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, however large the group: rows are dealt by a hash of the order
    columns into salted parts, numbered there, and moved up by the counts of the parts before."""
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(partitions(df.sparkSession))).cast("int"))
    keys = [*groups, "_salt"]
    counts = salted.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = salted.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    on = [numbered[k].eqNullSafe(counts[f"_{k}"]) for k in keys]
    joined = numbered.join(counts, on)
    return joined.withColumn(name, (F.col("_row") - 1 + F.col("_before")).cast("long")).drop(*[f"_{k}" for k in keys], "_salt", "_row", "_before")


def make_dir(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
