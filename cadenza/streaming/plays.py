"""Plays as a stream: windowed counts with late data, and an upserted roll-up per user and track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profiles import upsert
from ..sources.buckets import Buckets


def play_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Events of a folder of Parquet files as they arrive."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Plays and users by window and kind; rows that come later than `late` after the newest are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("plays"), F.approx_count_distinct("user_id").alias("users"))


def rollup(batch: DataFrame) -> DataFrame:
    """(user_id, source, track_id, played_at, interaction_count) of a batch of events."""
    track = (F.get_json_object("props", "$.k").cast("long") + 1).alias("track_id")
    return batch.select("user_id", F.lit("recent").alias("source"), track, F.col("ts").alias("played_at")).groupBy("user_id", "source", "track_id").agg(F.max("played_at").alias("played_at"), F.count("*").alias("interaction_count"))


def upserting(events: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merges each batch into a table in buckets by user; only the buckets of the batch's users are written anew, and a batch that
    runs again after a failure changes nothing twice. read with Buckets(spark, target, ["user_id"]).read()."""

    def merge(batch: DataFrame, epoch: int) -> None:
        Buckets(batch.sparkSession, target, ["user_id"], buckets).merge(rollup(batch), upsert, epoch)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
