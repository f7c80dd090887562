"""Structured Streaming: the same aggregates as in batch, kept up to date over arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators.graph import ensure_checkpoints


def events(spark: SparkSession, sf_dir: str, late: str = "1 day") -> DataFrame:
    """The events table as a stream of files, with a watermark on its time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(stream: DataFrame, size: str = "1 hour") -> DataFrame:
    counts = stream.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def running_moments(stream: DataFrame) -> DataFrame:
    """Count, mean and population variance of each type: mergeable sufficient statistics."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def sliding_counts(stream: DataFrame, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    counts = stream.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", who: str = "user_id") -> DataFrame:
    """Runs of a user's events without a gap: start, end and number."""
    runs = stream.groupBy(F.session_window("ts", gap).alias("w"), who).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return runs.select(who, F.col("w.start").alias("first"), "last", "n")


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream until its input is used up; its result table.

    Batches and the query's state go to the shared folder, so executors that are lost cost a batch
    and no result passes through the driver. In complete mode the last batch is the result.
    """
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{path}/out/{n}" for n in (done[-1:] if mode == "complete" else done)))
