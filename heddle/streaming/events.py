"""Streams of events: windows with watermarks, idempotent queues and leases, on file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 100) -> DataFrame:
    """The event files of a folder as a stream; ts as an event time."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def enqueued(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: repeated requests enqueue no second job."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def expired_leases(jobs: DataFrame, now: F.Column, max_attempts: int = 3) -> DataFrame:
    """Running jobs (lease_until, attempts) whose lease is over: back to PENDING, or FAILED once attempts are used up."""
    rows = jobs.where((F.col("state") == "RUNNING") & (F.col("lease_until") < now))
    return rows.withColumn("state", F.when(F.col("attempts") >= max_attempts, "FAILED").otherwise("PENDING"))


def to_table(rows: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs what is there and ends; into an in-memory table, for small results and tests."""
    return rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_folder(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch written under its number: a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
