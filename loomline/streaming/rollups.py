"""Streams: windowed rollups of events with late data, first rows by key, and Parquet sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import buckets


def table_stream(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """A stream of the Parquet files that come to a folder, at most so many a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def event_rollup(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): events of each window; rows later than `late` are dropped from open state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rolled = timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rolled.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def first_of_key(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key that comes within `late`."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def write_all(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there to Parquet and end; a later call goes on where this one ended."""
    return rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reprocess(documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "doc_id", count: int = buckets.BUCKETS) -> StreamingQuery:
    """Drain a stream of documents into a table of their chunks, each batch in place of what its documents had before, and end.

    The table is in buckets of the documents' hash: a batch rewrites the buckets that it changes, and one that is tried again changes nothing. chunk gives (key, ...) rows of documents;
    of a document that comes twice in a batch the greater row counts."""

    def put(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct("*"), F.struct([F.col(c) for c in batch.columns if c != key])).alias("_r")).select("_r.*")
        buckets.merge(path, batch.select(key), chunk(latest), key, count)

    return documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table that reprocess writes; None if there is none."""
    return buckets.current(spark, path)


def rolling_rollup(events: DataFrame, span: str = "1 hour", step: str = "5 minutes", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, mean): the last hour at every step, by event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rolled = timed.groupBy(F.window("ts", span, step), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rolled.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean")
