"""Streaming: incremental ingest of section files and windowed counts of actions.

The batch operators apply to each micro-batch; state is kept by Spark with a watermark, so
late rows are bounded and state is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def action_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Actions per window and kind, from a stream (or a table) of events with ts and event_type."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "event_type", "n", "total")


def first_sightings(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once within the watermark (first wins), for a stream or a table."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append each micro-batch's rows, one per key, to a Parquet table; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def section_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of section files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("multiLine", "true").json(path)
