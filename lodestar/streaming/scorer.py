"""An incremental scorer: counts of streamed answers by event-time window, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _aged(events: DataFrame, late: str) -> DataFrame:
    """Streamed events get a watermark; their times need a zone, that of the session."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, event_type, n, total) of batch or streamed events with ts, event_type, value."""
    aged = _aged(events, late)
    grouped = aged.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session start, n) of sessions that end after a gap."""
    aged = _aged(events, late)
    grouped = aged.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("session_start"), "n")


def follow(spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str, window: str = "1 hour", late: str = "10 minutes") -> None:
    """Score what is new in a folder of Parquet files and stop; rows already seen aren't read again."""
    stream = spark.readStream.schema(schema).parquet(folder)
    out = windowed(stream, window, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out.format("parquet").option("path", sink).start().awaitTermination()
