"""Incremental ingestion and windows over events, by Structured Streaming.

A run takes what is new and ends (``availableNow``); the checkpoint remembers which files are done, so a
run that was cut off goes on where it stopped and a finished one is not repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, files: int = 1000) -> int:
    """Append what is new below ``source`` to the table ``target``; gives the number of rows that came in."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def upsert_stream(spark: SparkSession, source: str, schema: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Hand each micro-batch to ``apply``, which writes it; batch numbers make a repeat harmless."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` of each window; with ``late``, streams drop what comes later than that."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """``user_id, start, n`` of each session."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
