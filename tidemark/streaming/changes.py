"""The change log as a stream, and event-time aggregates over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_stream(spark: SparkSession, root: str) -> DataFrame:
    """Changes as commits append them: a file stream over the log's folders."""
    return spark.readStream.schema("version long, table string, id long, kind string").parquet(f"{root.rstrip('/')}/changes/*")


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows; rows later than the watermark are left out by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")
