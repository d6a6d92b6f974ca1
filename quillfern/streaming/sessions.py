"""Sessions by inactivity gap, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "6 hours", watermark: str = "1 day") -> DataFrame:
    """user_id, start_us, end_us, n: events of a user at most gap apart; on a stream, late events are dropped by the watermark."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", watermark)
    found = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet files of a folder, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
