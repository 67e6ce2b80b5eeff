"""Streaming forms: bars from ticks with a watermark, and the same plan over a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Bars of (event_type, window) from ticks(ts, event_type, value, event_id).

    On a stream, late is the watermark: a bar is final once that much time has passed its end, and
    state for it is dropped. On a table the watermark has no effect."""
    rows = ticks.withWatermark("ts", late) if late and ticks.isStreaming else ticks
    key = F.struct("ts", "event_id")
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume")
    ).select(F.col("w.start").alias("bar_start"), F.col("event_type").alias("ticker"), "open", "high", "low", "close", "volume")


def read_ticks(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
