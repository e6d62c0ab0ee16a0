"""Deliveries as a stream: an optional front end to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_deliveries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def counts_by_window(stream: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, keys, n) of rows by their own time; rows later than the watermark are left out. Also works on a batch."""
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
