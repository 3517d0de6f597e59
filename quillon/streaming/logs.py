"""Windowed summaries of a growing log. The same function serves a stream and a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(rows: DataFrame, time: str, keys: list[str], value: str, width: str, lateness: str) -> DataFrame:
    """(start, keys, n, total, best) by tumbling windows; on a stream, rows later than the watermark are left out and a
    window is given out once the watermark has passed it. Null times belong to no window."""
    w = F.window(time, width)
    found = rows.withWatermark(time, lateness).groupBy(w.alias("_w"), *keys) if rows.isStreaming else rows.filter(F.col(time).isNotNull()).groupBy(w.alias("_w"), *keys)
    return found.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("best")).select(F.col("_w.start").alias("start"), *keys, "n", "total", "best")


def follow(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, time: str, keys: list[str], value: str, width: str, lateness: str) -> None:
    """Takes in all Parquet files that have come since the last call and appends the windows that are closed by now. The
    checkpoint holds the open windows and which files are done, so a call after a stop neither loses nor repeats any."""
    rows = spark.readStream.schema(schema).parquet(folder)
    query = windowed(rows, time, keys, value, width, lateness).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
