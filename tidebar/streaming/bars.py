"""Bars from a stream of ticks: event-time windows with a watermark. An extension beyond the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """symbol, ts, OHLCV of (symbol, ts TIMESTAMP, price, volume); a bar is final once the watermark passes its end."""
    w = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width).alias("w"))
    return w.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
