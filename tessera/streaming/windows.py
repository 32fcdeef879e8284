"""Frames of a stream: sliding windows of event time with pooled statistics, and running statistics per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pooling import _statistic


def pooled_windows(
    stream: DataFrame, time: str, columns: Sequence[str], length: str, hop: str, late: str = "10 minutes", keys: Sequence[str] = (), statistics: Sequence[str] = ("mean", "std", "min", "max")
) -> DataFrame:
    """Statistics per key and window of ``length`` every ``hop``; rows later than ``late`` are left out when it is a stream."""
    made = [_statistic(s, c).alias(f"{s}_{c}") for s in statistics for c in columns]
    d = stream.withWatermark(time, late) if stream.isStreaming else stream
    d = d.groupBy(F.window(time, length, hop), *keys).agg(F.count(F.lit(1)).alias("n"), *made)
    return d.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", *[f"{s}_{c}" for s in statistics for c in columns])
