"""Rank counters over a stream: hits per window of event time, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_hits(events: DataFrame, *, time: str = "ts", hit: str = "hit", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n, hits, recall) for each window of a stream (or a table) of events with a boolean `hit`."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # what a watermark takes
    counted = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("int")).alias("hits"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("recall"))
