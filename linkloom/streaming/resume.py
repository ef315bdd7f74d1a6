"""Runs over a growing folder that go on where the last one ended.

A run takes what is new in the source, leaves out rows whose key was handled before (in an earlier run, too), does its work and adds
the results to a folder. Offsets, the keys seen and the files of each batch are kept in the state folder, so a run that breaks off
is taken up at the batch it was in: no row is left out and none is written twice. With a time column, keys are forgotten once the
watermark has passed them, so the state stays as large as `late` allows, and rows that come later than that are dropped; without
one all keys are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def unseen(rows: DataFrame, key: list[str], *, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The rows of a stream whose key comes for the first time."""
    if time is None:
        return rows.dropDuplicates(key)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def resume(rows: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame], out: str, state: str, *, time: str | None = None, late: str = "1 day") -> None:
    """Handle all that is there now and end. `work` maps the new rows of a stream, row by row."""
    writer = work(unseen(rows, key, time=time, late=late)).writeStream.format("parquet").outputMode("append")
    query = writer.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
