"""Structured Streaming forms of the batch operators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(events: DataFrame, time: str, by: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of an event stream by time window; rows later than ``late`` behind the newest do not count.
    On a batch table it gives the same rows."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def current_cells(ops: DataFrame) -> DataFrame:
    """The last write of each cell of a stream of journal operations (complete or update mode)."""
    return ops.filter("not undone").groupBy("sheet", "row", "col").agg(F.max_by("value", F.struct("revision", "seq")).alias("value"))
