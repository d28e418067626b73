"""Extension, not part of the engine's own scope: scatter aggregation over a stream, with late data held by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scatter_stream(stream: DataFrame, cell: list[str], value: str, time: str, window: str, late: str) -> DataFrame:
    """Sum, count, minimum and maximum a cell and time window of a streaming DataFrame; rows later than ``late`` are left out by the watermark."""
    s = stream.withWatermark(time, late)
    return s.groupBy(F.window(time, window), *cell).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
