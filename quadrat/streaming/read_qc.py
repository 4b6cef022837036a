"""Read quality over arriving chunk files: the histograms of operators.reads are sums, so they can be kept by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.reads import histogram, read_table


def running_histogram(reads: DataFrame, value: str = "mean_q", width: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Histogram of all reads so far; for output modes complete and update."""
    return histogram(read_table(reads), by or ["file"], value, width)


def windowed_counts(events: DataFrame, time: str, late: str, size: str, key: str, value: str) -> DataFrame:
    """(start, key, n, total) by time window; rows later than ``late`` behind the newest are dropped, so state stays bounded."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
