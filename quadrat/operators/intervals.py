"""Intervals, runs and running sums: gaps and islands by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(intervals: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: float = 0, closed: bool = False) -> DataFrame:
    """(by..., start, end): merged intervals. Half-open ones merge when they touch, closed ones when they are adjacent; gap allows more."""
    own = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) > reach + gap + (1 if closed else 0)).cast("int"), F.lit(1))
    marked = intervals.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def union_length(intervals: DataFrame, by: list[str], start: str = "start", end: str = "end", closed: bool = False) -> DataFrame:
    """(by..., covered): length that the intervals cover together."""
    one = 1 if closed else 0
    return islands(intervals, by, start, end, 0, closed).groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + one).alias("covered"))


def gaps(merged: DataFrame, by: list[str], lo: float, hi: float, least: float) -> DataFrame:
    """(by..., start, end): stretches of at least that length that no island covers, both ends included. Islands are half-open and lie in [lo, hi)."""
    own = Window.partitionBy(*by).orderBy("start")
    before = merged.select(*by, F.coalesce(F.lag("end").over(own), F.lit(lo)).alias("a"), F.col("start").alias("b"))
    after = merged.groupBy(*by).agg(F.max("end").alias("a")).withColumn("b", F.lit(hi))
    return before.unionByName(after).where(F.col("b") - F.col("a") >= least).select(*by, F.col("a").alias("start"), F.col("b").alias("end"))


def n50(lengths: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """(by..., n, total, n50): the length at which the sum from the longest down reaches half of all."""
    each = lengths.groupBy(*by, length).agg(F.count("*").alias("m"), F.sum(length).alias("sum"))
    own = Window.partitionBy(*by)
    run = F.sum("sum").over(own.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0))
    s = each.withColumn("run", run).withColumn("total", F.sum("sum").over(own))
    return s.groupBy(*by).agg(F.sum("m").alias("n"), F.max("total").alias("total"), F.max(F.when(F.col("run") >= F.col("total") / 2, F.col(length))).alias("n50"))


def low_runs(values: DataFrame, by: list[str], position: str, value: str, most: float) -> DataFrame:
    """(by..., start, end, n): runs of rows in a row, by position, with a value of at most that."""
    own = Window.partitionBy(*by).orderBy(position)
    at = values.withColumn("__at", F.row_number().over(own)).where(F.col(value) <= most)
    at = at.withColumn("__run", F.col("__at") - F.row_number().over(own))
    return at.groupBy(*by, "__run").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("n")).drop("__run")


def rolling_median(values: DataFrame, by: list[str], order: str, value: str, rows: int = 10) -> DataFrame:
    """Median of a row and those after it; null where fewer than ``rows`` are left."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(0, rows - 1)
    own = F.sort_array(F.collect_list(value).over(ahead))  # at most ``rows`` numbers
    return values.withColumn("rolling", F.when(F.size(own) == rows, (own[(rows - 1) // 2] + own[rows // 2]) / 2))


def smoothed(values: DataFrame, by: list[str], order: str, value: str, reach: int = 2) -> DataFrame:
    return values.withColumn("smooth", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)))


def local_maxima(values: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows over the one before and not under the one after."""
    own = Window.partitionBy(*by).orderBy(order)
    out = values.withColumn("__a", F.lag(value).over(own)).withColumn("__b", F.lead(value).over(own))
    return out.where((F.col("__a").isNull() | (F.col(value) > F.col("__a"))) & (F.col("__b").isNull() | (F.col(value) >= F.col("__b")))).drop("__a", "__b")


def histogram_quantile(bins: DataFrame, by: list[str], position: str, count: str, share: float) -> DataFrame:
    """(by..., at): first bin at which the counts reach that share of their total."""
    own = Window.partitionBy(*by)
    run = F.sum(count).over(own.orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    s = bins.withColumn("__run", run).withColumn("__all", F.sum(count).over(own))
    return s.where(F.col("__run") >= share * F.col("__all")).groupBy(*by).agg(F.min(position).alias("at"))


def keep_at_least(bins: DataFrame, by: list[str], position: str, count: str, share: float) -> DataFrame:
    """(by..., at): largest position that at least that share of all counts reaches (sum from the position upwards)."""
    own = Window.partitionBy(*by)
    rest = F.sum(count).over(own.orderBy(position).rowsBetween(0, Window.unboundedFollowing))
    s = bins.withColumn("__rest", rest).withColumn("__all", F.sum(count).over(own))
    return s.where(F.col("__rest") >= share * F.col("__all")).groupBy(*by).agg(F.max(position).alias("at"))


def until_total(rows: DataFrame, by: list[str], order: list, value: str, target: float) -> DataFrame:
    """Rows in order up to and with the one at which the running sum reaches the target."""
    run = F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", run).where(F.col("running") - F.col(value) < target)


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that depend on their keys and the seed alone: those of the smallest MD5 of both."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(n)
