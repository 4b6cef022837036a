"""Reads kept from a stream by a list of wanted ids, written once whatever restarts come between.

A list that is a table is looked up in each batch. A list that is itself a stream may come later than its reads: then reads
and ids wait for each other in state, for as long as the watermark allows, and a read is kept when its id has come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_name(line_id: str = "read_id"):
    """The id without the mark of its pair: "/1", "/2" or what follows a blank."""
    return F.regexp_replace(F.regexp_extract(line_id, r"^\S*", 0), r"/[12]$", "")


def kept_from_list(reads: DataFrame, wanted: DataFrame, key: str = "read_id") -> DataFrame:
    """The reads of a stream whose id is in a table."""
    return reads.join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def kept_when_wanted(reads: DataFrame, wanted: DataFrame, wait: str, key: str = "read_id", time: str = "ts", wanted_time: str = "ts") -> DataFrame:
    """The reads of a stream whose id comes in another stream at most ``wait`` before or after them, each once for each time
    that it comes itself.

    Both streams carry event times. State holds the reads and ids of that span behind the newer watermark, no more; an id that
    comes several times is one while the state knows it.
    """
    late = wanted.select(F.col(key).alias("__key"), F.col(wanted_time).alias("__time")).where("__key IS NOT NULL").withWatermark("__time", wait)
    own = reads.withWatermark(time, wait)
    near = (F.col(key) == F.col("__key")) & (F.col("__time") >= F.col(time) - F.expr(f"INTERVAL {wait}")) & (F.col("__time") <= F.col(time) + F.expr(f"INTERVAL {wait}"))
    return own.join(late, near, "left_semi")


def write_kept(kept: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write to Parquet files; the checkpoint and the files' log make each read come once over restarts.

    once: take what there is, then end. Both folders must be shared by driver and executors.
    """
    writer = kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
