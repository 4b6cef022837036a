"""Places and small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The scratch lists that are open in this thread; another thread has its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary one; on a cluster each executor would write to its own disk, so
    that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.quadrat.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quadrat-")
        spark.conf.set("spark.quadrat.scratch", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/quadrat/{name}-{uuid.uuid4().hex}"
    for paths in _open.get():
        paths.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written table that no result reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Drops on leaving whatever ``fresh_path`` names inside, in this thread. Take a path out of the list to keep it."""
    paths: list[str] = []
    before = _open.get()
    _open.set((*before, paths))
    try:
        yield paths
    finally:
        _open.set(before)
        for path in paths:
            drop_path(spark, path)


def finished(spark: SparkSession, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """What made gives, written to the shared folder, without the tables that were written on the way."""
    with scratch(spark) as paths:
        out, path = settled(made(), name)
        paths.remove(path)
    return out


def settled(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame written to the shared folder and read again: a cut of the lineage that outlives any executor.

    The shuffle files behind it aren't needed any more, so Spark is told to delete them when the write is done.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def unused(name: str, columns: list[str]) -> str:
    """A column name like that, which none of the columns has in any spelling."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(c: str | Column = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
