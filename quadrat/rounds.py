"""Tables of iterative work: each round's frame is written to the shared folder and read again.

That cuts the lineage, and outlives any executor. The folder is spark.checkpoint.dir; a local session without one gets a
temporary folder, and a cluster without one is an error, as its machines share no local folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.quadrat.rounds", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quadrat-")
        spark.conf.set("spark.quadrat.rounds", root)
    return root.rstrip("/")


class Rounds:
    """Written tables of one computation: ``rounds(df)`` writes and reads; ``keep`` drops all but the frames given."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/quadrat-{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # what an id stands for stays alive with it

    def __call__(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def files(self, df: DataFrame, form: str, **options: str) -> str:
        """The folder of the frame's rows as files of another format, which ``keep`` drops."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.format(form).options(**options).save(path)
        self.paths[id(path)] = df, path
        return path

    def keep(self, *frames: DataFrame) -> None:
        jvm, kept = self.spark.sparkContext._jvm, {id(f) for f in frames}
        for key in [k for k in self.paths if k not in kept]:
            place = jvm.org.apache.hadoop.fs.Path(self.paths.pop(key)[1])
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
