"""The session settings that the library is tested with. On a cluster, pass your own session instead."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quadrat", master: str = "local[*]", partitions: int = 8, memory: str = "6g") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: it is zipped and added once to each application."""
    import pathlib
    import tempfile
    import zipfile

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = pathlib.Path(__file__).parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="quadrat-")) / "quadrat.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(home.rglob("*.py")):
            out.write(p, p.relative_to(home.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
