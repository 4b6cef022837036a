"""Tables as they leave the engine. Wide tables have a column for each sample, so they are for results, not for the features of a large corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide_features(features: DataFrame, samples: list[str]) -> DataFrame:
    """One row per feature, a column for each sample (0 where absent), by total from the largest."""
    wide = features.groupBy("feature_id").pivot("sample", samples).agg(F.sum("reads")).na.fill(0.0, subset=samples)
    total = sum((F.col(f"`{s}`") for s in samples), F.lit(0.0))
    return wide.withColumn("__total", total).orderBy(F.desc("__total"), "feature_id").drop("__total")


def wide_tracking(tracking: DataFrame, stages: list[str]) -> DataFrame:
    """One row per sample; a skipped stage repeats the one before."""
    wide = tracking.groupBy("sample").pivot("stage", stages).agg(F.max("reads"))
    return wide.select("sample", *(F.coalesce(*(F.col(f"`{s}`") for s in reversed(stages[: i + 1]))).alias(s) for i, s in enumerate(stages)))


def merged_species(profiles: DataFrame, tools: list[str]) -> DataFrame:
    """(species, a share for each tool): the union of the tools' species, by the largest share. profiles: (tool, species, share)."""
    wide = profiles.groupBy("species").pivot("tool", tools).agg(F.sum("share")).na.fill(0.0, subset=tools)
    most = F.greatest(*(F.col(f"`{t}`") for t in tools)) if len(tools) > 1 else F.col(f"`{tools[0]}`")
    return wide.orderBy(F.desc(most), "species")


def union_columns(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables with the union of their columns, in order of first appearance."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def krona(features: DataFrame, taxonomy: DataFrame, ranks: list[str]) -> DataFrame:
    """(sample, line): reads and the names of the lineage that are known, tab by tab."""
    per = features.join(taxonomy.hint("merge"), "feature_id", "left").groupBy("sample", *ranks).agg(F.sum("reads").alias("reads"))
    return per.select("sample", F.concat_ws("\t", F.col("reads").cast("long").cast("string"), *ranks).alias("line"))


def write_csv(table: DataFrame, path: str) -> None:
    """One file with a header: for result tables."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def in_job_order(metadata: DataFrame, samples: DataFrame) -> DataFrame:
    """Metadata in the order of the job's samples (sample, position), with empty attributes where there are none."""
    return samples.join(metadata, "sample", "left").orderBy("position")


def unique_names(names: DataFrame) -> DataFrame:
    """Adds unique: repeated names get _2, _3 ... in order of position."""
    r = F.row_number().over(Window.partitionBy("name").orderBy("position"))
    return names.withColumn("unique", F.when(r == 1, F.col("name")).otherwise(F.concat_ws("_", "name", r.cast("string"))))
