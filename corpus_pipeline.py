"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, benchmark leaks go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrat.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from quadrat.llm.common import drop_path, scratch, settled
from quadrat.session import ship


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeats(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("decontamination", _decontamination), ("packing", _packing)]

#: A trained classifier and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written, and dropped when the next stage has read it; so is what a stage writes on its way."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as paths:
            docs, path = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
            paths.remove(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
