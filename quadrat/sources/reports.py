"""Classifier reports whose indentation is a tree.

A row's parent is the last row before it with a smaller depth. A report is a few
thousand lines at most, so each file is one group; files are read in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TREE = "sample string, taxid long, rank string, name string, parent long, clade_reads long, depth int, genus string, species string"


def parse_report(text: str) -> Iterator[tuple]:
    """(taxid, rank, name, parent, clade_reads, depth, genus, species) of each line of six columns."""
    above: list[tuple] = []
    for line in text.splitlines():
        cells = line.split("\t")
        if len(cells) < 6:
            continue
        name = cells[5].strip()
        depth = (len(cells[5]) - len(cells[5].lstrip(" "))) // 2
        rank, taxid, clade = cells[3].strip(), int(cells[4]), int(cells[1])
        if rank == "U":
            yield taxid, rank, name, None, clade, 0, None, None
            continue
        above = [a for a in above if a[0] < depth] + [(depth, rank, name, taxid)]
        at = {r: n for _, r, n, _ in above}
        yield taxid, rank, name, above[-2][3] if len(above) > 1 else None, clade, depth, at.get("G"), at.get("S")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The tree of every report under path; sample is the file's name up to its first dot."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/]*)?$", 1).alias("sample"), "value")

    def run(batches):
        for batch in batches:
            for sample, text in zip(batch["sample"], batch["value"], strict=True):
                yield pd.DataFrame([(sample, *row) for row in parse_report(text)], columns=[c.split()[0] for c in _TREE.split(", ")]).astype({"taxid": "Int64", "parent": "Int64", "clade_reads": "Int64", "depth": "Int32"})

    return files.mapInPandas(run, _TREE)


def species_table(tree: DataFrame) -> DataFrame:
    """(sample, taxid, species, genus, reads) of the species rows."""
    return tree.where("rank = 'S'").select("sample", "taxid", F.col("name").alias("species"), "genus", F.col("clade_reads").alias("reads"))


def totals(tree: DataFrame) -> DataFrame:
    """(sample, classified, unclassified)."""
    return tree.groupBy("sample").agg(F.sum(F.when(F.col("rank") == "R", F.col("clade_reads")).otherwise(0)).alias("classified"), F.sum(F.when(F.col("rank") == "U", F.col("clade_reads")).otherwise(0)).alias("unclassified"))
