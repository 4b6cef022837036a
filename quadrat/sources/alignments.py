"""Whole-genome alignments: nucleotide identities from delta files, fragment tables and difference strings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.operators.intervals import union_length

# Least coverage and identity of a fragment that counts.
FRAGMENT_COVERAGE, FRAGMENT_IDENTITY = 0.7, 0.3
_DELTA = "pair string, ref string, query string, rs long, re long, qs long, qe long, errors long"


def _parsed(name: str, text: str) -> Iterator[tuple]:
    ref = query = None
    for line in text.splitlines():
        cells = line.split()
        if cells and cells[0].startswith(">"):
            ref, query = cells[0][1:], cells[1]
        elif len(cells) == 7:
            rs, re_, qs, qe = (int(x) for x in cells[:4])
            yield name, ref, query, min(rs, re_), max(rs, re_), min(qs, qe), max(qs, qe), int(cells[4])


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """(pair, ref, query, rs, re, qs, qe, errors): alignments of each delta file, both ends included; pair is the file's name up to its first dot. A file's records depend on the header before them, so a file is one row of the scan."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/]*)?$", 1).alias("pair"), "value")

    def run(batches):
        for batch in batches:
            for name, text in zip(batch["pair"], batch["value"], strict=True):
                yield pd.DataFrame(list(_parsed(name, text)), columns=[c.split()[0] for c in _DELTA.split(", ")])

    return files.mapInPandas(run, _DELTA)


def alignment_identity(alignments: DataFrame) -> DataFrame:
    """(pair, ani, ref_aligned, query_aligned): identical bases of both sides, per cent of the aligned ones, and the length that alignments cover together."""
    r, q = F.col("re") - F.col("rs") + 1, F.col("qe") - F.col("qs") + 1
    s = alignments.groupBy("pair").agg(F.try_divide(100.0 * F.sum(r + q - 2 * F.col("errors")), F.sum(r + q)).alias("ani"))
    side = lambda name, a, b, out: union_length(alignments.select("pair", F.col(name).alias("seq"), F.col(a).alias("start"), F.col(b).alias("end")), ["pair", "seq"], closed=True).groupBy("pair").agg(F.sum("covered").alias(out))
    return s.join(side("ref", "rs", "re", "ref_aligned"), "pair").join(side("query", "qs", "qe", "query_aligned"), "pair")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(pair, place, fragment, pident, length, mismatches, qlen, gaps) of tables of fragment hits; place is the order within a file."""
    v = F.split("value", "\t")
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/]*)?$", 1).alias("pair"), F.monotonically_increasing_id().alias("place"), v.alias("v")).where(F.size("v") >= 7)
    return rows.select("pair", "place", F.col("v")[0].alias("fragment"), F.col("v")[2].try_cast("double").alias("pident"), *(F.col("v")[i].try_cast("long").alias(n) for i, n in ((3, "length"), (4, "mismatches"), (5, "qlen"), (6, "gaps"))))


def fragment_identity(fragments: DataFrame) -> DataFrame:
    """(pair, ani, aligned, fragments): mean identity of the fragments' first hits that cover and match enough; hits of a fragment stand together."""
    aligned = F.col("length") - F.col("gaps")
    good = fragments.where((aligned / F.col("qlen") > FRAGMENT_COVERAGE) & ((aligned - F.col("mismatches")) / F.col("qlen") > FRAGMENT_IDENTITY))
    first = good.withColumn("r", F.row_number().over(Window.partitionBy("pair", "fragment").orderBy("place"))).where("r = 1")
    return first.groupBy("pair").agg(F.avg("pident").alias("ani"), F.sum(aligned).alias("aligned"), F.count("*").alias("fragments"))


def both_directions(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(pair, ani): mean of the directions that have one."""
    both = forward.select("pair", F.col("ani").alias("a")).join(backward.select("pair", F.col("ani").alias("b")), "pair", "full")
    n = F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")
    return both.select("pair", F.try_divide(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), n).alias("ani"))


def differences(cs: str | Column) -> Column:
    """Substitutions, indels and bases in indels of a difference string (``:6*ag+tt``)."""
    c = F.col(cs) if isinstance(cs, str) else cs
    gaps = F.regexp_extract_all(c, F.lit(r"[+-]([a-z0-9]+)"), 1)
    return F.struct(F.size(F.regexp_extract_all(c, F.lit(r"(\*[a-z0-9]+)"), 1)).alias("substitutions"), F.size(gaps).alias("indels"), F.aggregate(gaps, F.lit(0), lambda n, x: n + F.length(x)).alias("indel_bases"))


def profile_correlation(profiles: DataFrame, a: str, b: str) -> DataFrame:
    """One row (a, b, r): Pearson correlation of two genomes' tetramer scores. profiles: (name, kmer, z)."""
    x, y = (profiles.where(F.col("name") == n).select("kmer", F.col("z").alias(c)) for n, c in ((a, "x"), (b, "y")))
    return x.join(y, "kmer").agg(F.corr("x", "y").alias("r")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r")
