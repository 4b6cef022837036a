"""Abundances of references by expectation and maximisation over ambiguous reads.

A read's alignments give each reference a likelihood. In a round every read is dealt to its references by likelihood times
abundance, and the abundances become the shares of what they got. Reads stay rows of (read, reference): a round is a join
with the abundances, a sum by read and a sum by reference, whose result is written, so lineage stays short. Reads that agree
in all their references and likelihoods are one row with a weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.rounds import Rounds

ROUNDS, GAIN = 100, 0.01


def read_classes(alignments: DataFrame) -> DataFrame:
    """(sample, read, ref, likelihood, weight) of alignments (sample, read, ref, loglik).

    read is the smallest of those with equal rows, weight their number. likelihood is relative to the read's best; of several
    alignments of a read to a reference the best counts; a null loglik or ref is no alignment.
    """
    best = alignments.where("loglik IS NOT NULL AND ref IS NOT NULL").groupBy("sample", "read", "ref").agg(F.max("loglik").alias("loglik"))
    rows = best.groupBy("sample", "read").agg(F.max("loglik").alias("top"), F.sort_array(F.collect_list(F.struct("ref", "loglik"))).alias("own"))  # a read's references: bounded by the aligner
    # the whole list is the key, so that only equal reads meet
    classes = rows.groupBy("sample", "own", "top").agg(F.min("read").alias("read"), F.count(F.lit(1)).alias("weight"))
    return classes.select("sample", "read", F.explode("own").alias("x"), "top", "weight").select("sample", "read", "x.ref", F.exp(F.col("x.loglik") - F.col("top")).alias("likelihood"), F.col("weight").cast("double").alias("weight"))


def _dealt(rows: DataFrame, shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each reference gets of each read, and the log-likelihood of each sample."""
    part = rows.join(shares, ["sample", "ref"]).withColumn("part", F.col("likelihood") * F.col("share"))
    total = part.groupBy("sample", "read").agg(F.sum("part").alias("total"), F.first("weight").alias("w"))
    fit = total.groupBy("sample").agg(F.sum(F.col("w") * F.log("total")).alias("fit"))
    got = part.join(total, ["sample", "read"]).groupBy("sample", "ref").agg(F.sum(F.col("weight") * F.col("part") / F.col("total")).alias("reads"))
    return got, fit


def em_abundance(alignments: DataFrame, rounds: int = ROUNDS, gain: float = GAIN, least: float = 0.0, trace: list | None = None) -> DataFrame:
    """(sample, ref, share, reads): shares of a sample's aligned reads, and estimated numbers of them.

    Rounds end when no sample's log-likelihood rises by gain, or after so many. Then references under the share least are
    left out, if a sample has others, and the rest is dealt once more. trace gets {sample: log-likelihood} of each round.
    """
    spark = alignments.sparkSession
    keep = Rounds(spark, "em")
    rows = keep(read_classes(alignments))
    known = rows.groupBy("sample").agg(F.countDistinct("ref").alias("n"))
    shares = keep(rows.select("sample", "ref").distinct().join(known, "sample").select("sample", "ref", (1.0 / F.col("n")).alias("share")))
    before: DataFrame | None = None
    for _ in range(rounds):
        got, fit = _dealt(rows, shares)
        fit = keep(fit)
        if trace is not None:
            trace.append({r["sample"]: r["fit"] for r in fit.collect()})  # a number for each sample; for tests and reports
        if before is not None and fit.join(before.withColumnRenamed("fit", "old"), "sample").where(F.col("fit") - F.col("old") >= gain).isEmpty():
            break
        shares, before = keep(_shares(got)), fit
        keep.keep(rows, shares, before)
    if least > 0:
        top = shares.groupBy("sample").agg(F.max("share").alias("top"))
        good = shares.join(top, "sample").where((F.col("share") >= least) | (F.col("share") == F.col("top"))).select("sample", "ref", "share")
        shares = keep(_shares(good.withColumnRenamed("share", "reads")))
    got, _ = _dealt(rows, shares)
    out = keep(_shares(got, keep_reads=True))
    keep.keep(out)
    return out


def _shares(got: DataFrame, keep_reads: bool = False) -> DataFrame:
    total = got.groupBy("sample").agg(F.sum("reads").alias("all"))
    out = got.join(total, "sample").select("sample", "ref", (F.col("reads") / F.col("all")).alias("share"), "reads")
    return out if keep_reads else out.drop("reads")
