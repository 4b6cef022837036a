"""Quality profiles of reads: (file, seq, qual). Histograms are sums, so they merge over files, partitions and stream batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.sequences import canonical_strand, gc_percent, mean_quality, quality_scores


def read_table(reads: DataFrame) -> DataFrame:
    """Adds length, gc and mean_q."""
    return reads.withColumn("length", F.length("seq")).withColumn("gc", gc_percent("seq")).withColumn("mean_q", mean_quality(quality_scores("qual")))


def read_statistics(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """reads, bases, mean and lower median length, N50, mean quality, per cent of reads with Q10, Q20 and Q30.

    Reads are summed by length first; medians and N50 are then windows over the different lengths.
    """
    by = by or ["file"]
    over = lambda q: F.sum((F.col("mean_q") >= q).cast("int"))
    each = read_table(reads).groupBy(*by, "length").agg(F.count("*").alias("m"), F.sum("length").alias("sum"), F.sum("mean_q").alias("q"), F.count("mean_q").alias("mq"), over(10).alias("q10"), over(20).alias("q20"), over(30).alias("q30"))
    own = Window.partitionBy(*by)
    down = own.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    s = each.withColumn("run", F.sum("sum").over(down)).withColumn("place", F.sum("m").over(down)).withColumn("bases", F.sum("sum").over(own)).withColumn("n", F.sum("m").over(own))
    pct = lambda c: F.try_divide(100.0 * F.sum(c), F.sum("mq"))
    return s.groupBy(*by).agg(
        F.sum("m").alias("reads"), F.sum("sum").alias("bases"), F.try_divide(F.sum("sum"), F.sum(F.when(F.col("length").isNotNull(), F.col("m")))).alias("mean_length"), F.try_divide(F.sum("q"), F.sum("mq")).alias("mean_q"),
        pct("q10").alias("q10_pct"), pct("q20").alias("q20_pct"), pct("q30").alias("q30_pct"),
        F.max(F.when(F.col("run") >= F.col("bases") / 2, F.col("length"))).alias("n50"), F.max(F.when(F.col("place") >= F.floor(F.col("n") / 2) + 1, F.col("length"))).alias("median_length"),
    )


def histogram(table: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """(by..., bin, reads, bases): bins [bin, bin + width)."""
    return table.where(F.col(value).isNotNull()).groupBy(*by, (F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("reads"), F.sum("length").alias("bases"))


def position_quality(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., pos, q, n): how often each quality stands at each position."""
    by = by or ["file"]
    kind = ", ".join(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in by) + ", pos int, q int, n long"
    return reads.select("qual", *by).mapInArrow(lambda it: _placed(it, by), kind).groupBy(*by, "pos", "q").agg(F.sum("n").alias("n"))


def _placed(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Task: (by..., pos, q, n), counted slice by slice before the shuffle."""
    for batch in _slices(batches, most):
        texts = pc.fill_null(batch.column(0), "")
        length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        q = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
        if not len(q):
            continue
        group = np.zeros(len(length), np.int64)
        for k in range(len(by)):
            codes = batch.column(k + 1).dictionary_encode(null_encoding="encode")
            group = np.unique(group * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        rows = np.unique(group, return_index=True)[1]
        pos = np.arange(len(q)) - np.repeat(np.cumsum(length) - length, length)
        wide, high = int(length.max()), int(q.max()) + 1
        key, n = np.unique((np.repeat(group, length) * wide + pos) * high + q, return_counts=True)
        own = batch.select(range(1, len(by) + 1)).take(pa.array(rows[key // (wide * high)]))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array((key // high % wide).astype(np.int32)), pa.array((key % high - 33).astype(np.int32)), pa.array(n.astype(np.int64))], [*by, "pos", "q", "n"])


def position_quantiles(counts: DataFrame, by: list[str] | None = None, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by..., pos, mean_q, q25, q50, q75): the first quality at which the counts reach each share."""
    by = [*(by or ["file"]), "pos"]
    own = Window.partitionBy(*by)
    s = counts.withColumn("run", F.sum("n").over(own.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(own))
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("q") * F.col("n")), F.sum("n")).alias("mean_q"), *(F.min(F.when(F.col("run") >= p * F.col("all"), F.col("q"))).alias(f"q{round(100 * p)}") for p in shares))


def dereplicate(sequences: DataFrame) -> DataFrame:
    """(seq, size): both strands of a sequence are one."""
    return sequences.where("seq IS NOT NULL").groupBy(canonical_strand("seq").alias("seq")).agg(F.count("*").alias("size"))


_CODE = np.full(256, 4, np.int64)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_pair)] = _i


MOST = 1 << 18  # letters taken at once


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most so many letters together, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _counted(batches: Iterator[pa.RecordBatch], k: int, most: int = MOST) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, most):
        col = pc.binary_join_element_wise(pc.fill_null(batch.column(0), ""), "N", "").cast(pa.large_string())
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(col) else np.empty(0, np.uint8)
        for lo in range(0, max(len(data) - k + 1, 0), most):  # parts overlap by k - 1 letters
            base = _CODE[data[lo : lo + most + k - 1]]
            n = len(base) - k + 1
            code, unknown = np.zeros(n, np.int64), np.concatenate(([0], np.cumsum(base == 4)))
            for j in range(k):
                code = code * 4 + base[j : j + n]
            found, count = np.unique(code[unknown[k:] == unknown[:-k]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count.astype(np.int64))], ["code", "n"])


def kmer_table(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer, n): how often each k-mer stands in the sequences (seq), those with letters other than a, c, g and t left out; k is at most 31.

    K-mers are numbers, counted part by part before the shuffle and spelled out at the end.
    """
    if not 1 <= k <= 31:
        raise ValueError("k is from 1 to 31")
    counts = sequences.select("seq").mapInArrow(lambda it: _counted(it, k), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    letters = [F.substring(F.lit("ACGT"), (F.shiftright("code", 2 * (k - 1 - j)) % 4 + 1).cast("int"), F.lit(1)) for j in range(k)]
    return counts.select(F.concat(*letters).alias("kmer"), "n")
