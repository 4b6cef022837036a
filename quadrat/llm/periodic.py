"""Runs of periodic words by a harmonic grid of longest common extensions (operator 11).

A run is a stretch of words with a smallest period q that no neighbouring word
extends, of at least ``LEAST`` words and ``TIMES`` periods. For each period p
the words at jp and (j + 1)p are held against each other for all j: by how many
words they agree forward and backward is a range minimum over the common
prefixes of a suffix array, of the text and of the reversed text. Together they
are the maximal stretch of period p around the two places. The places of all
periods are n / 1 + n / 2 + ... , so the work is n log n. A stretch found for
several periods has the smallest of them.

Texts are taken whole, in slices of an Arrow batch; a longer text is a slice of
its own. Nothing is shuffled, so no group of copies and no common word matters,
and a lost task is just run again.

Results in odd cases: a null, empty or blank text has no words, so no runs, and
an empty collapsed text; words are compared byte by byte; rows are taken one by
one, so repeated rows and null doc_ids stay; an empty table gives an empty
result. ``find_runs`` keeps all columns; where docs have a ``runs`` or
``collapsed`` of their own, in any spelling, the new name gets underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.suffixes import Extension, TextWords, spans, with_columns

LEAST, TIMES = 6, 4
QUERIES = 1 << 18
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def runs_of(words: TextWords, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period), by text, start and period; start is a place among the words of all texts."""
    size = np.diff(words.first)
    text, period = spans(size // times)
    period += 1
    asked = (size[text] - 1) // period  # places jp with a place (j + 1)p
    extension, found, total = None, [], np.cumsum(asked)
    lo = 0
    while lo < len(asked):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + QUERIES, side="right")))
        pair, j = spans(asked[lo:hi])
        p, begin = period[lo:hi][pair], words.first[text[lo:hi][pair]]
        a = begin + j * p
        # a run of four periods holds three such pairs whole: where the words differ, no stretch reaches beyond a pair
        same = words.symbols[a] == words.symbols[a + p]
        a, p, begin, own = a[same], p[same], begin[same], text[lo:hi][pair[same]]
        lo = hi
        if not len(a):
            continue
        extension = extension or Extension(words)
        ahead = extension.from_here(a, a + p)
        behind = np.zeros(len(a), np.int64)
        inner = a > begin
        behind[inner] = extension.up_to(a[inner], a[inner] + p[inner])
        length = ahead + behind + p
        long = length >= np.maximum(least, times * p)
        found.append(np.unique(np.stack([own, a - behind, length, p], axis=1)[long], axis=0))
    rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)  # the same stretch again has a multiple of the smallest period
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _kept(words: TextWords, runs: np.ndarray) -> np.ndarray:
    """False for each word that a run holds after its first period."""
    change = np.zeros(len(words.symbols) + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def _found(words: TextWords, least: int, times: int) -> list[pa.Array]:
    runs = runs_of(words, least, times)
    first = np.searchsorted(runs[:, 0], np.arange(len(words.first)))
    fields = [runs[:, 1] - words.first[runs[:, 0]], runs[:, 2], runs[:, 3]]
    return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], fields=list(_RUN))), words.joined(_kept(words, runs))]


def find_runs(docs: DataFrame, text: Column | str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The documents with the runs of their texts (start and length in words from 0, by start, then period), and collapsed:
    the words joined by one space, without those that a run holds after its first period."""
    return with_columns(docs, text, {"runs": _RUNS, "collapsed": "string"}, lambda words: _found(words, least, times))


def words_of(text: Column) -> Column:
    """The words of a text, as Spark's own expression."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32 of its id goes round in a loop from some word on (the check's planted case).

    A null doc_id has no such number, so its text stays.
    """
    g, n, a, p = F.col("__g"), F.col("__n"), F.col("__a"), F.col("__p")
    out = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("__h"))
    picked = (F.col("__h") % 10 == 0) & F.col("text").isNotNull()
    out = out.withColumn("__w", F.when(picked, words_of(F.col("text")))).withColumn("__n", F.size("__w").cast("long")).withColumn("__g", F.expr("__h div 10"))
    out = out.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", F.when(n > 0, 1 + F.floor((n - a) / (3 + g % 8))))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("__w", F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
    return out.select("doc_id", F.when(picked & (n > 0), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """One row for each of ``find_runs``: number of runs, the longest (ties: smallest start, then period), hashes of all runs and
    of the collapsed text."""
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))), 1)
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    out = found.withColumn("__b", F.when(F.size("runs") > 0, best))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        F.col("__b.s").alias("start"), (-F.col("__b.l")).alias("length"), F.col("__b.p").alias("period"),
        F.expr("(-1000 * __b.l) div __b.p").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
