"""FASTA and FASTQ files, plain or gzipped; FASTA also zipped.

FASTA splits anywhere between records; a zip archive is one task, which streams its members. A FASTQ record is four lines, which a
line split can't find again, so a file is one task; sequencers write many files.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unzipped(spark: SparkSession, path: str, most: int = 1 << 24) -> DataFrame:
    """(value): the records of all members of zip archives, a header without its mark and the lines of its sequence."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(memoryview(data.as_buffer()))) as archive:
                    rows, size, record = [], 0, []
                    for member in archive.infolist():
                        if member.is_dir() or member.filename.startswith("__MACOSX/"):
                            continue
                        for line in io.TextIOWrapper(archive.open(member), encoding="utf-8", errors="replace"):
                            if line.startswith(">") and record:
                                rows.append("".join(record))
                                size, record = size + len(rows[-1]), []
                            if size > most:
                                yield pa.RecordBatch.from_arrays([pa.array(rows)], ["value"])
                                rows, size = [], 0
                            record.append(line)
                        if record:
                            rows.append("".join(record))
                            record = []
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq): name is the first word of the header; sequences in upper case without line breaks. A path that ends in .zip holds archives."""
    lines = _unzipped(spark, path) if path.lower().endswith(".zip") else spark.read.option("lineSep", "\n>").text(path)
    rows = lines.select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    head, body = F.split("value", "\r?\n", 2)[0], F.get(F.split("value", "\r?\n", 2), F.lit(1))
    return rows.select(F.split(F.trim(head), r"\s+")[0].alias("name"), F.trim(head).alias("description"), F.upper(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s", "")).alias("seq"))


def parse_fastq(data: bytes, most: int | None = None) -> Iterator[tuple[int, str, str, str]]:
    """(number, header, seq, qual) of whole records; a cut-off last record is left out."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    lines = io.TextIOWrapper(io.BufferedReader(stream), encoding="latin-1")
    number = 0
    while most is None or number < most:
        header, seq, plus, qual = (lines.readline().rstrip("\r\n") for _ in range(4))
        if not plus.startswith("+") or len(seq) != len(qual) or not header.startswith("@"):
            return
        yield number, header[1:], seq, qual
        number += 1


def read_fastq(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(file, read_no, header, seq, qual); at most ``most`` records of each file."""
    names = ["file", "read_no", "header", "seq", "qual"]

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for record in parse_fastq(data.as_py(), most):
                    rows.append((file.rsplit("/", 1)[-1], *record))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, read_no long, header string, seq string, qual string")


def pairs(reads: DataFrame, first: str, second: str) -> DataFrame:
    """(read_no, seq1, qual1, seq2, qual2): records of two files in lockstep."""
    side = lambda f, n: reads.where(F.col("file") == f).select("read_no", F.col("seq").alias(f"seq{n}"), F.col("qual").alias(f"qual{n}"))
    return side(first, 1).join(side(second, 2), "read_no")


def sample_pairs(files: DataFrame) -> DataFrame:
    """(sample, r1, r2): files paired by the usual marks in their names. files: (file)."""
    mark = r"(?i)^(.+?)[._-]R?([12])(_001)?\.f(ast)?q(\.gz)?$"
    named = files.select("file", F.regexp_extract("file", mark, 1).alias("sample"), F.regexp_extract("file", mark, 2).alias("mate")).where("sample <> ''")
    return named.groupBy("sample").agg(F.min(F.when(F.col("mate") == "1", F.col("file"))).alias("r1"), F.min(F.when(F.col("mate") == "2", F.col("file"))).alias("r2"))
