"""WARC archives with revisit records (operator 5).

Headers (digest, size, page) are written once and shuffled by payload digest;
the smallest page of each digest is the original, the others revisit it. The
pages then meet the list of repeated digests alone: Spark sends a short list to
them, so no payload is shuffled, and shuffles both where it is long. Archives
are written with fresh headers and with each payload once, read back, and the
revisits are joined to their originals to get their sizes.

Archives are written by Spark's text writer, whose separator between rows is
the blank line that ends a WARC record, so a file is the plain concatenation of
its records; each is gzipped. Records go to files by size class (``CLASSES``),
each with as many records a file as keep it under some 128 MB; a longer record
is a file of its own. They are read whole, one file at a time, record by record
by Content-Length.

Results in odd cases: a null payload is an empty one; payloads under
``LEAST_BYTES`` are always responses; rows that repeat the original's page_id
and payload stay responses; rows with a null page_id are never originals, and
revisit one if it exists; a null url becomes an empty target; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import settled

LEAST_BYTES = 100
RECORDS = 2000  # rows that a reading task gives on at once
#: Largest record, and records a file.
CLASSES = [(64 << 10, 2000), (1 << 20, 128), (16 << 20, 8), (None, 1)]
END = "\r\n\r\n"
EMPTY_GZIP = 20  # bytes


def _with_headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(digest, refers_to): the original of each digest that several rows have. headers: (page_id, bytes, digest)."""
    groups = headers.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")


def as_records(pages: DataFrame, originals: DataFrame) -> DataFrame:
    """(record): a WARC record without the blank line at its end for each row of pages (page_id, url, payload, bytes, digest).

    Rows meet their original by digest. A digest of very many rows is a skewed key of this join, which AQE splits.
    """
    rows = pages.join(originals, "digest", "left")
    revisit = F.col("refers_to").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to")))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    # white space and control characters would break the header; they are percent-encoded
    plain = F.coalesce("url", F.lit(""))
    odd = plain.rlike(r"[\x00-\x20\x7f]")
    target = F.when(odd, F.url_encode(plain)).otherwise(plain)
    lines = [
        F.lit("WARC/1.1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number, F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.when(odd, "X-Target-Encoding: percent"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.when(revisit, "").otherwise(F.col("payload"))).alias("record"))


def write_archives(records: DataFrame, path: str, per_file: int = RECORDS) -> None:
    """Add the records to the archives under path. The file that Spark writes for a first partition without rows is no archive and goes."""
    records.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    context = records.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-*")
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    for found in files.globStatus(place) or ():
        if found.getLen() <= EMPTY_GZIP:
            files.delete(found.getPath(), False)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or gzipped."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:20]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        if len(block) < size:
            raise ValueError("a WARC record is cut off")
        yield headers, block


_RECORDS = "page_id long, url string, record_type string, refers_to long, declared string, bytes long, digest string"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "none") else None


def _parsed(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORDS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    for batch in batches:
        for data in batch.column("content"):
            rows, size = [], 0
            for headers, block in parse(data.as_py()):
                target = headers.get("warc-target-uri", "")
                row = (_page(headers["warc-record-id"]), urllib.parse.unquote_plus(target) if headers.get("x-target-encoding") == "percent" else target, headers["warc-type"], _page(headers.get("warc-refers-to")), headers.get("warc-payload-digest", "").removeprefix("sha256:"), len(block), hashlib.sha256(block).hexdigest())
                rows.append((*row, block) if with_payload else row)
                size += len(block) * with_payload
                if len(rows) >= RECORDS or size > 8 << 20:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record. digest and bytes are those of the block as read; declared is the digest that the header gives."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda it: _parsed(it, with_payload), _RECORDS + ", payload binary" * with_payload)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits get size and digest from the response they refer to."""
    responses = records.where("record_type = 'response'")
    originals = responses.where("page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared"), F.col("bytes").alias("full")).distinct()
    revisits = records.where("record_type = 'revisit'").select("page_id", "refers_to", "declared").join(originals, ["refers_to", "declared"], "left")
    whole = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(revisits.select("page_id", F.col("full").alias("payload_bytes"), F.col("declared").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


def archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as deduplicated archives under path; what they hold, as read back."""
    rows = _with_headers(pages)
    headers, _ = settled(rows.select("page_id", "bytes", "digest"), "warc-headers")
    originals, _ = settled(resolve(headers, least_bytes), "warc-originals")  # of known size, so that Spark can choose the join
    least = 0
    for most, per_file in CLASSES:
        own = (F.col("bytes") > least) if least else F.lit(True)
        own = own if most is None else own & (F.col("bytes") <= most)
        if most == CLASSES[0][0] or not headers.where(own).isEmpty():
            write_archives(as_records(rows.where(own), originals), path, per_file)
        least = most
    found, _ = settled(read_archives(pages.sparkSession, path), "warc-records")  # parsed once, used three times; no payloads
    return resolved(found)


def dedup_archives(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Read archives of pages in UTF-8 and write them again with revisit records.

    A record that is a revisit already has the payload of the response it refers to, by page and digest; one without such a
    response in the source has no payload to write and is left out.
    """
    old = read_archives(spark, source, with_payload=True)
    whole = old.where("record_type = 'response'").select("page_id", "url", "digest", "payload")
    origin = whole.where("page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared"), "payload").dropDuplicates(["refers_to", "declared"])
    again = old.where("record_type = 'revisit'").select("page_id", "url", "refers_to", "declared").join(origin, ["refers_to", "declared"])
    pages = whole.select("page_id", "url", "payload").unionByName(again.select("page_id", "url", "payload"))
    return archive(pages.select("page_id", "url", F.decode("payload", "utf-8").alias("html")), target, least_bytes)


ARCHIVE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to FROM o
"""
