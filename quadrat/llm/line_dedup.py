"""Repeated passages of lines, by overlapping three-line windows (operator 4). DataFrame functions only.

Lines are the parts of a text between line breaks, compared without blanks
around them. Every three lines in a row are a window, known by two 64-bit
hashes. Of a window that stands at several places, in one document or many,
the first place (by doc_id, then by line) stays. The other places are removed:
the lines that they cover are merged to runs and cut from their documents.
Every removed line still stands at the window's first place, or at an earlier
one that led to its removal there.

A window that very many documents share is one row after map-side aggregation;
in the join back to its places it is a skewed key, which AQE splits. No group
is gathered but a document's own windows.

Results in odd cases: a null text counts as empty; texts of one or two lines
have no window and stay; windows of three blank lines are no windows; rows with
equal doc_id and text are treated as one document and get the same result;
null doc_ids come first in the order; further columns stay; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import settled

WINDOW = 3


def _key() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t")]


def _windows(docs: DataFrame) -> DataFrame:
    """(__d, __t, pos, w1, w2): the windows of each document; pos counts lines from 0."""
    lines = docs.select(*_key(), F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    lines = lines.where(F.size("l") >= WINDOW).select("__d", "__t", F.expr("transform(l, x -> struct(xxhash64(trim(x)) as a, xxhash64('line', trim(x)) as b))").alias("h"))
    places = [f"h[i + {k}]" for k in range(WINDOW)]
    window = ", ".join(f"xxhash64({', '.join(f'{p}.{s}' for p in places)}) as w{n}" for n, s in ((1, "a"), (2, "b")))
    out = lines.select("__d", "__t", F.posexplode(F.expr(f"transform(sequence(0, size(h) - {WINDOW}), i -> struct({window}))")).alias("pos", "w"))
    blank = F.xxhash64(*[F.xxhash64(F.lit(""))] * WINDOW)
    return out.select("__d", "__t", "pos", "w.w1", "w.w2").where(F.col("w1") != blank)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(__d, __t, runs): for each document that loses lines, their runs as (lo, hi), in order and apart."""
    windows, _ = settled(_windows(docs), "line-windows")
    place = F.struct("__d", "__t", "pos")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["w1", "w2"]).where(place != F.col("first")).select("__d", "__t", "pos").distinct()
    own = "partition by __d, __t order by pos"
    islands = later.withColumn("new", F.expr(f"cast(coalesce(pos > lag(pos) over ({own}) + {WINDOW}, true) as int)")).withColumn("island", F.expr(f"sum(new) over ({own})"))
    runs = islands.groupBy("__d", "__t", "island").agg(F.min("pos").alias("lo"), (F.max("pos") + WINDOW - 1).alias("hi"))
    return runs.groupBy("__d", "__t").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__runs"))


def _rest(docs: DataFrame) -> DataFrame:
    """(own, rest, n_lines, n_removed) of each row: the row itself as a struct, so that no name of its columns clashes, what
    remains of its text, and the numbers of lines before and removed."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *_key())
    whole = F.col("own.text")
    out = keyed.join(repeated_runs(docs), ["__d", "__t"], "left").withColumn("l", F.split(F.coalesce(whole, F.lit("")), "\n"))
    lo = "if(i = size(__runs), size(l), __runs[i].lo)"
    after = "if(i = 0, 0, __runs[i - 1].hi + 1)"
    kept = F.expr(f"flatten(transform(sequence(0, size(__runs)), i -> slice(l, {after} + 1, {lo} - {after})))")
    removed = F.expr("coalesce(aggregate(__runs, 0L, (n, r) -> n + r.hi - r.lo + 1), 0L)")
    return out.select("own", F.when(F.col("__runs").isNull(), whole).otherwise(F.array_join(kept, "\n")).alias("rest"), F.size("l").cast("long").alias("n_lines"), removed.alias("n_removed"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_md5): the last of the text that remains."""
    out = _rest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("own.doc_id", "n_lines", "n_removed", F.md5(F.coalesce("rest", F.lit(""))).alias("text_md5"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what remains of their texts; those that lost every line go. n_chars, if there is one, follows the text."""
    out = _rest(docs).where("n_removed = 0 OR n_removed < n_lines")
    new = {"text": F.col("rest")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("own.n_chars"))
    return out.select(*[new.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns])


REPORT_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p AS pos, trim(l[p]) AS a, trim(l[p + 1]) AS b, trim(l[p + 2]) AS c
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3) t),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM w WHERE a <> '' OR b <> '' OR c <> ''),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE n > 1),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM d),
kept AS (SELECT lines.doc_id, string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY lines.pos) AS rest, count(*) AS n_lines, count(gone.pos) AS n_removed
         FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.pos = gone.pos GROUP BY lines.doc_id)
SELECT doc_id, n_lines, n_removed, md5(coalesce(rest, '')) AS text_md5 FROM kept
"""
