"""Quality rules on repetition inside a text, by a suffix array over its words (operator 12).

Neighbours in the order of suffixes share prefixes; the intervals of suffixes
that share at least ``LEAST`` words are the repeated stretches that can't go on
to the right, and those with different words before them can't to the left
either: the maximal repeated substrings. Their occurrences, overlapping ones
included, cover a part of the text. A document is kept if they cover at most
``COVERED`` of its words and none is longer than ``LONGEST`` words, and if it
passes the base rules: at least 50 words, at most half of them in three-word
windows that the text has twice.

Texts are taken whole, in slices of an Arrow batch; nothing is shuffled.

Results in odd cases: a null, empty or blank text has no words and fails the
base rules; words are compared byte by byte; rows are taken one by one, so
repeated rows and null doc_ids stay; an empty table gives an empty result. The
functions keep all columns; where docs have a column of an added name, in any
spelling, the added one gets underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import text_of
from quadrat.llm.suffixes import SuffixArray, TextWords, with_columns

LEAST, COVERED, LONGEST = 8, 0.3, 200
FEWEST_WORDS, REPEATED_PERCENT, WINDOW = 50, 50, 3
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
_SPANS = "array<struct<start:bigint,length:bigint>>"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def maximal_repeats(suffixes: SuffixArray, symbols: np.ndarray, starts: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, lo, hi): the intervals of the order whose suffixes share so many words, and have different words before them.

    starts: of each symbol the place where its text begins. Only places with a common prefix of least words are walked.
    """
    lcp, order = suffixes.lcp, suffixes.order
    before = np.where(order > starts[order], symbols[order - 1], -1)
    differs = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0)))) if len(order) else np.empty(0, np.int64)
    out, stack, last = [], [], -2
    for at in [*np.flatnonzero(lcp >= least).tolist(), len(lcp) + 1]:
        shared = int(lcp[at]) if at < len(lcp) else 0
        end = last  # a gap in the places closes all intervals
        if at != last + 1:
            while stack:
                length, lo = stack.pop()
                out.append((length, lo, end))
        lo = at - 1
        while stack and stack[-1][0] > shared:
            length, lo = stack.pop()
            out.append((length, lo, at - 1))
        if at < len(lcp) and (not stack or stack[-1][0] < shared):
            stack.append((shared, lo))
        last = at
    return [(length, lo, hi) for length, lo, hi in out if differs[hi] > differs[lo]]


def covered(suffixes: SuffixArray, least: int) -> np.ndarray:
    """Whether each word is in a stretch of at least so many words that its text has twice or more."""
    longest = np.maximum(suffixes.lcp, np.append(suffixes.lcp[1:], 0)) if len(suffixes.lcp) else suffixes.lcp
    at = np.flatnonzero(longest >= least)
    change = np.zeros(len(suffixes.lcp) + 1, np.int64)
    np.add.at(change, suffixes.order[at], 1)
    np.add.at(change, suffixes.order[at] + longest[at], -1)
    return np.cumsum(change)[:-1] > 0


def _repeats(words: TextWords, least: int) -> list[pa.Array]:
    n = len(words.first) - 1
    suffixes = SuffixArray(words.symbols, words.first[1:][words.text])
    text_at = words.text[suffixes.order]
    found, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for length, lo, _ in maximal_repeats(suffixes, words.symbols, words.first[words.text], least):
        found[text_at[lo]] += 1
        most[text_at[lo]] = max(most[text_at[lo]], length)
    on = covered(suffixes, least)
    edge = np.ones(len(on) + 1, bool)  # a span begins or ends where covered words do, and where a text does
    edge[1:-1] = (on[1:] != on[:-1]) | (words.text[1:] != words.text[:-1])
    edge = np.flatnonzero(edge)
    begin, end = edge[:-1][on[edge[:-1]]], edge[1:][on[edge[:-1]]]
    first = np.searchsorted(begin, words.first)
    fields = [begin - words.first[words.text[begin]], end - begin]
    windows = np.bincount(words.text[covered(suffixes, WINDOW)], minlength=n)
    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], fields=list(_SPAN)))
    return [pa.array(np.diff(words.first)), pa.array(windows), pa.array(found), pa.array(most), lists]


def find_repeats(docs: DataFrame, text: Column | str = "text", least: int = LEAST) -> DataFrame:
    """The documents with n_words, n_repeat_words (in three-word windows found twice), n_repeats (different maximal repeated
    substrings of at least so many words), longest_repeat, and repeat_spans: what these cover, as (start, length) in words."""
    return with_columns(docs, text, {"n_words": "long", "n_repeat_words": "long", "n_repeats": "long", "longest_repeat": "long", "repeat_spans": _SPANS}, lambda words: _repeats(words, least))


def base_numbers(text: Column) -> dict[str, Column]:
    """word_chars, n_symbols, n_dup_lines of a text, as expressions."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def judged(docs: DataFrame, least: int = LEAST, most_covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    """(own, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words, n_repeats, longest_repeat,
    repeat_spans); own is the row of docs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), text_of("text").alias("text"))
    out = find_repeats(rows, least=least).withColumns(base_numbers(F.col("text")))
    out = out.withColumn("covered_words", F.aggregate("repeat_spans", F.lit(0).cast("long"), lambda n, s: n + s.length))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    good = (F.col("covered_words") <= F.col("n_words") * most_covered) & (F.col("longest_repeat") <= longest)
    return out.withColumns({"base_failed": failed, "kept": ~failed & good}).select(
        "own", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "n_repeats", "longest_repeat", "repeat_spans"
    )


def report(docs: DataFrame) -> DataFrame:
    """The numbers and verdict of each document, without its other columns and spans."""
    return judged(docs.select("doc_id", "text")).select(F.col("own.doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", (F.col("longest_repeat") > LONGEST).alias("long_repeat"))


def drop_repetitive(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(docs).where("kept").select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])


#: The longest repeat itself is beyond plain SQL; whether it is over the limit is whether a window of one word more comes twice.
REPORT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) t WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
g AS (SELECT doc_id, k, p, md5(array_to_string(list_slice(w, p, p + k - 1), ' ')) AS h
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (VALUES (3), (8), (201)) v(k) WHERE len(w) >= k) t),
twice AS (SELECT doc_id, k, p FROM (SELECT doc_id, k, p, count(*) OVER (PARTITION BY doc_id, k, h) AS c FROM g) t WHERE c > 1),
on_words AS (SELECT DISTINCT doc_id, k, p + j AS p FROM (SELECT doc_id, k, p, unnest(range(k)) AS j FROM twice WHERE k < 201) t),
n AS (SELECT doc_id, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 8) AS n8 FROM on_words GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n3, 0) AS n_repeat_words, coalesce(n8, 0) AS covered_words, d.doc_id IN (SELECT doc_id FROM twice WHERE k = 201) AS long_repeat
      FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT long_repeat AND 10 * covered_words <= 3 * n_words AS kept, covered_words, long_repeat FROM f
"""
