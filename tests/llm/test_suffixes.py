"""Operators 11 and 12: suffix arrays, periodic runs and repeats against plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat.llm import periodic, repetition
from quadrat.llm.suffixes import Extension, RangeMinimum, SuffixArray, TextWords

few_words = st.lists(st.sampled_from("abc"), max_size=40)


def runs_by_hand(words, least=6, times=4):
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            smallest = all(any(words[k] != words[k + q] for k in range(i, i + length - q)) for q in range(1, p))
            if j > i and length >= max(least, times * p) and smallest:
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeats_by_hand(words, least):
    """(n_words, words in repeated three-word windows, maximal repeats, longest, spans)."""
    n, at, three = len(words), {}, {}
    for i in range(n):
        for k in range(least, n - i + 1):
            at.setdefault(tuple(words[i : i + k]), []).append(i)
        if i + 3 <= n:
            three.setdefault(tuple(words[i : i + 3]), []).append(i)
    on, count, longest = set(), 0, 0
    for own, places in at.items():
        if len(places) > 1:
            on |= {i + k for i in places for k in range(len(own))}
            before = {words[i - 1] if i else None for i in places}
            after = {words[i + len(own)] if i + len(own) < n else None for i in places}
            if len(before) > 1 and len(after) > 1:
                count, longest = count + 1, max(longest, len(own))
    spans = []
    for i in sorted(on):
        if spans and sum(spans[-1]) == i:
            spans[-1] = (spans[-1][0], spans[-1][1] + 1)
        else:
            spans.append((i, 1))
    windows = {i + k for places in three.values() if len(places) > 1 for i in places for k in range(3)}
    return n, len(windows), count, longest, [{"start": a, "length": b} for a, b in spans]


def batch(texts):
    return TextWords(pa.array([" ".join(t) for t in texts], pa.string()))


@settings(max_examples=60, deadline=None)
@given(st.lists(few_words, max_size=5))
def test_suffixes_are_sorted_and_share_their_prefixes(texts):
    words = batch(texts)
    ends = words.first[1:][words.text]
    suffixes = SuffixArray(words.symbols, ends)
    own = [tuple(words.symbols[i : ends[i]]) for i in range(len(ends))]
    assert [own[i] for i in suffixes.order] == sorted(own)
    for r in range(1, len(own)):
        a, b = own[suffixes.order[r - 1]], own[suffixes.order[r]]
        assert suffixes.lcp[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=120), st.data())
def test_range_minimum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    assert RangeMinimum(np.array(values, np.int32)).least(np.array([lo]), np.array([hi]))[0] == min(values[lo : hi + 1])


def test_extensions_both_ways():
    rnd = random.Random(1)
    texts = [[rnd.choice("ab") for _ in range(n)] for n in (2, 60, 90)]
    words, symbols = batch(texts), None
    both, symbols = Extension(words), words.symbols
    for lo, hi in zip(words.first, words.first[1:]):
        for a in range(lo + 1, hi):
            for b in range(a + 1, hi):
                ahead = next((k for k in range(hi - b) if symbols[a + k] != symbols[b + k]), hi - b)
                behind = next((k for k in range(a - lo) if symbols[a - 1 - k] != symbols[b - 1 - k]), a - lo)
                assert both.from_here(np.array([a]), np.array([b]))[0] == ahead
                assert both.up_to(np.array([a]), np.array([b]))[0] == behind


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(few_words, st.lists(st.sampled_from("ab"), min_size=1, max_size=4), st.integers(0, 9), few_words), max_size=4))
def test_runs_equal_the_plain_definition(parts):
    texts = [a + b * times + c for a, b, times, c in parts]
    words = batch(texts)
    got = [(int(t), int(s - words.first[t]), int(n), int(p)) for t, s, n, p in periodic.runs_of(words)]
    assert got == [(t, *r) for t, own in enumerate(texts) for r in runs_by_hand(own)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(few_words, few_words), max_size=4), st.integers(1, 5))
def test_repeats_equal_the_plain_definition(parts, least):
    texts = [a + b + a for a, b in parts]
    got = list(zip(*[x.to_pylist() for x in repetition._repeats(batch(texts), least)], strict=True))
    assert got == [repeats_by_hand(t, least) for t in texts]


def looped_by_hand(doc_id, text):
    words = text.split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_query_on_runs_equals_brute_force(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["la", "lo", "Ü", "x\x0by"]) for _ in range(rnd.choice([0, 1, 5, 60])))) for i in range(150)]
    docs += [(5, docs[5][1]), (200, None), (201, " \n\t "), (202, "na " * 3000), (203, " ".join(map(str, range(2500))))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in periodic.report(periodic.find_runs(periodic.looped(table))).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r))
    assert sum(map(len, got.values())) == len(docs)
    for doc_id, text in docs:
        words = looped_by_hand(doc_id, (text or "").replace("\x0b", " "))
        runs = [(0, len(words), 1)] if doc_id == 202 else runs_by_hand(words) if len(words) < 1000 else []
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want = (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))
        assert got[doc_id][0] == want


def test_odd_rows_and_clashing_names(spark):
    table = spark.createDataFrame([(None, "b b b b b b b", 1, "r"), (1, None, None, None), (1, None, None, None)], "doc_id long, text string, RUNS int, n_words string")
    out = periodic.find_runs(table)
    assert out.columns == ["doc_id", "text", "RUNS", "n_words", "runs_", "collapsed"]
    rows = sorted(out.collect(), key=lambda r: r["doc_id"] is None)
    assert [r["collapsed"] for r in rows] == ["", "", "b"] and rows[-1]["runs_"][0].asDict() == {"start": 0, "length": 7, "period": 1}
    assert rows[-1]["RUNS"] == 1
    assert repetition.find_repeats(table).columns == ["doc_id", "text", "RUNS", "n_words", "n_words_", "n_repeat_words", "n_repeats", "longest_repeat", "repeat_spans"]
    assert periodic.find_runs(table.limit(0)).count() == 0 and repetition.judged(table.limit(0)).count() == 0
    judged = repetition.report(table).orderBy("n_words").collect()
    assert [(r["n_words"], r["base_failed"], r["kept"]) for r in judged] == [(0, True, False), (0, True, False), (7, True, False)]
    assert repetition.drop_repetitive(table).columns == table.columns


@pytest.mark.parametrize(
    ("text", "failed", "kept"),
    [
        (" ".join(map(str, range(50))), False, True),
        (" ".join(map(str, range(49))), True, False),
        (" ".join([*map(str, range(100)), *map(str, range(100))]), True, False),  # everything comes twice
        (" ".join([*map(str, range(400)), *map(str, range(30))]), False, True),  # 60 of 430 words
        (" ".join([*map(str, range(400)), *map(str, range(80))]), False, False),  # 160 of 480 words
        (" ".join([*map(str, range(2000)), *map(str, range(200))]), False, True),
        (" ".join([*map(str, range(2000)), *map(str, range(201))]), False, False),  # longer than any repeat may be
    ],
)
def test_verdicts(spark, text, failed, kept):
    row = repetition.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["base_failed"], row["kept"]) == (failed, kept)


def test_base_numbers(spark):
    text = "a# b$\n\n  \na# b$\nÄé\x0bc|\n a# b$"
    row = repetition.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"]) == (8, 16, 7, 1)


def test_a_planted_loop_goes(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, clean), (2, clean + " buy now" * 30)], "doc_id long, text string")
    assert [r["doc_id"] for r in repetition.drop_repetitive(docs).collect()] == [1]
    looped = periodic.find_runs(docs).where("doc_id = 2").select("runs", F.length("collapsed").alias("n")).first()
    assert [tuple(r) for r in looped["runs"]] == [(60, 60, 2)] and looped["n"] == len(clean + " buy now")
