"""Documents that hold benchmark items, by SimHash windows and exact verification (operator 8).

An item of w words has w - 4 five-word shingles; a passage counts as a leak of
it if the weighted Jaccard similarity of some window of the document, of any
length, is 0.8 or more. Windows as long as the item, at every place, and the
items are fingerprinted with a 64-bit SimHash of their shingles. Multi-index
blocks (radius + 1 blocks of the 64 bits, one of which must be equal) find every
pair of fingerprints within the radius; each proposes an item and a place, and
exact weighted-shingle similarity of all windows around that place decides.

A passage at 0.8 can be further away than any useful radius. But it keeps an
unchanged run of ``clean_run`` words of the item. So there are shorter windows
too, in classes of a length and a stride such that one of them lies within the
run wherever it begins; they are fingerprinted and looked up in the same way.
Together they lose no leak, whatever its length or place.

Before that, texts with fewer of the items' shingles than any leak shares are
set aside, and so are item-sized windows with too few of them (least squared of
theirs: a leak may be up to 1 / least times as long as the item) and run windows
with any other shingle; this loses nothing.

The items are read in blocks of bounded size, each held against all documents
in one scan of its own, and its broadcast is destroyed after that; so a
benchmark of any size is handled and no more than one block is ever broadcast.
With one block, the usual case, a document's text never leaves its task: there
is no shuffle. With several, the finds of each are written and joined to the
documents by doc_id and text hash.

Results in odd cases: a null or empty text holds nothing; items of fewer than
five words are one shingle of all their words and count where those stand in a
row; items without words are ignored; equal items are all named; rows are
judged one by one, so repeated rows and null doc_ids stay; further columns are
ignored by ``find_leaks`` and kept by ``drop_leaks``; with an empty table of
items no document is a leak.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from copy import copy
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import settled, unused
from quadrat.llm.shingles import WORDS, U, Words, mix, mix_step, pieces

RADIUS, RUN_RADIUS = 7, 3
BLOCK_WORDS = 1_000_000  # words of benchmark items held against the documents at once; under 100 MB in each task


def clean_run(words: int, least: float = 0.8, repeat: int = 0) -> int:
    """Words in a row that any passage at that similarity to an item of so many words leaves unchanged.

    Of the item's s shingles l are lost, and the passage has e others: (s - l) / (s + e) >= least. Between two unchanged
    runs stand at least four others, or 4 - repeat if a run of that many words stands in the item at two places. So j cuts
    leave l <= s (1 - least) - least j (4 - repeat), and one of j + 1 runs has its share of the s - l shingles that are kept.
    """
    if words <= WORDS or repeat >= WORDS - 1:
        return min(words, WORDS)
    s, cut = words - WORDS + 1, least * (WORDS - 1 - repeat)
    spare = s * (1 - least) + 1e-9
    return WORDS - 1 + min(-((int(spare - j * cut) - s) // (j + 1)) for j in range(int(spare / cut) + 1))


def simhash(windows: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of shingle hashes: bit by bit the majority, a draw counting as 1.

    The counters of all 64 bits are kept as bit planes, so an addition is a few operations on whole words.
    """
    n, m = windows.shape
    planes: list[np.ndarray] = []
    for j in range(m):
        carry = windows[:, j].copy()
        for i, plane in enumerate(planes):
            planes[i], carry = plane ^ carry, plane & carry
        if len(planes) < (j + 1).bit_length():
            planes.append(carry)
    half = (m + 1) // 2  # counts of at least half, as a comparison from the highest plane down
    over, level = np.zeros(n, U), np.full(n, ~U(0), U)
    for i in reversed(range(len(planes))):
        if half >> i & 1:
            level &= planes[i]
        else:
            over |= level & planes[i]
            level &= ~planes[i]
    return over | level


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, by first word; runs over a text's end are not told apart here."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U)
    run = np.zeros(n, U)
    for j in range(size):
        run += mix_step(words[j : n + j], j)
    return mix(run if size == WORDS else run + U(size))


class ItemIndex:
    """Fingerprints of the items and of their runs, by window length, with the tables of their blocks."""

    def __init__(self, items: list[tuple[int, str]], least: float = 0.8, radius: int = RADIUS, run_radius: int = RUN_RADIUS):
        self.least, self.radius, self.run_radius = least, radius, run_radius
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.size_of = np.minimum(np.diff(words.first), WORDS).tolist()
        self.shingles: list[Counter] = []
        sized: dict[tuple[int, int], list[int]] = {}
        runs: dict[tuple[int, int, int], list[int]] = {}
        own_words = [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(items))]
        for i, own in enumerate(own_words):
            size = min(WORDS, len(own))
            self.shingles.append(Counter(_rolling(own, size).tolist()) if size else Counter())
            if size:
                sized.setdefault((size, len(own)), []).append(i)
                repeat = sum(len(np.unique(r)) < len(r) for r in (_rolling(own, n) for n in range(1, WORDS)))
                run = clean_run(len(own), least, repeat)
                floor = 6 * 2 ** int(math.log2(run / 6)) if run >= 12 else 8 if run >= 8 else min(run, WORDS)
                window = max(size, floor * 5 // 8)
                runs.setdefault((size, window, floor - window + 1), []).append(i)
        #: Items of one length: their windows are the items themselves.
        self.sized = [(size, n, self._tables(np.concatenate([simhash(_rolling(own_words[i], size)[None, :]) for i in members]), np.array(members), np.zeros(len(members), np.int64), radius)) for (size, n), members in sized.items()]
        #: Windows that lie within the run of an item that a similar passage leaves unchanged.
        self.runs = []
        for (size, window, stride), members in runs.items():
            prints, item, place = [], [], []
            for i in members:
                at = np.arange(len(own_words[i]) - window + 1)
                prints.append(simhash(_rolling(own_words[i], size)[at[:, None] + np.arange(window - size + 1)]))
                item.append(np.full(len(at), i))
                place.append(at)
            self.runs.append((size, window, stride, self._tables(np.concatenate(prints), np.concatenate(item), np.concatenate(place), run_radius)))
        #: The items' shingles by size, with a table of their lowest bits, and the fewest that a leak shares.
        self.known = {}
        for size in {s for s, *_ in self.sized}:
            hashes = np.unique(np.concatenate([_rolling(own_words[i], size) for (s, _), members in sized.items() if s == size for i in members]))
            table = np.zeros(1 << 22, bool)
            table[(hashes & U((1 << 22) - 1)).astype(np.int64)] = True
            fewest = min(math.ceil((n - size + 1) * least - 1e-9) for s, n in sized if s == size)
            self.known[size] = hashes, table, fewest

    def _tables(self, prints: np.ndarray, item: np.ndarray, place: np.ndarray, radius: int):
        tables, cuts = [], [64 * b // (radius + 1) for b in range(radius + 2)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            block = (prints >> U(lo)) & U((1 << (hi - lo)) - 1)
            order = np.argsort(block, kind="stable")
            tables.append((lo, hi - lo, np.bincount(block.astype(np.int64), minlength=(1 << (hi - lo)) + 1).cumsum() if hi - lo <= 16 else None, block[order], order))
        return prints, item, place, tables

    def proposals(self, prints: np.ndarray, index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, item, place in the item) whose fingerprints differ in at most as many bits as the index has blocks but one."""
        own, item, place, tables = index
        radius = len(tables) - 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for shift, bits, ends, ordered, order in tables:
            block = (prints >> U(shift)) & U((1 << bits) - 1)
            if ends is not None:
                b = block.astype(np.int64)
                to = ends[b]
                begin = np.where(b > 0, ends[b - 1], 0)
            else:
                begin, to = np.searchsorted(ordered, block, "left"), np.searchsorted(ordered, block, "right")
            hit = np.flatnonzero(to > begin)
            count = (to - begin)[hit]
            which = np.repeat(hit, count)
            at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[hit], count)]
            near = np.bitwise_count(prints[which] ^ own[at]) <= radius
            found.append((which[near], at[near]))
        which, at = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(which):
            which, at = np.unique(np.stack([which, at]), axis=1)
        return which, item[at], place[at]

    def _marked(self, words: Words, rolled: np.ndarray, size: int) -> np.ndarray:
        """For each place, how many shingles of the items begin before it; those over a text's end don't count."""
        hashes, table, _ = self.known[size]
        at = np.flatnonzero(table[(rolled & U((1 << 22) - 1)).astype(np.int64)])
        spot = np.searchsorted(hashes, rolled[at])
        at = at[hashes[np.minimum(spot, len(hashes) - 1)] == rolled[at]]
        at = at[words.first[np.searchsorted(words.first, at, side="right")] >= at + size]
        count = np.zeros(len(words.hash) + 1, np.int64)
        count[at + 1] = 1
        return np.cumsum(count)

    def leaks(self, words: Words) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, number of words, similarity) of the best window of each text and item that reaches the limit."""
        hot = np.zeros(len(words.first) - 1, bool)
        for size, (_, _, fewest) in self.known.items():
            hot |= np.diff(self._marked(words, _rolling(words.hash, size), size)[words.first]) >= fewest
        if not hot.any():
            return []
        # Only texts with as many of the items' shingles as some leak needs go further.
        texts = np.flatnonzero(hot)
        own = copy(words)
        own.hash = words.hash[np.repeat(hot, np.diff(words.first))]
        own.first = np.concatenate(([0], np.cumsum(np.diff(words.first)[hot])))
        return [(int(texts[t]), i, begin, n, score) for t, i, begin, n, score in self._hot_leaks(own)]

    def _hot_leaks(self, words: Words) -> list[tuple[int, int, int, int, float]]:
        length = np.diff(words.first)
        text = np.repeat(np.arange(len(length)), length)
        end = words.first[1:][text]
        rolled = {size: _rolling(words.hash, size) for size in self.known}
        marked = {size: self._marked(words, rolled[size], size) for size in self.known}
        ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def look_up(at: np.ndarray, size: int, n: int, index, before: float, after: int) -> None:
            """Windows of n words at those places; of what they propose, windows that begin from before (times the item's shingles) to after are verified."""
            for lo in range(0, len(at), 1 << 15):
                own = at[lo : lo + (1 << 15)]
                which, item, _ = self.proposals(simhash(rolled[size][own[:, None] + np.arange(n - size + 1)]), index)
                for t, i, x in zip(text[own[which]].tolist(), item.tolist(), own[which].tolist(), strict=True):
                    ranges.setdefault((t, i), []).append((x + n - size - int(self.shingles[i].total() * before), x + after))

        for size, n, index in self.sized:
            s = n - size + 1
            at = np.flatnonzero(np.arange(len(text)) + n <= end)
            at = at[marked[size][at + s] - marked[size][at] >= s * self.least**2]
            look_up(at, size, n, index, 1 + 1 / self.least, s)
            for n_short in np.unique(length[(length < n) & (length - size + 1 >= s * self.least - 1e-9)]).tolist():  # texts that are no longer than a leak: whole
                look_up(words.first[:-1][length == n_short], size, n_short, index, 1 + 1 / self.least, s)
        for size, n, stride, index in self.runs:
            m = n - size + 1
            count = np.where(length >= n, (length - n) // stride + 1, 0)
            at = np.repeat(words.first[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * stride
            at = at[marked[size][at + m] - marked[size][at] == m]
            look_up(at, size, n, index, 1 / self.least, 0)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for (t, i), own in ranges.items():
            self._verify(words, t, i, sorted(own), rolled, best)
        return [(t, i, begin - int(words.first[t]), n, s) for (t, i), (s, begin, n) in sorted(best.items())]

    def _verify(self, words, t, i, ranges, rolled, best):
        """All windows that begin in the ranges, held against the item's shingles exactly: the best begins and ends with one of them."""
        want, size = self.shingles[i], self.size_of[i]
        total = want.total()
        need, most = math.ceil(total * self.least - 1e-9), int(total / self.least + 1e-9)
        done, last = int(words.first[t]), int(words.first[t + 1]) - size + 1
        for lo, hi in ranges:
            if best.get((t, i), (0.0,))[0] == 1.0:
                return
            begin, done = max(done, lo), max(done, hi + 1)
            span = rolled[size][begin : min(hi + most, last)].tolist()
            hits = list(accumulate((h in want for h in span), initial=0))
            for k in range(min(hi - begin + 1, len(span))):
                if hits[k + 1] == hits[k] or hits[min(k + most, len(span))] - hits[k] < need:
                    continue
                left, shared = dict(want), 0
                for m, h in enumerate(span[k : k + most], 1):
                    if not left.get(h):
                        continue
                    left[h] -= 1
                    shared += 1
                    score = shared / (m + total - shared)
                    if score >= self.least and score > best.get((t, i), (0.0,))[0]:
                        best[t, i] = (score, begin + k, m + size - 1)


def _blocks(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND trim(text) <> ''").orderBy("item_id", "text").toLocalIterator()
    block, words = [], 0
    for item, text in rows:
        block.append((item, text))
        words += text.count(" ") + text.count("\n") + 1
        if words >= most_words:
            yield block
            block, words = [], 0
    if block:
        yield block


_LEAKS = "array<struct<item_id:long,first_word:long,words:long,similarity:double>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch], index: ItemIndex, column: str) -> Iterator[pa.RecordBatch]:
    """The rows with what their texts hold in that column."""
    for batch in batches:
        for part in pieces(batch):
            found: list[list] = [[] for _ in range(part.num_rows)]
            for t, i, begin, n, score in index.leaks(Words(part.column("text"))):
                found[t].append({"item_id": index.ids[i], "first_word": begin, "words": n, "similarity": score})
            yield part.set_column(part.schema.get_field_index(column), column, pa.array(found, _KIND))


def with_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = RADIUS, block_words: int = BLOCK_WORDS, column: str = "__leaks") -> DataFrame:
    """The rows of docs with a column of the items that each text holds."""
    spark = docs.sparkSession
    none = F.expr(f"cast(array() as {_LEAKS})")
    blocks = _blocks(benchmark, block_words)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return docs.withColumn(column, none)
    if following is None:
        out, index = docs.withColumn(column, none), spark.sparkContext.broadcast(ItemIndex(block, least, radius))
        return out.mapInArrow(lambda it: _scan(it, index.value, column), out.schema)
    key = [F.col("doc_id").alias("d"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")]
    rows, finds = docs.select("doc_id", "text", none.alias(column)), None
    while block is not None:
        index = spark.sparkContext.broadcast(ItemIndex(block, least, radius))
        found = rows.mapInArrow(lambda it, index=index: _scan(it, index.value, column), rows.schema).where(F.size(column) > 0).select(*key, F.col(column).alias("found")).distinct()
        found, _ = settled(found, "leaks")
        index.destroy()
        finds = found if finds is None else finds.unionByName(found)
        block, following = following, next(blocks, None)
    finds = finds.groupBy("d", "t1", "t2").agg(F.flatten(F.collect_list("found")).alias("found"))
    own = [unused(n, [*docs.columns, column]) for n in ("d", "t1", "t2", "found")]
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(key, own, strict=False)])
    finds = finds.toDF(*(f"{n}_r" for n in own))
    met = keyed.join(finds, F.col(own[0]).eqNullSafe(F.col(f"{own[0]}_r")) & (F.col(own[1]) == F.col(f"{own[1]}_r")) & (F.col(own[2]) == F.col(f"{own[2]}_r")), "left")
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(f"{own[3]}_r"), none).alias(column))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, leaks, n_leaks): one row per row of docs."""
    out = with_leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, least)
    return out.select("doc_id", F.array_sort("__leaks").alias("leaks"), F.size("__leaks").cast("long").alias("n_leaks"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    column = unused("__leaks", docs.columns)
    return with_leaks(docs, benchmark, least, column=column).where(F.size(column) == 0).drop(column)
