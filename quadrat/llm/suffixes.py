"""Suffix arrays over the words of many texts at once, with numpy inside Spark tasks.

A word is a run of characters that are no ASCII white space, compared byte by byte. A word's symbol belongs to its own
text, so a suffix never meets one of another text and no common prefix goes beyond a text's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quadrat.llm.common import text_of, unused

BLOCK = 16


def spans(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many items: the group of each item, and its place in the group."""
    group = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return group, np.arange(len(group)) - first[group]


class TextWords:
    """The words of some texts: words (flat), first (where each text's words begin, of length texts + 1), symbols."""

    def __init__(self, texts: pa.Array):
        texts = pc.ascii_trim_whitespace(pc.fill_null(texts, "").cast(pa.string()))
        lists = pc.ascii_split_whitespace(texts)
        flat = pc.list_flatten(lists)
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if empty.any():  # an empty text is split to one empty word
            flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
            count[empty] = 0
        self.words = flat
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.text = np.repeat(np.arange(len(count)), count)
        symbol = flat.dictionary_encode()
        self.symbols = self.text * max(1, len(symbol.dictionary)) + symbol.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Each text's kept words with one space between."""
        total = np.concatenate(([0], np.cumsum(kept)))[self.first]
        lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), self.words.filter(pa.array(kept, pa.bool_())))
        return pc.binary_join(lists, " ")


class SuffixArray:
    """order: suffixes in their order; place: where each suffix stands there; lcp: words that each shares with the one before.

    Suffixes that the first h words tell apart have their place; those that are tied are sorted by their next h words, for h
    = 1, 2, 4 and so on. The places after each round also give the common prefixes.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        """ends: of each symbol the place where its text ends."""
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        new = np.ones(n, bool)
        new[1:] = symbols[order[1:]] != symbols[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
        tied = np.flatnonzero(~(new & np.append(new[1:], True))) if n else np.empty(0, np.int64)
        levels, h = [rank.astype(np.int32)], 1
        while len(tied):
            at = order[tied]
            after = at + h
            following = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[at] * (n + 1) + following
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[tied] = at
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            tied = tied[~(new & np.append(new[1:], True))]
            h *= 2
            levels.append(rank.astype(np.int32))
        self.order, self.place = order, rank
        self.lcp = self._common(levels)

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words shared by neighbours in the order: the longest power of two first, then the rest of the way."""
        n = len(self.order)
        shared = np.zeros(n, np.int32)
        rows = np.flatnonzero(levels[0][self.order[1:]] == levels[0][self.order[:-1]]) + 1 if n else np.empty(0, np.int64)
        a, b = self.order[rows], self.order[rows - 1]
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            shared[rows[same]] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        return shared


class RangeMinimum:
    """Least value of any range: by a table of doubled ranges over blocks, and running minima inside the blocks."""

    def __init__(self, values: np.ndarray):
        n, most = len(values), np.iinfo(np.int32).max
        self.values = values
        padded = np.full(-(-max(n, 1) // BLOCK) * BLOCK, most, np.int32)
        padded[:n] = values
        blocks = padded.reshape(-1, BLOCK)
        self.fore = np.minimum.accumulate(blocks, axis=1).ravel()
        self.back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table, width = [blocks.min(axis=1)], 1
        while 2 * width <= len(blocks):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo] to values[hi], both included."""
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.back[lo], self.fore[hi])
        inner = np.flatnonzero(last - first > 1)
        if len(inner):
            a, b = first[inner] + 1, last[inner] - 1
            size = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            for k in np.unique(size):
                own = size == k
                some, table = inner[own], self.table[k]
                out[some] = np.minimum(out[some], np.minimum(table[a[own]], table[b[own] - (1 << int(k)) + 1]))
        near = np.flatnonzero(first == last)
        if len(near):
            low, high = lo[near], hi[near]
            least = self.values[low]
            for step in range(1, BLOCK):
                on = low + step <= high
                least = np.where(on, np.minimum(least, self.values[np.minimum(low + step, len(self.values) - 1)]), least)
            out[near] = least
        return out


class Extension:
    """How far two places of one text agree: forward by the suffix array, backward by that of the reversed words."""

    def __init__(self, words: TextWords):
        n, first = len(words.symbols), words.first
        self.n = n
        self.forward = SuffixArray(words.symbols, first[1:][words.text])
        self.ahead = RangeMinimum(self.forward.lcp)
        self.backward = SuffixArray(np.ascontiguousarray(words.symbols[::-1]), (n - first[:-1])[words.text[::-1]])
        self.behind = RangeMinimum(self.backward.lcp)

    @staticmethod
    def _agree(suffixes: SuffixArray, minima: RangeMinimum, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = suffixes.place[a], suffixes.place[b]
        return minima.least(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)

    def from_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree at a and b (different places of one text) and after."""
        return self._agree(self.forward, self.ahead, a, b)

    def up_to(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before a and before b. Both are places of one text that don't begin it."""
        return self._agree(self.backward, self.behind, self.n - a, self.n - b)


def _slices(batch: pa.RecordBatch, text: pa.Array, most_bytes: int = 3 << 19, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of text (a longer text is a slice of its own) and rows."""
    end = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(end[at - 1]) if at else 0
        to = max(at + 1, min(at + most_rows, int(np.searchsorted(end, done + most_bytes, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def with_columns(docs: DataFrame, text: Column | str, added: dict[str, str], found: Callable[[TextWords], list[pa.Array]]) -> DataFrame:
    """All columns of docs and those that found gives for the words of each text (name and type in added).

    A name that docs have already, in any spelling, gets underscores. A null text counts as empty.
    """

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, batch.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0), *found(TextWords(part.column(1)))], ["own", *added])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), text_of(text).alias("text"))
    kinds = StructType([row.schema["own"], *[StructField(name, _parse_datatype_string(kind)) for name, kind in added.items()]])
    out = row.mapInArrow(computed, kinds)
    return out.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns], *[F.col(c).alias(unused(c, docs.columns)) for c in added])
