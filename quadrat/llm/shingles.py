"""Words and word shingles of many texts at once, hashed with numpy inside Spark tasks.

A word is a run of bytes that are no ASCII white space, of the lower-cased text.
A shingle is five words in a row; a text of one to four words is one shingle of
all of them, a text without words has none.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every other."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U)
    return _powers


class Words:
    """The words of some texts: hash of each, where each text's words begin (first, of length texts + 1)."""

    def __init__(self, texts: pa.Array, spans: bool = False):
        texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)
        offsets = offsets - (offsets[0] if n else 0)
        blank = _SPACE[data]
        edge = np.ones(len(data) + 1, bool)  # a word can begin here: after a blank, or where a text begins
        edge[1:] = np.append(blank[:-1], True) if len(data) else True
        edge[1 : len(data) + 1] = blank
        cut = offsets[:-1][offsets[:-1] < len(data)]
        begins = edge[: len(data)].copy()
        begins[cut] = True
        begins &= ~blank
        ends = np.ones(len(data), bool)
        if len(data):
            ends[:-1] = blank[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            ends[inner - 1] = True
            ends &= ~blank
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _powers_to(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=total[1:])
        self.hash = mix((total[end] - total[start]) * inverse[start])
        self.first = np.searchsorted(start, offsets)
        self.start, self.end, self.offsets = (start, end, offsets) if spans else (None, None, None)

    def shingles(self, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each shingle, and where each text's shingles begin."""
        h, first = self.hash, self.first
        words = np.diff(first)
        count = np.where(words >= size, words - size + 1, (words > 0).astype(words.dtype))
        begin = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
        if len(h) >= size:
            run = np.zeros(len(h), U)
            for j in range(size):
                run[: len(h) - size + 1] += mix_step(h[j : len(h) - size + 1 + j], j)
            out = mix(run)[at]
        else:
            out = np.zeros(begin[-1], U)
        for d in np.flatnonzero((words > 0) & (words < size)):
            own = h[first[d] : first[d + 1]]
            out[begin[d]] = mix(np.array([sum(int(mix_step(own[j : j + 1], j)[0]) for j in range(len(own))) + len(own) & (1 << 64) - 1], U))[0]
        return out, begin

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each text's sequence of words, as two int64 arrays; 0 and 0 for a text without words."""
        place = (np.arange(len(self.hash)) - np.repeat(self.first[:-1], np.diff(self.first))).astype(U)
        out = []
        for salt in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7):
            total = np.zeros(len(self.hash) + 1, U)
            np.cumsum(mix(self.hash ^ mix(place * U(2) + U(salt))), out=total[1:])
            out.append((total[self.first[1:]] - total[self.first[:-1]]).view(np.int64))
        return out[0], out[1]


_FACTORS = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


def mix_step(h: np.ndarray, place: int) -> np.ndarray:
    return h * _FACTORS[place % 5] + U(place)


def units(shingle: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's multiset of shingles as a set: the j-th copy of a shingle is a unit of its own.

    Gives text (its index in the batch) and hash of each unit, sorted by text, and each text's number of units.
    At most 4096 texts at once.
    """
    count = np.diff(begin)
    key = np.repeat(np.arange(len(count), dtype=U) << U(52), count) | (shingle >> U(12))
    key.sort()
    if len(key):
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        again = np.flatnonzero(~new)
        hashed = key & U((1 << 52) - 1)
        if len(again):
            at = np.arange(len(key))
            run = np.maximum.accumulate(np.where(new, at, 0))
            hashed[again] = mix(hashed[again] ^ ((at - run)[again].astype(U) << U(52))) >> U(12)
    else:
        hashed = key
    return (key >> U(52)).astype(np.int64), hashed, count


def similarity(left: pa.Array, right: pa.Array, size: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts; 0 where either has none. At most 4096 pairs."""
    sides, totals = [], []
    for texts in (left, right):
        text, hashed, count = units(*Words(texts).shingles(size))
        sides.append((text.astype(U) << U(52)) | hashed)
        totals.append(count)
    both = np.concatenate(sides)
    both.sort()
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> U(52)).astype(np.int64), minlength=len(left)) if len(both) else np.zeros(len(left), np.int64)
    return shared / np.maximum(totals[0] + totals[1] - shared, 1)


def _release() -> None:
    """Give freed memory back to the system: an executor keeps its Python workers, and theirs is bounded together with the JVM's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, columns: tuple[str, ...] = ("text",), most_bytes: int = 1 << 20, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of text (a longer text is a slice of its own) and rows."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    end = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        done = int(end[at - 1]) if at else 0
        to = max(at + 1, min(at + most_rows, int(np.searchsorted(end, done + most_bytes, side="right"))))
        yield batch.slice(at, to - at)
        at = to
    _release()
