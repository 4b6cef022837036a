"""Packing of token ids into sequences: minimum bin slack (operator 9) and best-fit decreasing (operator 7).

Both run inside the tasks that read the documents: nothing is shuffled, and a
task keeps at most ``POOL`` short pieces at once, so its memory doesn't grow
with the table. Sequence numbers carry the number of the partition, so they
are unique without a count over all data, and the same if a lost task is run
again.

Results in odd cases: a null or empty text is the end id alone; rows are packed
one by one, so repeated rows and null doc_ids are packed as they come; further
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shingles import pieces
from quadrat.llm.tokens import default_path, encoder, with_end

WINDOW = 1024
POOL = 4096
END_ID = 0


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, ids: np.ndarray, start: int, total: int):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total


def closest_fill(count: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length to take for the fullest sum that fits in room.

    Reachable sums are the bits of one integer; each step shifts it by a length times a power of two of copies. The
    states before the steps lead back from the best sum to the copies taken.
    """
    mask, target = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((x for x in count if x <= room), reverse=True):
        left, copies = min(count[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << (length * copies) & mask
            left -= copies
            copies *= 2
        if reach & target:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            at -= length * copies
            taken[length] = taken.get(length, 0) + copies
    return taken


class SlackPacker:
    """Windows filled one after another from a pool of pieces shorter than a window.

    Each window starts with the longest piece, then takes the multiset of lengths that comes closest to the rest. If
    that leaves room while pieces remain, the longest is cut to fill it: only a partition's last window has padding.
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.pool, self.count, self.size = window, {}, {}, 0

    def add(self, piece: Piece) -> None:
        length = len(piece.ids)
        self.pool.setdefault(length, []).append(piece)
        self.count[length] = self.count.get(length, 0) + 1
        self.size += 1

    def _take(self, length: int) -> Piece:
        piece = self.pool[length].pop()
        self.count[length] -= 1
        if not self.count[length]:
            del self.pool[length], self.count[length]
        self.size -= 1
        return piece

    def fill(self, down_to: int = 0) -> Iterator[list[Piece]]:
        while self.size > down_to:
            out = [self._take(max(self.pool))]
            room = self.window - len(out[0].ids)
            for length, copies in closest_fill(self.count, room).items():
                out += [self._take(length) for _ in range(copies)]
                room -= length * copies
            if room and self.pool:
                piece = self._take(max(self.pool))
                out.append(Piece(piece.doc, piece.ids[:room], piece.start, piece.total))
                self.add(Piece(piece.doc, piece.ids[room:], piece.start + room, piece.total))
            yield out


class BestFitPacker:
    """Best-fit decreasing of a pool: longest piece first, into the fullest window that still has room for it.

    The windows' rooms are the leaves of a segment tree over capacities: a node tells whether a window with a room in
    its range exists, so the smallest sufficient room is found in as many steps as the tree is deep.
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.pool = window, []
        self.leaves = 1 << window.bit_length()

    def add(self, piece: Piece) -> None:
        self.pool.append(piece)

    @property
    def size(self) -> int:
        return len(self.pool)

    def fill(self, down_to: int = 0) -> Iterator[list[Piece]]:
        """The windows of all pieces, but that the emptiest ones give up to down_to pieces back to the pool, for a later round."""
        tree, rooms, windows, left = [0] * (2 * self.leaves), {}, [], []
        for piece in sorted(self.pool, key=lambda p: -len(p.ids)):
            room = self._smallest(tree, len(piece.ids))
            if room is None:
                room, at = self.window, len(windows)
                windows.append([])
                left.append(0)
            else:
                at = rooms[room].pop()
                self._change(tree, room, -1)
            windows[at].append(piece)
            room -= len(piece.ids)
            left[at] = room
            if room:
                rooms.setdefault(room, []).append(at)
                self._change(tree, room, 1)
        self.pool = []
        for at in sorted(range(len(windows)), key=lambda i: -left[i]):
            if left[at] and len(self.pool) + len(windows[at]) <= down_to:
                self.pool += windows[at]
            else:
                yield windows[at]

    def _change(self, tree: list[int], room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            tree[node] += by
            node >>= 1

    def _smallest(self, tree: list[int], least: int) -> int | None:
        node = least + self.leaves
        if tree[node]:
            return least
        while node > 1:  # up to the first ancestor with something to the right, then down to the leftmost
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def sequences(batches: Iterator[pa.RecordBatch], packer, path: str, pool: int, end_id: int) -> Iterator[tuple[int, list[Piece]]]:
    """(sequence number, its pieces) of a partition. Whole windows of a document are sequences of their own; only the rest is packed."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    window = packer.window
    for batch in batches:
        for part in pieces(batch, most_bytes=2 << 20, most_rows=4096):
            ids, begin = with_end(*encoder(path).encode(part.column("text")), end_id)
            for doc, lo, hi in zip(part.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                whole = (hi - lo) // window
                for i in range(whole):
                    yield number, [Piece(doc, ids[lo + i * window : lo + (i + 1) * window], i * window, hi - lo)]
                    number += 1
                if lo + whole * window < hi:  # a copy, or a waiting piece would keep the whole batch alive
                    packer.add(Piece(doc, ids[lo + whole * window : hi].copy(), whole * window, hi - lo))
            if packer.size >= pool:
                for out in packer.fill(pool // 4):
                    yield number, out
                    number += 1
    for out in packer.fill():
        yield number, out
        number += 1


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _piece_batches(found: Iterator[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for number, out in found:
        offset = 0
        for p in out:
            rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4", copy=False).tobytes()), p.total, number, offset))
            offset += len(p.ids)
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def pack(docs: DataFrame, window: int = WINDOW, pool: int = POOL, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the CRC-32 of its ids as little-endian 32-bit numbers."""
    path = tokenizer or default_path()
    return _texts(docs).mapInArrow(
        lambda it: _piece_batches(sequences(it, SlackPacker(window), path, pool, end_id)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


_MATRIX = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


def _matrix_batches(found: Iterator[tuple[int, list[Piece]]], window: int, kind: str, pad_id: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    place_kind, most = _position_kind(window), 1 << 8 * np.dtype(kind).itemsize
    if pad_id >= most:
        raise ValueError(f"{kind} holds no id {pad_id}")
    for number, out in found:
        ids = np.full(window, pad_id, kind)
        place = np.zeros(window, place_kind)
        ends = [0]
        for p in out:
            lo, hi = ends[-1], ends[-1] + len(p.ids)
            if p.ids.max() >= most:
                raise ValueError(f"{kind} holds no id {p.ids.max()}")
            ids[lo:hi] = p.ids
            place[lo:hi] = np.arange(hi - lo)
            ends.append(hi)
        place[ends[-1] :] = np.arange(window - ends[-1])
        rows.append((number, ids.tobytes(), ends[-1], ends, place.tobytes(), [p.doc for p in out], [p.start for p in out]))
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MATRIX, strict=True)], schema=_MATRIX)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MATRIX, strict=True)], schema=_MATRIX)


def _position_kind(window: int) -> str:
    return "<u2" if window <= 1 << 16 else "<u4"


def packed_matrix(docs: DataFrame, window: int = WINDOW, pool: int = POOL, tokenizer: str | None = None, end_id: int = END_ID, id_bytes: int = 2, pad_id: int = 0) -> DataFrame:
    """One row per sequence, packed best fit decreasing.

    ids: a row of the id matrix, ``window`` little-endian unsigned numbers of ``id_bytes`` bytes (2 for vocabularies up to
    65,536; a larger id is an error). cu_seqlens: cumulative lengths of its segments, from 0 to n_tokens. positions:
    ``window`` little-endian positions of 16 bits (32 for windows over 65,536), starting again at 0 with each segment and
    with the padding. doc_ids and starts: the document of each segment and its place there, so a document of any length
    can be put together again.
    """
    path = tokenizer or default_path()
    return _texts(docs).mapInArrow(
        lambda it: _matrix_batches(sequences(it, BestFitPacker(window), path, pool, end_id), window, f"<u{id_bytes}", pad_id),
        "sequence_id long, ids binary, n_tokens long, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>",
    )


def write_packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the packed matrix as Parquet under path, position resets included, and give it as read from there.

    Positions count up from 0 again and again, which zstd finds in its pages.
    """
    out = packed_matrix(docs, **options)
    out.write.option("compression", "zstd").parquet(path)
    return out.sparkSession.read.schema(out.schema).parquet(path)
