"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios (operator 6).

A text's features are its different character n-grams (of the bytes of the
lower-cased text, everything but letters and digits being a blank), hashed to
``2**BITS`` buckets. A feature's scale is the log ratio of its smoothed
document counts in the two classes, shrunk by z² / (z² + ``NOISE``²) where z is
by how many standard deviations the counts differ from the classes' shares: a
ratio that chance may have made counts little. Every feature of at least two
texts takes part. A logistic regression with a ridge is fitted on the scaled
features, and its intercept set to the classes' shares among all training labels.

Labels are learned from at most ``POSITIVES`` and ``NEGATIVES`` labelled rows,
those of the smallest hash of doc_id (documented bound; whole texts are used).
The fit goes over the sample's features where they lie, in ``PARTS`` tasks that
give their part of the gradient. So what comes to the driver at once is at most
2**BITS counts, or that many numbers from each of those tasks, whatever the
lengths of the texts.
Every document is scored over its whole text. Labels, lang, source and doc_id
are never inputs of a score.

Results in odd cases: a null or empty text has no features and gets the score
of the intercept; a document with several labels counts as toxic if one says
so; labels that are null or without a document are ignored; if the training
labels have one class only, that class's share (0 or 1) is every score, and
without any label it is 0; rows are scored one by one, so repeated rows and
null doc_ids stay; further columns are ignored by ``score`` and kept by
``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import drop_path, settled, unused
from quadrat.llm.shingles import pieces

SIZES, BITS = (4, 5, 6), 20
POSITIVES, NEGATIVES = 4000, 8000
NOISE, RIDGE = 6.0, 0.1
FEWEST_TEXTS, PARTS, ROUNDS, TOLERANCE = 2, 16, 60, 1e-3
THRESHOLD = 0.7

_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 3 == 1


def ngrams(texts: pa.Array, wanted: np.ndarray | None = None) -> np.ndarray:
    """text << BITS | feature for each different feature of each text, in order; only wanted ones if given."""
    texts = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_lower(pc.fill_null(texts, "")), pa.scalar(" "), pa.scalar("")).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _PLAIN[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].astype(np.uint32)
    offsets = offsets - offsets[0]
    found = []
    four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    for n in SIZES:
        if len(data) < n:
            continue
        h = four[: len(data) - n + 1] * np.uint32(0x9E3779B1)
        if n > 4:
            h ^= h >> np.uint32(15)
            h += four[n - 4 :]
            h *= np.uint32(0x85EBCA77 + 2 * n)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE3D + 2 * n)
        h >>= np.uint32(32 - BITS)
        at = np.flatnonzero(wanted[h]) if wanted is not None else np.arange(len(h))
        text = np.searchsorted(offsets, at, side="right") - 1 if wanted is not None else np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(at)]
        inside = at + n <= offsets[text + 1]
        found.append(text[inside].astype(np.int64) << BITS | h[at[inside]])
    if not found:
        return np.empty(0, np.int64)
    key = np.concatenate(found)
    key.sort()  # much faster than numpy's unique, which hashes
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return key[new]


@dataclass
class Model:
    weights: np.ndarray  # of length 2**BITS
    intercept: float

    def __post_init__(self):
        self.wanted = self.weights != 0

    def score(self, texts: pa.Array) -> np.ndarray:
        key = ngrams(texts, self.wanted)
        z = self.intercept + np.bincount(key >> BITS, self.weights[key & (1 << BITS) - 1], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by class, summed over the partition."""
    total = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for part in pieces(batch, most_bytes=1 << 18):
            key = ngrams(part.column("text"))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[key >> BITS]
            for c in (0, 1):
                total[c] += np.bincount(key[toxic == c] & (1 << BITS) - 1, minlength=1 << BITS).astype(np.int32)
    feature = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(total[0][feature].astype(np.int64)), pa.array(total[1][feature].astype(np.int64))], ["feature", "negative", "positive"])


def packed(text: np.ndarray, place: np.ndarray, texts: int) -> list[bytes]:
    """Each text's rising places as one byte a step: a step of 255 or more is that many bytes of 255, and the rest."""
    step = np.diff(place, prepend=0)
    new = np.flatnonzero(np.diff(text, prepend=-1))
    step[new] = place[new]
    full = step // 255
    end = np.cumsum(full + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 255, np.uint8)
    out[end - 1] = step % 255
    edge = np.concatenate(([0], end))[np.searchsorted(text, np.arange(texts + 1))]
    return [out[lo:hi].tobytes() for lo, hi in zip(edge, edge[1:], strict=False)]


def unpacked(features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of all texts, and where each text's begin (of length texts + 1)."""
    first = np.frombuffer(features.buffers()[1], np.int32)[features.offset : features.offset + len(features) + 1].astype(np.int64)
    step = np.frombuffer(features.buffers()[2] or b"", np.uint8)[first[0] : first[-1]]
    first, whole = first - first[0], step != 255
    total, count = np.concatenate(([0], np.cumsum(step, dtype=np.int64))), np.concatenate(([0], np.cumsum(whole)))[first]
    return total[1:][whole] - np.repeat(total[first[:-1]], np.diff(count)), count


def _sparse(batches: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each text's features, by the places that they have (-1: none), packed in a row of bytes."""
    wanted = place >= 0
    for batch in batches:
        for part in pieces(batch, most_bytes=1 << 18):
            key = ngrams(part.column("text"), wanted)
            data = packed(key >> BITS, place[key & (1 << BITS) - 1].astype(np.int64), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(data, pa.binary())], ["toxic", "features"])


def scales(negative: np.ndarray, positive: np.ndarray, texts: tuple[int, int], noise: float = NOISE) -> np.ndarray:
    """The shrunk log-count ratio of each feature, of the numbers of negative and positive texts that have it."""
    ratio = np.log((positive + 1.0) / (texts[1] + 2.0)) - np.log((negative + 1.0) / (texts[0] + 2.0))
    n, df, rate = sum(texts), negative + positive, texts[1] / sum(texts)
    squared = (positive - df * rate) ** 2 / np.maximum(df * rate * (1 - rate) * np.maximum(1 - df / n, 0.02), 1e-12)
    return np.where(df > 0, ratio * squared / (squared + noise**2), 0.0)


def _slopes(batches: Iterator[pa.RecordBatch], weights: np.ndarray, intercept: float) -> Iterator[pa.RecordBatch]:
    """One row: the loss of this part's texts, its slope by the intercept, and by each feature's weight (32-bit numbers)."""
    loss, shift, slope = 0.0, 0.0, np.zeros(len(weights))
    for batch in batches:
        for part in pieces(batch, ("features",), 1 << 19):
            y = part.column("toxic").to_numpy().astype(float)
            column, first = unpacked(part.column("features"))
            total = np.concatenate(([0.0], np.cumsum(weights[column])))
            z = intercept + total[first[1:]] - total[first[:-1]]
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            loss += float(np.logaddexp(0, z).sum() - y @ z)
            shift += float(off.sum())
            slope += np.bincount(column, np.repeat(off, np.diff(first)), len(weights))
    yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([shift]), pa.array([slope.astype("<f4").tobytes()], pa.binary())], ["loss", "shift", "slope"])


def least(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE, memory: int = 5) -> np.ndarray:
    """Where a smooth convex function is least, by limited-memory quasi-Newton steps; loss gives its value and gradient."""
    at, (value, slope), steps = start, loss(start), []
    for _ in range(rounds):
        ahead, along = -slope, []
        for step, turn in reversed(steps):
            along.append(step @ ahead / (step @ turn))
            ahead = ahead - along[-1] * turn
        ahead = ahead * (steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1e-12, np.sqrt(slope @ slope)))
        for (step, turn), much in zip(steps, reversed(along), strict=True):
            ahead = ahead + step * (much - turn @ ahead / (step @ turn))
        downhill, length = slope @ ahead, 1.0
        if downhill >= 0:
            break
        while (found := loss(at + length * ahead))[0] > value + 1e-4 * length * downhill and length > 1e-6:
            length /= 4
        if found[0] >= value:
            break
        step, turn = length * ahead, found[1] - slope
        if step @ turn > 0:
            steps = [*steps[1 - memory :], (step, turn)]
        gain, at, (value, slope) = value - found[0], at + step, found
        if gain < tolerance * max(1.0, value):
            break
    return at


def logistic(rows: DataFrame, scale: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression of toxic on the scaled features of rows (toxic, features)."""
    context = rows.sparkSession.sparkContext

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(at[:-1] * scale)  # at most 2**BITS numbers
        intercept, out, slope = float(at[-1]), ridge / 2 * float(at[:-1] @ at[:-1]), ridge * at
        slope[-1] = 0.0
        found = rows.mapInArrow(lambda it: _slopes(it, shared.value, intercept), "loss double, shift double, slope binary").toArrow()  # one row a task
        for part, shift, own in zip(*found.columns, strict=True):
            out += part.as_py()
            slope[-1] += shift.as_py()
            slope[:-1] += scale * np.frombuffer(own.as_buffer(), "<f4")
        shared.destroy()
        return out, slope

    fitted = least(loss, np.zeros(len(scale) + 1))
    return fitted[:-1], float(fitted[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """Fit on the labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return Model(np.zeros(1 << BITS), {(): -700.0, (0,): -700.0, (1,): 700.0}[tuple(share)])
    chosen = None
    for toxic, most in ((1, positives), (0, negatives)):
        own = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most positives + negatives rows of two numbers: small enough to broadcast whatever the tables' sizes.
    rows, path = settled(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxicity-sample"
    )
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        drop_path(spark, path)
        return Model(np.zeros(1 << BITS), 700.0 if size.get(1) else -700.0)
    counted = rows.mapInArrow(_counted, "feature long, negative long, positive long").groupBy("feature").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))
    counted = counted.where(F.col("negative") + F.col("positive") >= FEWEST_TEXTS).toPandas().sort_values("feature")
    ids = counted["feature"].to_numpy()
    scale = scales(counted["negative"].to_numpy(float), counted["positive"].to_numpy(float), (size[0], size[1]))
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(place)  # of fixed size, 2**BITS numbers
    sparse, sparse_path = settled(rows.mapInArrow(lambda it: _sparse(it, shared.value), "toxic int, features binary"), "toxicity-features")
    shared.destroy()
    fitted, intercept = logistic(sparse.coalesce(PARTS), scale)
    drop_path(spark, path)
    drop_path(spark, sparse_path)
    weights = np.zeros(1 << BITS)
    weights[ids] = fitted * scale
    return Model(weights, intercept + float(np.log(share[1] / share[0])) - float(np.log(size[1] / size[0])))


def _scored(batches: Iterator[pa.RecordBatch], model: Model, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, most_bytes=1 << 18):
            yield part.set_column(part.schema.get_field_index(column), column, pa.array(model.score(part.column("text"))))


def with_score(docs: DataFrame, model: Model, column: str = "__score") -> DataFrame:
    """The rows with their texts' scores in that column."""
    out = docs.withColumn(column, F.lit(0.0).cast("double"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, 2**BITS numbers
    return out.mapInArrow(lambda it: _scored(it, shared.value, column), out.schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns."""
    column = unused("__score", docs.columns)
    return with_score(docs, train(docs, labels), column).where(F.col(column) < threshold).drop(column)
