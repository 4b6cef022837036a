"""Classifiers of reads that are trained here: a minimizer index with lowest common ancestors, and naive Bayes over k-mers.

Minimizers. Of each window of k letters the smallest of its l-letter words stands for the window (words of both strands, in
the order of ``LETTERS``, which puts runs of a single A last). The index has one row for each word: the lowest common
ancestor of the lineages that hold it, as an aggregate, so a word of all references is one row like any other. A read's
windows give counts to those ancestors; the lineage with the most counts on its way from the root wins.

Naive Bayes. A word of eight letters counts once a sequence. With n of N training sequences having it, its prior is
(n + 0.5) / (N + 1); a genus of M sequences, m of which have it, gives it the probability (m + prior) / (M + 1). Only words
that a genus has are rows; all others are in a sum over the read's priors. Support of a name is the share of trials, each
with an eighth of the read's words as picked by a hash, that give the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.rounds import Rounds

LETTERS = "CTGA"
WINDOW, WORD = 35, 31
BAYES_WORD, TRIALS, PART = 8, 100, 8
BLOCK_WORDS, MOST_GAINS = 400_000, 4_000_000  # words of a block of reads, gains of a part of the genera
_CODE = np.full(256, 4, np.int64)
for _i, _letter in enumerate(LETTERS):
    _CODE[[ord(_letter), ord(_letter.lower())]] = _i
#: The complement of each letter, as places in LETTERS.
_COMPLEMENT = np.array([LETTERS.index({"A": "T", "C": "G", "G": "C", "T": "A"}[x]) for x in LETTERS] + [4])


def _codes(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of so many letters the smaller code of its two strands, and whether all its letters are known."""
    base = _CODE[text]
    n = len(base) - size + 1
    ahead, back, unknown = np.zeros(n, np.int64), np.zeros(n, np.int64), np.concatenate(([0], np.cumsum(base == 4)))
    other = _COMPLEMENT[base]
    for j in range(size):
        ahead = ahead * 4 + base[j : j + n]
        back = back * 4 + other[size - 1 - j : size - 1 - j + n]
    return np.minimum(ahead, back), unknown[size:] == unknown[:-size]


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of so many values, by doubled widths."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    column = pc.fill_null(batch.column("seq"), "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        yield data[lo:hi]


def _minimized(batches: Iterator[pa.RecordBatch], k: int, size: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, words, counts, held = [], [], [], 0
        for i, text in enumerate(_texts(batch)):
            for lo in range(0, max(len(text) - k + 1, 0), most):  # parts overlap by k - 1 letters
                code, known = _codes(text[lo : lo + most + k - 1], size)
                least = _least_of(code, k - size + 1)
                word, count = np.unique(least[~(_least_of(known.astype(np.int8), k - size + 1) == 0)], return_counts=True)
                rows.append(np.full(len(word), i))
                words.append(word)
                counts.append(count)
                held += len(word)
            if held > most or i == batch.num_rows - 1:
                at = np.concatenate(rows) if rows else np.empty(0, np.int64)
                word, count = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (words, counts))
                yield pa.RecordBatch.from_arrays([batch.column("own").take(pa.array(at)), pa.array(word), pa.array(count)], ["own", "minimizer", "n"])
                rows, words, counts, held = [], [], [], 0


def minimizers(sequences: DataFrame, k: int = WINDOW, size: int = WORD) -> DataFrame:
    """The columns of sequences but seq, with minimizer and n, the number of windows that it stands for.

    A row for each different minimizer of a sequence (of each million letters of a longer one). Windows with other letters
    than a, c, g and t are left out; so are sequences shorter than k. size is at most 31.
    """
    others = [c for c in sequences.columns if c != "seq"]
    row = sequences.select(F.struct(*others).alias("own"), "seq")
    out = row.mapInArrow(lambda it: _minimized(it, k, size), f"own {row.schema['own'].dataType.simpleString()}, minimizer long, n long")
    return out.select("own.*", "minimizer", "n")


def word_text(code: Column, size: int) -> Column:
    """A minimizer's letters."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), size, "0"), "0123", LETTERS)


def common_ancestor(first: Column, last: Column) -> Column:
    """What the smallest and the largest of some lineages (arrays from the root) share, so what all of them share."""
    size = F.least(F.size(first), F.size(last))
    depth = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= size) & F.get(first, i - 1).eqNullSafe(F.get(last, i - 1)), i).otherwise(n))
    return F.slice(first, 1, depth)


def minimizer_index(references: DataFrame, k: int = WINDOW, size: int = WORD) -> DataFrame:
    """(minimizer, lineage, n_lineages): references are (lineage, seq); lineage is an array of names from the root down.

    A reference without a lineage counts as one at the root.
    """
    words = minimizers(references.select(F.coalesce("lineage", F.array().cast("array<string>")).alias("lineage"), "seq"), k, size)
    each = words.groupBy("minimizer", "lineage").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("minimizer").agg(F.min("lineage").alias("first"), F.max("lineage").alias("last"), F.count(F.lit(1)).alias("n_lineages"))
    return each.select("minimizer", common_ancestor(F.col("first"), F.col("last")).alias("lineage"), "n_lineages")


def classified_reads(reads: DataFrame, index: DataFrame, k: int = WINDOW, size: int = WORD, confidence: float = 0.0) -> DataFrame:
    """(read, lineage, score, hits, windows): reads are (read, seq).

    score is the number of the read's windows that lie on the way from the root to the lineage, hits those found in the index,
    windows all. Of lineages with equal scores their common ancestor is taken. With a confidence, the name goes up until its
    subtree has that share of all windows. A read without a hit has a null lineage; reads with equal names are one read.
    """
    words = minimizers(reads.select("read", "seq"), k, size)
    totals = words.groupBy("read").agg(F.sum("n").alias("windows"))
    hits = words.groupBy("read", "minimizer").agg(F.sum("n").alias("n")).join(index.select("minimizer", "lineage"), "minimizer")
    hits = hits.groupBy("read", "lineage").agg(F.sum("n").alias("n"))
    # what each lineage has on its way from the root: its prefixes meet the hits of the same read
    way = hits.select("read", "lineage", F.explode(F.transform(F.sequence(F.lit(0), F.size("lineage")), lambda i: F.slice("lineage", 1, i))).alias("up"))
    scores = way.join(hits.select("read", F.col("lineage").alias("up"), "n"), ["read", "up"]).groupBy("read", "lineage").agg(F.sum("n").alias("score"))
    best = scores.withColumn("best", F.max("score").over(Window.partitionBy("read"))).where("score = best")
    best = best.groupBy("read").agg(F.min("lineage").alias("first"), F.max("lineage").alias("last"), F.first("best").alias("score")).select("read", common_ancestor(F.col("first"), F.col("last")).alias("lineage"), "score")
    found = hits.groupBy("read").agg(F.sum("n").alias("hits"))
    out = totals.join(best, "read", "left").join(found, "read", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    if confidence > 0:
        below = way.join(hits, ["read", "lineage"]).groupBy("read", F.col("up").alias("clade")).agg(F.sum("n").alias("below"))
        chain = out.select("read", "windows", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("lineage")), lambda i: F.slice("lineage", 1, i))).alias("clade"))
        sure = chain.join(below, ["read", "clade"]).where(F.col("below") >= confidence * F.col("windows")).groupBy("read").agg(F.max_by("clade", F.size("clade")).alias("sure"))
        out = out.join(sure, "read", "left").withColumn("lineage", F.col("sure")).drop("sure")
    missing = reads.select("read").distinct().join(out, "read", "left")
    zero = F.lit(0).cast("long")
    return missing.select("read", "lineage", *[F.coalesce(c, zero).alias(c) for c in ("score", "hits", "windows")])


def _worded(batches: Iterator[pa.RecordBatch], size: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, words, held = [], [], 0
        for i, text in enumerate(_texts(batch)):
            if len(text) >= size:
                base = _CODE[text]
                n, unknown = len(base) - size + 1, np.concatenate(([0], np.cumsum(base == 4)))
                code = np.zeros(n, np.int64)
                for j in range(size):
                    code = code * 4 + base[j : j + n]
                word = np.unique(code[unknown[size:] == unknown[:-size]])
                rows.append(np.full(len(word), i))
                words.append(word)
                held += len(word)
            if held and (held > most or i == batch.num_rows - 1):  # many short texts leave as one batch
                yield pa.RecordBatch.from_arrays([batch.column("own").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(words))], ["own", "word"])
                rows, words, held = [], [], 0


def different_words(sequences: DataFrame, size: int = BAYES_WORD) -> DataFrame:
    """The columns of sequences but seq, with each different word of a sequence as a number; one strand."""
    others = [c for c in sequences.columns if c != "seq"]
    row = sequences.select(F.struct(*others).alias("own"), "seq")
    return row.mapInArrow(lambda it: _worded(it, size), f"own {row.schema['own'].dataType.simpleString()}, word long").select("own.*", "word")


def bayes_model(training: DataFrame, size: int = BAYES_WORD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, priors, genera) of training sequences (genus, seq): (word, genus, gain), (word, prior) and (genus, sequences).

    gain is the log of how much likelier the word is in the genus than if it had it in none of its sequences.
    """
    training = training.where("genus IS NOT NULL")
    genera = training.groupBy("genus").agg(F.count(F.lit(1)).alias("sequences"))
    counts = different_words(training.select("genus", "seq"), size).groupBy("word", "genus").agg(F.count(F.lit(1)).alias("m"))
    total = genera.agg(F.sum("sequences").alias("total"))  # one row
    priors = counts.groupBy("word").agg(F.sum("m").alias("n")).crossJoin(F.broadcast(total)).select("word", ((F.col("n") + 0.5) / (F.col("total") + 1)).alias("prior"))
    return counts.join(priors, "word").select("word", "genus", F.log((F.col("m") + F.col("prior")) / F.col("prior")).alias("gain")), priors, genera


def _slices(first: np.ndarray, cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(lo, hi) of groups whose rows begin at first; each slice costs at most that much, or is one group."""
    total, lo = np.cumsum(cost), 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each of the places start, start + 1, ... of so many for each row."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _block(words: pa.Table, model: pa.Table, by: list[str], trials: int, best: bool) -> Iterator[pa.Table]:
    """Scores of a block's groups for the genera of one part of the model; with best, each group's best of them by trial."""
    own, part = words.combine_chunks(), model.sort_by("word").combine_chunks()
    known, prior = part.column("word").to_numpy(), np.log(part.column("prior").to_numpy())
    lists = pa.concat_arrays([pc.fill_null(c, pa.scalar([], c.type)) for c in part.column("gains").chunks]) if part.num_rows else None
    if not own.num_rows or lists is None:
        return
    held = np.diff(lists.offsets.to_numpy())
    begin, flat = np.cumsum(held) - held, lists.flatten()
    names, gain, sequences = flat.field("genus"), flat.field("gain").to_numpy(), flat.field("sequences").to_numpy()
    different = sorted(pc.unique(names).to_pylist())
    genus = pc.index_in(names, pa.array(different, names.type)).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = np.zeros(len(different))
    weight[genus] = np.log(sequences + 1.0)
    code = np.zeros(own.num_rows, np.int64)
    for c in by:
        column = own.column(c).combine_chunks().dictionary_encode()
        one = pc.fill_null(column.indices, len(column.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(column.dictionary) + 1) + one, return_inverse=True)[1]
    word = own.column("word").to_numpy()
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    rows = np.lexsort((at, code))
    rows = rows[known[at[rows]] == word[rows]]
    fresh = np.ones(len(rows), bool)  # a word counts once a group
    fresh[1:] = (code[rows[1:]] != code[rows[:-1]]) | (at[rows[1:]] != at[rows[:-1]])
    rows = rows[fresh]
    if not len(rows):
        return
    drawn = own.column("drawn").combine_chunks() if trials else None
    if drawn is not None:
        ends, drawn = drawn.offsets.to_numpy(), drawn.values.to_numpy().astype(np.int64)
    code, at = code[rows], at[rows]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    last = np.r_[first[1:], len(rows)]
    # what a group costs: its table of genera and trials, and the gains that its words add
    adds = np.add.reduceat(held[at] * (1 + (np.diff(ends)[rows] if trials else 0)), first)
    for lo, hi in _slices(first, adds + len(different) * (trials + 1), 1 << 22):
        a, b = first[lo], last[hi - 1]
        group, place = np.repeat(np.arange(hi - lo), last[lo:hi] - first[lo:hi]) * (trials + 1), at[a:b]
        if trials:  # trial 0 has every word
            row, which = _spread(ends[rows[a:b]], np.diff(ends)[rows[a:b]])
            group, place = np.r_[group, group[row] + drawn[which]], np.r_[place, place[row]]
        size = (hi - lo) * (trials + 1)
        base, number = np.bincount(group, prior[place], size), np.bincount(group, minlength=size)
        row, which = _spread(begin[place], held[place])
        cell = group[row] * len(different) + genus[which]
        total = np.bincount(cell, gain[which], size * len(different))
        met = np.flatnonzero(np.bincount(cell, minlength=size * len(different)))
        group, name = met // len(different), met % len(different)
        score = base[group] + total[met] - number[group] * weight[name]
        if best:
            order = np.lexsort((name, -score, group))
            order = order[np.r_[True, group[order[1:]] != group[order[:-1]]]] if len(order) else order
            group, name, score = group[order], name[order], score[order]
        source = pa.array(rows[first[lo + group // (trials + 1)]])
        yield pa.table({**{c: own.column(c).take(source) for c in by}, "trial": pa.array(group % (trials + 1), pa.int32()), "genus": pa.array(different, pa.string()).take(pa.array(name)), "score": pa.array(score)})


def _blocked(words: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], by: list[str], trials: int = 0, best: bool = False) -> DataFrame:
    """(by..., trial, genus, score) by blocks of groups and parts of the genera.

    A task has the words of a block of groups and what the model knows of a part of the genera, so a word is sent once for
    each part, and each score leaves a task as one row, summed. The model is sent once for each block.
    """
    gains, priors, genera = model
    keep = Rounds(words.sparkSession, "bayes")
    gains, priors = keep(gains.join(genera, "genus")), keep(priors)
    parts = max(1, -(-gains.count() // MOST_GAINS))
    blocks = max(1, -(-words.count() // BLOCK_WORDS))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    lists = gains.groupBy("word", F.pmod(F.xxhash64("genus"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list(F.struct("genus", "gain", "sequences")).alias("gains"))
    known = priors.select("*", numbers).join(lists, ["word", "part"], "left")
    known = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = words.select("*", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int").alias("block"), numbers)
    schema = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in by) + ", trial int, genus string, score double"

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        found = list(_block(own, other, by, trials, best))
        empty = pa.table({**{c: own.column(c).slice(0, 0) for c in by}, "trial": pa.array([], pa.int32()), "genus": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        return pa.concat_tables(found) if found else empty

    return dealt.groupBy("block", "part").cogroup(known.groupBy("block", "part")).applyInArrow(run, schema)


def bayes_scores(words: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], by: list[str]) -> DataFrame:
    """(by..., genus, score): log-probabilities of the words of each group (by..., word); a word counts once a group.

    Every genus that has one of the words is a row. Words without a prior are in no training sequence; they say nothing.
    """
    return _blocked(words.select(*by, "word"), model, by).drop("trial")


def _best(scores: DataFrame, by: list[str]) -> DataFrame:
    """The genus of the greatest score; ties to the smallest name."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "genus")
    return scores.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def bayes_genera(reads: DataFrame, training: DataFrame, size: int = BAYES_WORD, trials: int = TRIALS, part: int = PART) -> DataFrame:
    """(read, genus, score, support): reads are (read, seq), training sequences (genus, seq); support is a share of the trials.

    A read without a word that training knows has no row. In a trial a word takes part if its hash with the read and the
    trial's number says so, one in ``part``; trials without any word support nothing.
    """
    words = different_words(reads.select("read", "seq"), size)
    drawn = F.filter(F.sequence(F.lit(1), F.lit(trials)), lambda t: F.pmod(F.xxhash64("read", "word", t), F.lit(part)) == 0)
    scores = _blocked(words.select("read", "word", F.transform(drawn, lambda t: t.cast("short")).alias("drawn")), bayes_model(training, size), ["read"], trials, True)
    best = _best(scores, ["read", "trial"])  # of the best of each part of the genera
    again = best.groupBy("read", "genus").agg(F.max(F.when(F.col("trial") == 0, F.col("score"))).alias("score"), (F.sum((F.col("trial") > 0).cast("int")) / trials).alias("support"))
    return again.where("score IS NOT NULL")
