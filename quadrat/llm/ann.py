"""Nearest neighbours by a forest of random-projection trees (operator 1).

A tree splits vectors by the hyperplane between two random ones, at the median
of their projections, down to leaves of about ``LEAF`` vectors. The forest is
fitted on at most ``SAMPLE`` vectors (those of the smallest hash; documented
bound), but every vector is indexed: Spark tasks pass all rows down the trees.
A query searches all trees at once through one priority queue, ordered by the
smallest margin on the way, until the leaves that it took hold a number of
vectors. That number is fitted, too: the least with which ``TUNED`` sampled
queries find the share ``RECALL`` of their true neighbours in the sample. Data
without any structure needs a large part of all vectors for that, data with
clusters little. Queries and vectors meet by leaf and are ranked by exact cosine
similarity in double precision.

A task gets leaves, or parts of large leaves, of about ``GROUP`` vectors and the
queries that take them; only where these are over ``ASKED`` are they dealt in
blocks, to which that group alone is copied. So its size is bounded however large
the table, a leaf or the number of queries is. Beyond SAMPLE / leaf size leaves
a tree can't be fitted finer, so leaves then grow with the table and are dealt
in more parts; raise ``sample`` with it (10 million vectors of 64 numbers are
2.5 GB on the driver).

Equal vectors are one entry with their k + 1 smallest ids, which are all that
can be among anybody's k nearest; so one very common vector is one entry of one
leaf, and its queries are one search. Other vectors of equal score are all
ranked before the k nearest are taken, so ties go to the smaller id among all
that the search has met. A query whose leaves hold fewer than k others, though
the table has them, is held against all vectors.

Results in odd cases: vectors that are null, empty, zero, of another length
than most, or with null or non-finite numbers take no part, neither as queries
nor as candidates; of an id with several vectors the smallest counts, number by
number; ties go to the smaller id; rows that repeat an id and vector
count once; rows with a null id take no part; fewer candidates than k give fewer
rows; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import settled

TREES, LEAF, SAMPLE = 8, 128, 65_536
RECALL, TUNED = 0.95, 200
GROUP = 20_000  # index entries that meet their queries in one task
ASKED = 20_000  # queries that meet them
TIE = 1e-9  # scores of the first ranking that are this near may be equal ones


class Tree:
    """Inner nodes as arrays: normal, threshold and two children; a child of ~i is leaf i. sizes: sampled vectors by leaf."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, thresholds, children, self.sizes = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(3):
                    a, b = rng.choice(rows, 2, replace=False)
                    normal = sample[a] - sample[b]
                    length = np.linalg.norm(normal)
                    if not length:
                        continue
                    normal = normal / length
                    side = sample[rows] @ normal
                    threshold = float(np.median(side))
                    right = side > threshold
                    if 0 < right.sum() < len(rows):
                        node = len(normals)
                        normals.append(normal)
                        thresholds.append(threshold)
                        children.append([0, 0])
                        children[node] = [grow(rows[~right]), grow(rows[right])]
                        return node
            self.sizes.append(len(rows))
            return ~(len(self.sizes) - 1)

        self.root = grow(np.arange(len(sample)))
        self.normals = np.array(normals, np.float32).reshape(len(normals), sample.shape[1])
        self.thresholds, self.children = np.array(thresholds), np.array(children, np.int64).reshape(-1, 2)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.full(len(unit), self.root)
        while len(at := np.flatnonzero(node >= 0)):
            own = node[at]
            side = np.einsum("ij,ij->i", unit[at], self.normals[own]) > self.thresholds[own]
            node[at] = self.children[own, side.astype(np.int64)]
        return ~node


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, leaf: int, scale: float):
        self.trees = [Tree(sample, leaf, np.random.default_rng(seed)) for seed in range(trees)]
        self.scale = scale  # vectors for each one sampled

    def probes(self, unit: np.ndarray, search: int) -> Iterator[list[tuple[int, int]]]:
        """For each vector the (tree, leaf) pairs that a shared queue takes first."""
        margins = [unit @ t.normals.T - t.thresholds for t in self.trees]
        for i in range(len(unit)):
            queue = [(-np.inf, t, tree.root) for t, tree in enumerate(self.trees)]
            heapq.heapify(queue)
            found, held = [], 0.0
            while queue and held < search:
                bound, t, node = heapq.heappop(queue)
                tree = self.trees[t]
                if node < 0:
                    found.append((t, ~node))
                    held += tree.sizes[~node] * self.scale
                    continue
                margin = float(margins[t][i, node])
                left, right = tree.children[node]
                heapq.heappush(queue, (max(bound, -margin), t, int(right)))
                heapq.heappush(queue, (max(bound, margin), t, int(left)))
            yield found


def fitted_search(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, queries: int = TUNED) -> float:
    """Vectors that the leaves of a search must hold for that recall, as measured by brute force on the sample."""
    asked = np.arange(min(queries, len(sample)))
    leaves = [t.leaves(sample) for t in forest.trees]
    near = sample[asked] @ sample.T
    near[asked, asked] = -np.inf
    needed = []
    for i, order in zip(asked, forest.probes(sample[asked], np.inf), strict=True):
        true = np.argsort(-near[i], kind="stable")[: min(k, len(sample) - 1)]
        held = np.cumsum([forest.trees[t].sizes[leaf] * forest.scale for t, leaf in order])
        for v in true:
            needed.append(held[next(n for n, (t, leaf) in enumerate(order) if leaves[t][v] == leaf)])
    return float(np.quantile(needed, recall, method="higher")) if needed else 1.0


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    good = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<float>").alias("v"))
    good = good.where("vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('infinity')) AND exists(v, x -> x <> 0)")
    # the most common length; one number for each different length comes to the driver
    most = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("v") == (most["n"] if most else 0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The list column v as binary: little-endian 32-bit numbers."""
    for batch in batches:
        if batch.num_rows:
            v = batch.column("v")
            data = v.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array([r.tobytes() for r in data], pa.binary())], ["id", "ids", "v"])


def _parts(forest: Forest) -> list[np.ndarray]:
    """For each tree the number of parts that each leaf is dealt in."""
    return [np.maximum(1, np.ceil(np.array(t.sizes) * forest.scale / GROUP)).astype(np.int64) for t in forest.trees]


def _group(tree, leaf, part, groups: int):
    return (leaf * 1_000_003 + tree * 7_919 + part * 15_485_863) % groups


def _placed(batches: Iterator[pa.RecordBatch], forest: Forest, width: int, groups: int) -> Iterator[pa.RecordBatch]:
    parts = _parts(forest)
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            own = batch.slice(lo, 4096)
            unit, ids = _unit(_matrix(own.column("v"), width)), own.column("id").to_numpy()
            for t, tree in enumerate(forest.trees):
                leaf = tree.leaves(unit)
                part = (ids * 0x9E3779B97F4A7C1 >> 13) % parts[t][leaf]
                yield pa.RecordBatch.from_arrays([pa.array(_group(t, leaf, part, groups).astype(np.int64)), pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf.astype(np.int32)), *(own.column(c) for c in ("id", "ids", "v"))], ["g", "tree", "leaf", "id", "ids", "v"])


def _probed(batches: Iterator[pa.RecordBatch], forest: Forest, width: int, groups: int, search: float) -> Iterator[pa.RecordBatch]:
    """One row for each query and group that it takes leaves of; at: tree << 32 | leaf of each."""
    parts = _parts(forest)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows, group, at = [], [], []
            for i, found in enumerate(forest.probes(_unit(_matrix(part.column("v"), width)), search)):
                own: dict[int, set[int]] = {}
                for tree, leaf in found:
                    for n in range(parts[tree][leaf]):
                        own.setdefault(int(_group(tree, leaf, n, groups)), set()).add(tree << 32 | leaf)
                rows += [i] * len(own)
                group += own
                at += [sorted(x) for x in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), part.column("id").take(pa.array(rows, pa.int64())), part.column("v").take(pa.array(rows, pa.int64())), pa.array(at, pa.list_(pa.int64()))], ["g", "q", "v", "at"])


def _best(queries: np.ndarray, asker: np.ndarray, entries: np.ndarray, length: np.ndarray, ids: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, entry, exact score) of the keep best entries of each of the askers (places in queries), ties to the smaller id."""
    n = min(keep, len(entries))
    own_length = np.sqrt((queries * queries).sum(axis=1))
    for lo in range(0, len(asker) if n else 0, 128):
        own = asker[lo : lo + 128]
        rough = queries[own] @ entries.T / (own_length[own][:, None] * length)
        least = np.partition(rough, len(entries) - n, axis=1)[:, len(entries) - n]
        row, entry = np.nonzero(rough >= least[:, None] - TIE)
        exact = np.empty(len(row))
        for at in range(0, len(row), 1 << 15):
            some = slice(at, at + (1 << 15))
            exact[some] = (queries[own[row[some]]] * entries[entry[some]]).sum(axis=1) / (own_length[own[row[some]]] * length[entry[some]])
        by = np.lexsort((ids[entry], -exact, row))
        row, entry, exact = row[by], entry[by], exact[by]
        near = np.arange(len(row)) - np.searchsorted(row, row) < keep
        yield own[row[near]], entry[near], exact[near]


def _ranked(index: pa.Table, probes: pa.Table, width: int, keep: int) -> pa.Table:
    """The keep best entries of a group for each query that took leaves of it."""
    q, where, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if index.num_rows and probes.num_rows:
        key = index.column("tree").to_numpy().astype(np.int64) << 32 | index.column("leaf").to_numpy()
        order = np.argsort(key, kind="stable")
        key, ids = key[order], index.column("id").to_numpy()[order]
        entries, queries = _matrix(index.column("v"), width).astype(np.float64)[order], _matrix(probes.column("v"), width).astype(np.float64)
        length = np.sqrt((entries * entries).sum(axis=1))
        lists = probes.column("at").combine_chunks()
        wanted, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(queries)), lists.value_lengths().to_numpy())
        by = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[by], asker[by]
        found = []
        for leaf in np.unique(wanted):
            lo, hi = np.searchsorted(key, [leaf, leaf + 1])
            a, b = np.searchsorted(wanted, [leaf, leaf + 1])
            found += [(own, entry + lo, exact) for own, entry, exact in _best(queries, asker[a:b], entries[lo:hi], length[lo:hi], ids[lo:hi], keep)]
        if found:
            q, where, score = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((ids[where], -score, q))
            q, where, score = q[by], where[by], score[by]
            new = np.append(True, (np.diff(q) != 0) | (np.diff(ids[where]) != 0))  # an entry can come from several trees
            q, where, score = q[new], where[new], score[new]
            near = np.arange(len(q)) - np.searchsorted(q, q) < keep
            q, where, score = probes.column("q").to_numpy()[q[near]], order[where[near]], score[near]
    return pa.table({"q": pa.array(q, pa.int64()), "id": index.column("id").take(pa.array(where)).cast(pa.int64()), "ids": index.column("ids").take(pa.array(where)), "score": pa.array(score, pa.float64())})


def _against_all(entries: DataFrame, lacking: DataFrame, width: int, keep: int, block: int = 1000) -> Iterator[DataFrame]:
    """(q, id, ids, score): the keep best entries of each partition for the lacking queries (id, ids, v), a block of them at a time."""
    ids, rows, context = [], [], entries.sparkSession.sparkContext

    def ranked(batches, asked):
        q, queries = asked.value
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                x, own = _matrix(part.column("v"), width).astype(np.float64), part.column("id").to_numpy()
                for who, entry, exact in _best(queries, np.arange(len(q)), x, np.sqrt((x * x).sum(axis=1)), own, keep):
                    at = pa.array(entry)
                    yield pa.RecordBatch.from_arrays([pa.array(q[who]), part.column("id").take(at), part.column("ids").take(at), pa.array(exact)], ["q", "id", "ids", "score"])

    def scanned():
        asked = context.broadcast((np.array(ids, np.int64), _matrix(pa.array(rows, pa.binary()), width).astype(np.float64)))
        return entries.mapInArrow(_packed, "id long, ids array<long>, v binary").mapInArrow(lambda it: ranked(it, asked), "q long, id long, ids array<long>, score double")

    for row in lacking.mapInArrow(_packed, "id long, ids array<long>, v binary").toLocalIterator():
        ids.append(row["id"])
        rows.append(bytes(row["v"]))
        if len(ids) == block:
            yield scanned()
            ids, rows = [], []
    if ids:
        yield scanned()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    vectors, queries: (vec_id, v) as ``usable`` gives them; queries are rows of vectors, which are never their own answer.
    """
    spark, ids = vectors.sparkSession, Window.partitionBy("v").orderBy("vec_id")
    few = vectors.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("n", F.row_number().over(ids)).where(F.col("n") <= k + 1)
    entries = few.groupBy("v").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("id", "ids", "v")
    entries, _ = settled(entries, "ann-entries")
    result = "query_id long, rank int, vec_id long, score double"
    count = entries.count()
    if not count:
        return spark.createDataFrame([], result)
    # the smallest hashes: a threshold first, so that no task sorts much more than the sample
    share = min(1.0, 1.2 * sample / count + 1e-3)
    few = entries if share == 1.0 else entries.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = few.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    fitted = _unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
    width, scale = fitted.shape[1], count / len(fitted)
    grown = Forest(fitted, trees, max(2, int(leaf / scale)), scale)
    search = fitted_search(grown, fitted, k, recall)
    forest = spark.sparkContext.broadcast(grown)  # bounded by the sample
    groups = max(1, count * trees // GROUP)

    asked = queries.select(F.col("vec_id").alias("query_id"), "v").join(entries.select("id", "v"), "v").select("query_id", F.col("id").alias("q"), "v")
    searches, _ = settled(asked.groupBy("q").agg(F.first("v").alias("v")).select(F.col("q").alias("id"), F.expr("cast(array() as array<long>)").alias("ids"), "v"), "ann-searches")
    packed = "id long, ids array<long>, v binary"
    index = entries.mapInArrow(_packed, packed).mapInArrow(lambda it: _placed(it, forest.value, width, groups), "g long, tree int, leaf int, id long, ids array<long>, v binary")
    probes = searches.mapInArrow(_packed, packed).mapInArrow(lambda it: _probed(it, forest.value, width, groups, search), "g long, q long, v binary, at array<long>")
    probes, _ = settled(probes, "ann-probes")
    asked_of, _ = settled(probes.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks")), "ann-groups")
    index = index.join(asked_of, "g").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    probes = probes.join(asked_of, "g").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")
    met = index.groupBy("g", "block").cogroup(probes.groupBy("g", "block")).applyInArrow(lambda left, right: _ranked(left, right, width, k + 1), "q long, id long, ids array<long>, score double")

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def nearest_of(met: DataFrame) -> DataFrame:
        found = met.groupBy("q", "id").agg(F.first("ids").alias("ids"), F.max("score").alias("score")).select("q", "score", F.explode("ids").alias("vec_id"))
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))

    best, _ = settled(nearest_of(met), "ann-best")
    # a query is its own nearest, so k + 1 are needed, or all that there are
    enough = min(k + 1, entries.select(F.size("ids").alias("n")).agg(F.sum("n")).first()[0])
    lacking = searches.join(best.where(F.size("best") >= enough).select(F.col("q").alias("id")), "id", "left_anti")
    for n, more in enumerate(_against_all(entries, lacking, width, k + 1)):
        best = best.unionByName(settled(nearest_of(more), f"ann-all-{n}")[0])
    best = best.where(F.size("best") >= enough)
    answers = asked.select("query_id", "q").distinct().join(best, "q")
    own = F.expr(f"slice(filter(best, x -> x.vec_id <> query_id), 1, {k})")
    return answers.select("query_id", F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
