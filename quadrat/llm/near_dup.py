"""Near-duplicate documents by DartMinHash signatures and exact verification (operator 3).

A document is its multiset of five-word shingles. On every unit of weight of
every shingle darts are thrown: a Poisson process along a rank axis, drawn from
the shingle's hash alone, each dart with a hashed coordinate. A document sees
the darts that fall in its own weighted regions, throws about k (ln k + 4) of
them whatever its length, and keeps the earliest of each coordinate. Two
documents agree in a coordinate with the probability of their weighted Jaccard
similarity. Signatures are cut in bands; equal bands propose links, which are
verified exactly on the whole texts.

No step emits all pairs of a group. Equal word sequences are one vertex. Every
member of a band bucket is compared with the bucket's smallest one, its head.
The classes that this makes are all there is in most buckets. In the others,
members that differ from the head by d and d' differ from one another by at
least |d - d'|, as the distance is a metric: members so near to the head that no
member outside its reach can be similar to them need no further comparison. The
rest is compared if a 192-bit sketch of the signatures allows the similarity
(see ``SKETCH_DISTANCE``): buckets of up to ``FEW`` such members by a join,
larger ones in blocks of bounded size, every two of which meet in one task,
which gives links that join classes alone, fewer than it has documents.

Results in odd cases: a text without words (null, empty, blank) is a class of
its own; rows that repeat a doc_id are one document, which has the links of all
its texts (a text of a repeated doc_id is known by a 64-bit hash among the
doc_ids); a row with a null doc_id has a null class; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import drop_path, fresh_path, scratch, settled, unused
from quadrat.llm.shingles import U, Words, mix, pieces, similarity, units

BANDS, ROWS = 36, 6  # a pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8**6)**36 > 0.99998
SKETCH_BITS = 192
#: At similarity 0.8 two sketches differ in 0.1 of their bits, with deviation 4.2 bits; 19 + 4.5 deviations.
SKETCH_DISTANCE = 38
FEW = 16
BLOCK_ROWS, BLOCK_SHINGLES = 8192, 3_000_000
_STEP, _GOLD = U(0xC2B2AE3D27D4EB4F), U(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _times(x: np.uint64, n: int) -> np.uint64:
    return U(int(x) * n & (1 << 64) - 1)


def dart_minhash(text: np.ndarray, region: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Rank of the earliest dart of each of k coordinates, for each text; inf for texts of no weight.

    text, region: each unit of weight, with its text's index and its hash. weight: each text's total.
    The rank is a continuous draw that belongs to one dart, so equal ranks mean the same dart.
    """
    out = np.full((len(weight), k), np.inf)
    reach = k * (np.log(k) + 4.0) / np.maximum(weight, 1)
    todo = np.arange(len(text))
    while len(todo):
        own, seed = text[todo], mix(region[todo] + _GOLD)
        limit, flat = reach[own], out.reshape(-1)
        h = mix(seed + _STEP)
        near = _uniform(h) >= np.exp(-limit)  # the first dart is near enough; else none is
        own, seed, limit = own[near], seed[near], limit[near]
        rank = -np.log(_uniform(h[near]))
        step = 1
        while len(own):
            spot = (mix(seed ^ _times(_GOLD, step)) % U(k)).astype(np.int64)
            np.minimum.at(flat, own * k + spot, rank)
            step += 1
            rank = rank - np.log(_uniform(mix(seed + _times(_STEP, step))))
            near = rank <= limit
            own, seed, limit, rank = own[near], seed[near], limit[near], rank[near]
        lacking = np.isinf(out).any(axis=1) & (weight > 0)  # some coordinate has no dart yet: throw on, twice as far
        reach = np.where(lacking, 2 * reach, reach)
        todo = np.flatnonzero(lacking[text])
    return out


def _signature_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            words = Words(part.column("text"))
            text, region, weight = units(*words.shingles())
            key = words.keys()
            marks = mix(dart_minhash(text, region, weight, bands * rows).view(U))
            band = np.zeros((len(weight), bands), U)
            for r in range(rows):
                band = mix(band * _STEP + marks[:, r::rows])
            band = mix(band + np.arange(1, bands + 1, dtype=U) * _GOLD).view(np.int64)
            sketch = np.packbits((marks[:, :SKETCH_BITS] & U(1)).astype(np.uint8), axis=1)
            sketch = np.ascontiguousarray(np.pad(sketch, ((0, 0), (0, max(0, SKETCH_BITS // 8 - sketch.shape[1]))))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(key[0]), pa.array(key[1]), pa.array(weight.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(weight) + 1) * bands, pa.int32()), pa.array(band.reshape(-1))), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(3))],
                ["doc_id", "k1", "k2", "weight", "bands", "s1", "s2", "s3"],
            )


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Word-sequence key, weight, band hashes and sketch of each row of (doc_id, text)."""
    return _plain(docs).mapInArrow(lambda it: _signature_batches(it, bands, rows), "doc_id long, k1 long, k2 long, weight long, bands array<long>, s1 long, s2 long, s3 long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            key = Words(part.column("text")).keys()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key[0]), pa.array(key[1]), part.column("text")], ["doc_id", "k1", "k2", "text"])


def _texts(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, any_repeated: bool) -> DataFrame:
    """(v, text) of the wanted vertices (v)."""
    docs = _plain(docs)
    plain = docs.join(repeated, "doc_id", "left_anti") if any_repeated else docs
    out = plain.select(F.col("doc_id").alias("v"), "text").join(wanted, "v", "left_semi")
    if not any_repeated:
        return out
    own = docs.join(repeated, "doc_id", "left_semi").mapInArrow(_keyed, "doc_id long, k1 long, k2 long, text string").select(F.xxhash64("doc_id", "k1", "k2").alias("v"), "text")
    return out.unionByName(own.join(wanted, "v", "left_semi").groupBy("v").agg(F.min("text").alias("text")))


def _compared(pairs: DataFrame, texts: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of at least that similarity. Texts meet by two joins; a vertex in very many pairs is a skewed key, which AQE splits."""

    def check(batches):
        for batch in batches:
            for part in pieces(batch, ("text", "other")):
                found = similarity(part.column("text"), part.column("other"))
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(found)], ["a", "b", "similarity"])
                yield out.filter(pa.array(found >= least))

    left = texts.select(F.col("v").alias("a"), "text")
    right = texts.select(F.col("v").alias("b"), F.col("text").alias("other"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(check, "a long, b long, similarity double")


def _links(rows: pa.Table, cross: bool, least: float) -> pa.Table:
    """Links (a, b) between classes of one group of vertices: enough to join every two that similar pairs connect.

    Columns: v, weight, s1, s2, s3, class_id, side, text. With cross, only pairs of different sides are compared.
    Row by row: what the sketches allow among the rows after it and outside its class, and of those the exact similarity,
    by the row's shingles marked in a table of all.
    """
    ids, weight, side = (rows.column(c).to_numpy() for c in ("v", "weight", "side"))
    sketch = np.stack([rows.column(c).to_numpy() for c in ("s1", "s2", "s3")])
    _, first, class_of = np.unique(rows.column("class_id").to_numpy(), return_index=True, return_inverse=True)
    parent = first[class_of]
    hashes, total = [], []
    for part in pieces(rows.select(["text"]).combine_chunks().to_batches()[0]) if len(ids) else ():
        _, hashed, count = units(*Words(part.column("text")).shingles())
        hashes.append(hashed)
        total.append(count)
    total = np.concatenate(total) if total else np.empty(0, np.int64)
    known, code = np.unique(np.concatenate(hashes) if hashes else np.empty(0, U), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(total)))
    marked = np.zeros(len(known), bool)
    low = np.ceil(least * weight) - 1
    out = []
    for i in range(len(ids) - 1):
        later = slice(i + 1, None)
        ok = (parent[later] != parent[i]) & (np.minimum(weight[i], weight[later]) >= np.maximum(low[i], low[later]))
        if cross:
            ok &= side[later] != side[i]
        at = np.flatnonzero(ok) + i + 1
        at = at[np.bitwise_count(sketch[:, i : i + 1] ^ sketch[:, at]).sum(axis=0) <= SKETCH_DISTANCE]
        if not len(at):
            continue
        own = code[begin[i] : begin[i + 1]]
        marked[own] = True
        size = total[at]
        place = np.arange(size.sum()) + np.repeat(begin[at] - np.cumsum(size) + size, size)
        shared = np.add.reduceat(marked[code[place]], np.cumsum(size) - size, dtype=np.int64)
        marked[own] = False
        for b in at[shared >= least * (total[i] + size - shared)]:
            if parent[i] != parent[b]:
                out.append((ids[i], ids[b]))
                parent = np.where(parent == parent[b], parent[i], parent)
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _block_links(rows: DataFrame, large: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links between classes within the buckets of large (h, n, w: members and their shingles)."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("w") / BLOCK_SHINGLES)).cast("int")
    own = rows.join(large.select("h", blocks.alias("blocks")), "h").withColumn("k", F.pmod(F.xxhash64("v", "h"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("k", "o")).withColumn("j", F.greatest("k", "o")).withColumn("side", (F.col("k") == F.col("i")).cast("int"))
    met = dealt.select("h", "i", "j", "v", "weight", "s1", "s2", "s3", "class_id", "side").join(texts, "v")

    def link(key, group):
        return _links(group, key[1].as_py() != key[2].as_py(), least)

    return met.groupBy("h", "i", "j").applyInArrow(link, "a long, b long")


def components(edges: DataFrame, name: str = "classes") -> tuple[DataFrame, str]:
    """Smallest member of each vertex's connected component: (id, class_id), for the vertices of the edges (a, b), and where it is written.

    Labels spread over the edges and then jump along themselves, so the rounds grow as the logarithm of a path's
    length; each round's labels are written to the shared folder. Nothing of the graph comes to the driver.
    """
    spark = edges.sparkSession
    both, path_edges = settled(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels, path = settled(both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")).select(F.col("u").alias("id"), "c"), f"{name}-0")
    n = 0
    while True:
        n += 1
        seen = both.join(labels.select(F.col("id").alias("v"), F.col("c").alias("d")), "v").groupBy("u").agg(F.min("d").alias("d"))
        near = labels.join(seen.select(F.col("u").alias("id"), "d"), "id").select("id", F.col("c").alias("old"), F.least("c", "d").alias("c"))
        far = labels.select(F.col("id").alias("c"), F.col("c").alias("jump"))
        new, path_new = settled(near.join(far, "c").select("id", F.least("c", "jump").alias("c"), (F.col("old") != F.least("c", "jump")).cast("int").alias("moved")), f"{name}-{n}")
        drop_path(spark, path)
        path = path_new
        if not new.agg(F.max("moved")).first()[0]:
            drop_path(spark, path_edges)
            return new.select("id", F.col("c").alias("class_id")), path
        labels = new.select("id", "c")


def _found_links(docs: DataFrame, vertices: DataFrame, repeated: DataFrame, any_repeated: bool, least: float) -> DataFrame:
    """Links (a, b) that join all classes of the vertices (v, weight, bands, s1, s2, s3)."""
    facts = vertices.select("v", "weight", "s1", "s2", "s3")
    banded = vertices.select("v", F.explode("bands").alias("h"))
    heads = banded.groupBy("h").agg(F.min("v").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members, path_members = settled(banded.join(heads, "h").where("v != head"), "buckets")
    star, path_star = settled(members.select(F.col("v").alias("a"), F.col("head").alias("b")).distinct(), "stars")

    # A table of its own: Spark sees its size, and sends it to the documents or both to their ids.
    wanted, path_wanted = settled(star.select(F.col("a").alias("v")).union(star.select("b")).distinct(), "wanted")
    texts, path_texts = settled(_texts(docs, wanted, repeated, any_repeated), "bucket-texts")
    near, path_near = settled(_compared(star, texts), "near")
    links = near.where(F.col("similarity") >= least).select("a", "b")
    first, path_first = components(links, "star")

    # Within a bucket, members of classes that the stars left apart.
    apart = members.join(near.select(F.col("a").alias("v"), F.col("b").alias("head"), (1 - F.col("similarity")).alias("d")), ["v", "head"])
    apart = apart.join(first.withColumnRenamed("id", "v"), "v", "left").select("h", "v", "d", F.coalesce("class_id", "v").alias("class_id"))
    apart, path_apart = settled(apart, "apart")
    reach = 1 - least + 1e-9
    far = apart.groupBy("h").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.min(F.when(F.col("d") > reach, F.col("d"))).alias("far")).where("lo < hi")
    open_ = apart.join(far.select("h", "far"), "h").where(F.col("d") >= F.col("far") - reach).select("h", "v", "class_id").join(facts, "v")
    open_, path_open = settled(open_, "open")
    for path in (path_members, path_star, path_wanted, path_apart):
        drop_path(docs.sparkSession, path)
    sizes = open_.groupBy("h").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).where("lo < hi")
    left = open_.join(sizes.where(F.col("n") <= FEW).select("h"), "h", "left_semi")
    right = left.toDF("h", "b", "other", "hw", "h1", "h2", "h3")
    differ = F.bit_count(F.expr("s1 ^ h1")) + F.bit_count(F.expr("s2 ^ h2")) + F.bit_count(F.expr("s3 ^ h3"))
    alike = (differ <= SKETCH_DISTANCE) & (F.least("weight", "hw") >= F.ceil(F.lit(least) * F.greatest("weight", "hw")) - 1)
    across = left.join(right, "h").where((F.col("class_id") < F.col("other")) & alike).select(F.col("v").alias("a"), "b").distinct()
    more = _compared(across, texts, least).select("a", "b").unionByName(_block_links(open_, sizes.where(F.col("n") > FEW), texts, least))
    out, _ = settled(links.unionByName(more), "links")
    for path in (path_near, path_texts, path_first, path_open):
        drop_path(docs.sparkSession, path)
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id that links of at least that similarity reach. One row per doc_id; see the module."""
    spark = docs.sparkSession
    result = fresh_path(spark, "near-classes")
    with scratch(spark):
        sig, path_sig = settled(signatures(docs, bands, rows).where("doc_id IS NOT NULL"), "signatures")
        repeated, _ = settled(sig.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
        any_repeated = not repeated.isEmpty()
        whole = sig.where("weight > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "weight", "bands", "s1", "s2", "s3")).alias("m")).select("k1", "k2", "m.*")
        vertex = F.col("doc_id")
        if any_repeated:
            whole, vertex = whole.join(repeated.withColumn("again", F.lit(True)), "doc_id", "left"), F.when(F.col("again"), F.xxhash64("doc_id", "k1", "k2")).otherwise(F.col("doc_id"))
        whole, _ = settled(whole.select(vertex.alias("v"), "k1", "k2", "weight", "bands", "s1", "s2", "s3"), "vertices")
        rows_of, _ = settled(sig.select("doc_id", "k1", "k2", "weight"), "rows")
        drop_path(spark, path_sig)
        links = _found_links(docs, whole, repeated, any_repeated, least)
        copies = rows_of.where("weight > 0").join(whole.select("v", "k1", "k2"), ["k1", "k2"]).where("doc_id != v").select(F.col("doc_id").alias("a"), F.col("v").alias("b"))
        classes, _ = components(links.union(copies))
        out = rows_of.select("doc_id").distinct().join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
        if any_repeated:  # a class may be named by a hashed vertex
            named, _ = settled(out, "named")
            out = named.join(named.groupBy("class_id").agg(F.min("doc_id").alias("least")), "class_id").select("doc_id", F.col("least").alias("class_id"))
        nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
        out = out.unionByName(nameless)
        out.write.parquet(result)
    return spark.read.schema(out.schema).parquet(result)


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents without later near copies: of each class the row of the smallest doc_id stays, of several with that doc_id
    the one of the smallest text (then of the smallest hash of its other columns). Rows with a null doc_id stay."""
    place = unused("place", docs.columns)
    kept = near_duplicates(docs, least).where("doc_id = class_id").select("doc_id")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.coalesce("text", F.lit("")), F.xxhash64(F.lit(0), *others)]
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col(place) == 1).drop(place)
    return named.unionByName(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])
