"""The trie of conversation prefixes, by rolling fingerprints that are verified (operator 13).

A conversation is its turns in order; a node is a different sequence of first
turns, from the root without any. Each turn gets the polynomial fingerprints of
the turns up to it, modulo two primes, from numpy scans over the turns sorted by
conversation. Turns of one depth and fingerprint are a candidate group. Its
representative is the smallest conversation in it; each turn of the group is
compared with the representative's: role and text, and the group of the turn
before. If all are equal at every depth, the groups are the nodes. If not, the
odd ones out split off, with all that follows in their conversations, and the
groups are compared again, until none differs.

The scans need no conversation whole in one task: turns are dealt by ranges and
scanned range by range; a conversation that goes on over several ranges is put
together from one sum for each. What comes to the driver is two numbers of each
range, and the sums of such conversations, at most two a range. Groups meet as
aggregates with few values after a map-side step, so a first turn that a third
of all conversations share is no hot key. Subtree sums go up by doubled steps
(1, 2, 4, ... ancestors), over the nodes with several members alone: below them
a conversation is a single chain.

Results in odd cases: a null role or text is an empty one; a null turn comes
first; equal turns of a conversation follow role, then text; repeated rows are
turns; rows without a conv_id belong to no conversation and are left out;
further columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import scratch, settled

PRIMES, BASES = ((1 << 31) - 1, (1 << 31) - 19), (1_103_515_245, 1_664_525_013)
CHUNK = 4096
_SCANNED = "conv_id long, n long, part int, f1 long, p1 long, f2 long, p2 long, role string, text string"


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n - 1 modulo prime."""
    out, have = np.ones(n, np.int64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * pow(base, have, prime) % prime
        have += more
    return out


def _scan(batches: Iterator[pa.RecordBatch], primes: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, symbol, part, role, text), with the place n in the part's stretch of the conversation and the
    fingerprints with (f1, f2) and without (p1, p2) the turn: sums of symbol times base to the power of the place."""
    conv, done, sums = None, 0, [0, 0]
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        ids, symbol, at = batch.column("conv_id").to_numpy(), batch.column("symbol").to_numpy(), np.arange(rows)
        new = np.append(True, ids[1:] != ids[:-1])
        begin = np.maximum.accumulate(np.where(new, at, 0))
        place, goes_on = at - begin, conv is not None and ids[0] == conv
        first = begin == 0  # the turns of the conversation that may go on from the batch before
        columns = {}
        for k, prime in enumerate(primes):
            base = BASES[k] % prime
            power = _powers(base, prime, int(place.max()) + 1)[place]
            if goes_on:
                power[first] = power[first] * pow(base, done, prime) % prime
            term = ((symbol >> (32 * k)) & 0x7FFFFFFF) % prime * power % prime
            total = np.cumsum(term)
            upto = total - (total - term)[begin]
            if goes_on:
                upto[first] += sums[k]
            upto %= prime
            columns[f"f{k + 1}"], columns[f"p{k + 1}"] = pa.array(upto), pa.array((upto - term) % prime)
            sums[k] = int(upto[-1])
        if goes_on:
            place[first] += done
        conv, done = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "n": pa.array(place + 1), "part": batch.column("part"), **columns, "role": batch.column("role"), "text": batch.column("text")})


def _offsets(scanned: DataFrame, primes: tuple[int, int]) -> DataFrame | None:
    """(conv_id, part, before, o1, o2, b1, b2) of each conversation that several parts hold; None if there is none.

    At most two conversations of a part go on in another, so this is bounded by the number of parts.
    """
    spark = scanned.sparkSession
    edges = sorted(scanned.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).collect())
    across = sorted({a["hi"] for a, b in zip(edges, edges[1:], strict=False) if a["hi"] == b["lo"]})
    if not across:
        return None
    wanted = F.broadcast(spark.createDataFrame([(c,) for c in across], "conv_id long"))
    sums = scanned.join(wanted, "conv_id").groupBy("conv_id", "part").agg(F.max("n").alias("n"), F.max_by("f1", "n").alias("f1"), F.max_by("f2", "n").alias("f2"))
    out, state = [], {}
    for row in sorted(sums.collect()):
        before, o1, o2 = state.get(row["conv_id"], (0, 0, 0))
        b1, b2 = (pow(base % prime, before, prime) for base, prime in zip(BASES, primes, strict=True))
        out.append((row["conv_id"], row["part"], before, o1, o2, b1, b2))
        state[row["conv_id"]] = before + row["n"], (o1 + b1 * row["f1"]) % primes[0], (o2 + b2 * row["f2"]) % primes[1]
    return spark.createDataFrame(out, "conv_id long, part int, before long, o1 long, o2 long, b1 long, b2 long")


def ordered(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(conv_id, depth, f, p, role, text): each turn with its place from 1 and the fingerprints of the turns up to it and before it.

    turns: conv_id, turn, role, text.
    """
    clean = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    dealt = clean.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.select("conv_id", F.xxhash64("role", "text").alias("symbol"), F.spark_partition_id().alias("part"), "role", "text")
    scanned, _ = settled(dealt.mapInArrow(lambda it: _scan(it, primes), _SCANNED), "trie-turns")
    offsets = _offsets(scanned, primes)
    if offsets is None:
        depth, sums = F.col("n"), {x: F.col(x) for x in ("f1", "f2", "p1", "p2")}
    else:
        scanned = scanned.join(F.broadcast(offsets), ["conv_id", "part"], "left")
        depth = F.col("n") + F.coalesce("before", F.lit(0).cast("long"))
        sums = {x: F.when(F.col("before").isNull(), F.col(x)).otherwise((F.col(f"o{x[1]}") + F.col(f"b{x[1]}") * F.col(x)) % primes[int(x[1]) - 1]) for x in ("f1", "f2", "p1", "p2")}
    both = {x: F.shiftleft(sums[f"{x}1"], 31).bitwiseOR(sums[f"{x}2"]) for x in ("f", "p")}
    return scanned.select("conv_id", depth.alias("depth"), both["f"].alias("f"), both["p"].alias("p"), "role", "text")


def _verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the group of each turn (depth, f, l) and of the turn before (p, pl), and the nodes that these groups are.

    A variant is what turns of a group look like: role, text and the group before. The representative's variant keeps its
    label; the turns of others add a number to it, as do all later turns of their conversations.
    """
    rows, turn = rows.withColumns({"l": F.lit(0).cast("long"), "pl": F.lit(0).cast("long")}), 0
    while True:
        nodes, _ = settled(rows.groupBy("depth", "f", "l", "p", "pl", "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
        mixed, _ = settled(nodes.groupBy("depth", "f", "l").count().where("count > 1").drop("count"), "trie-mixed")
        if mixed.isEmpty():
            return rows, nodes
        turn += 1
        group = Window.partitionBy("depth", "f", "l").orderBy("conv_id")
        odd = nodes.join(mixed, ["depth", "f", "l"]).withColumn("r", F.row_number().over(group)).where("r > 1").drop("conv_id", "n_convs")
        weight = F.shiftrightunsigned(F.xxhash64(F.lit(turn), "depth", "r"), 24)
        marks = rows.join(odd, ["depth", "f", "l", "p", "pl", "role", "text"]).groupBy("conv_id").agg(F.collect_list(F.struct("depth", weight.alias("w"))).alias("marks"))
        upto = "coalesce(aggregate(marks, 0L, (s, m) -> s + if(m.depth <= depth - {}, m.w, 0L)), 0L)"
        split = rows.join(marks, "conv_id", "left").withColumns({"l": F.expr("l + " + upto.format(0)), "pl": F.expr("pl + " + upto.format(1))}).drop("marks")
        rows, _ = settled(split, "trie-split")


def _end_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks of ids, which come sorted, with commas between; one node's state is held at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for depth, f, label, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, f, label) == key:
                state.update(b"," + ids.encode())
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, f, label), hashlib.sha256(ids.encode())
        yield _hashes(done)
    if key is not None:
        yield _hashes([(*key, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["depth", "f", "l", "ends_sha256"])


def _rolled_up(shared: DataFrame, deepest: int) -> DataFrame:
    """(depth, f, l, n_leaves, saved): sums over the subtrees of (depth, f, l, p, pl, n_leaves, saved).

    After k rounds a node has the sums of the nodes less than 2 ** k below it, and knows its 2 ** k-th ancestor.
    """
    key, up = ["depth", "f", "l"], ["ud", "uf", "ul"]
    rename = dict(zip(key, up, strict=True))
    state = shared.select(*key, F.when(F.col("depth") > 0, F.col("depth") - 1).alias("ud"), F.col("p").alias("uf"), F.col("pl").alias("ul"), "n_leaves", "saved")
    step = 1
    while step <= deepest:
        below = state.where("ud IS NOT NULL").groupBy(*up).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnsRenamed({v: k for k, v in rename.items()})
        above = state.where("ud IS NOT NULL").select(*[F.col(k).alias(v) for k, v in rename.items()], *[F.col(v).alias(f"{v}2") for v in up])
        state = state.join(below, key, "left").join(above, up, "left")
        state = state.select(*key, *[F.col(f"{v}2").alias(v) for v in up], *[(F.col(c) + F.coalesce(m, F.lit(0).cast("long"))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved", "more_saved"))])
        state, _ = settled(state, "trie-sums")
        step *= 2
    return state.select(*key, "n_leaves", "saved")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the ids of the members that end there).

    turns: conv_id, turn, role, text. conversations: (conv_id) of those that count even without turns. saved_tokens counts the
    code points that a cache of shared prefixes saves. The result is a table in the shared folder; nothing else is left there.
    """
    spark, key = turns.sparkSession, ["depth", "f", "l"]
    zero = F.lit(0).cast("long")
    with scratch(spark) as paths:
        rows, nodes = _verified(ordered(turns, primes))
        ends = rows.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("e")).select("conv_id", "e.*")
        if conversations is not None:
            ids = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
            ends = ends.join(ids, "conv_id", "full").select("conv_id", *[F.coalesce(k, zero).alias(k) for k in key])
        ends, _ = settled(ends, "trie-ends")
        chunks = ends.groupBy(*key, F.shiftright("conv_id", CHUNK.bit_length() - 1).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
        hashes = chunks.repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(_end_hash, "depth long, f long, l long, ends_sha256 string")

        root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
        root = root.select(*[zero.alias(k) for k in key], *[F.lit(None).cast("long").alias(k) for k in ("p", "pl")], "conv_id", "n_convs", zero.alias("chars"))
        tree = nodes.select(*key, "p", "pl", "conv_id", "n_convs", F.length("text").cast("long").alias("chars")).unionByName(root)
        single = (F.col("n_convs") == 1).cast("long")
        children = tree.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p").alias("f"), F.col("pl").alias("l")).agg(F.count(F.lit(1)).alias("n_children"), F.sum(single).alias("n_single"))
        tree, _ = settled(tree.join(children, key, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_children", "n_single")}), "trie-tree")

        # a node with one member begins a chain with one leaf and nothing saved
        shared = tree.where("n_convs > 1 OR depth = 0")
        own = shared.withColumns({"n_leaves": F.col("n_single") + (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
        top = shared.agg(F.max("depth").alias("deepest"), F.min("conv_id").alias("least")).first()
        sums = _rolled_up(own, top["deepest"] or 0)
        # children of the root know their parent; those of a node with one member have the same member
        above = shared.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("f").alias("p"), F.col("l").alias("pl"), F.col("conv_id").alias("above"))
        out = tree.join(sums, key, "left").join(hashes, key, "left").join(above, ["depth", "p", "pl"], "left")
        parent = F.when(F.col("depth") == 1, F.lit(top["least"])).when(F.col("depth") > 1, F.coalesce("above", "conv_id"))
        result = out.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
        result, path = settled(result, "trie")
        paths.remove(path)
    return result


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation begins as the first of its hundred does, for up to five turns by crc32 of its id; a
    null id has no conversation. ids has also those that are left without turns."""
    rows, _ = settled(ordered(conversations).select("conv_id", F.col("depth").alias("turn"), "role", "text"), "trie-original")
    heads = F.crc32(F.col("conv_id").cast("string")) % 6
    ids = rows.select("conv_id").distinct()
    first = rows.where("conv_id % 100 = 0 AND turn <= 5").withColumnRenamed("conv_id", "base")
    given = ids.withColumn("base", F.expr("conv_id - conv_id % 100")).join(first, "base").where(F.col("turn") <= heads)
    return rows.where(F.col("turn") > heads).unionByName(given.select(*rows.columns)), ids


REBUILT_SQL = """
WITH RECURSIVE bits(n, k, v) AS (SELECT range, 0, range FROM range(256)
    UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT n, v FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, i, v) AS (SELECT conv_id, 0, CAST(4294967295 AS BIGINT) FROM ids
    UNION ALL SELECT conv_id, i + 1, xor(crc.v >> 8, tab.v) FROM crc JOIN tab ON tab.n = xor(crc.v & 255, ascii(substr(CAST(conv_id AS VARCHAR), i + 1, 1)))
    WHERE i < length(CAST(conv_id AS VARCHAR))),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = length(CAST(conv_id AS VARCHAR))),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, i, role, text FROM h JOIN o ON o.conv_id = h.base AND i <= h UNION ALL SELECT o.conv_id, i, role, text FROM o JOIN h USING (conv_id) WHERE i > h)
"""

TRIE_SQL = (
    REBUILT_SQL
    + """,
l AS (SELECT ids.conv_id, coalesce(list(md5(role || chr(31) || text) ORDER BY i) FILTER (i IS NOT NULL), []) AS turns,
        coalesce(list(length(text) ORDER BY i) FILTER (i IS NOT NULL), []) AS chars FROM ids LEFT JOIN r ON r.conv_id = ids.conv_id GROUP BY ids.conv_id),
m AS (SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS node, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars, d = len(turns) AS ends
        FROM (SELECT conv_id, turns, chars, unnest(range(len(turns) + 1)) AS d FROM l) t),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
        sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY node, depth),
c AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.node = n.node),
s AS (SELECT list_slice(node, 1, d) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved
        FROM (SELECT w.*, unnest(range(depth + 1)) AS d FROM w) t GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.node = w.node LEFT JOIN w p ON w.depth > 0 AND p.node = list_slice(w.node, 1, w.depth - 1)
"""
)
