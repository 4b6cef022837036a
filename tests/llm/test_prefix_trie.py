"""Operator 13: the trie of conversation prefixes against a dictionary of all prefixes."""

import hashlib
import random

import pytest

from quadrat.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows, ids=()):
    turns = {c: [] for c in ids if c is not None}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: tuple((role, text) for _, _, role, text in sorted(own)) for c, own in turns.items()}
    members, children = {}, {}
    for c, own in whole.items():
        for d in range(len(own) + 1):
            members.setdefault(own[:d], []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in below)
    ends = {node: ",".join(str(c) for c in sorted(own) if whole[c] == node) for node, own in members.items()}
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else -99, len(own), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends[node].encode()).hexdigest())
        for node, own in members.items()
    )


def nodes(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-99 if v is None else v for v in r) for r in df.select(*columns).collect())


def drawn(seed, conversations=range(-3, 25)):
    rnd, rows = random.Random(seed), [(None, 1, "u", "x")]
    for c in conversations:
        for turn in range(rnd.choice([1, 3, 6, 20])):
            rows.append((c, rnd.choice([turn, turn, None]), rnd.choice(["u", "u", "u", None, "a"]), rnd.choice(["x", "x", "x", "Äy", " ", None])))
    return rows


@pytest.mark.parametrize("primes", [prefix_trie.PRIMES, (7, 3), (3, 2)], ids=["wide", "narrow", "nearly none"])
def test_trie_equals_the_prefixes(spark, primes):
    """With narrow fingerprints most groups hold different prefixes, and have to be split."""
    rows, ids = drawn(5), [100, 3, None]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(c,) for c in ids], "conv_id long"), primes)
    assert nodes(got) == by_hand(rows, ids)


def test_a_conversation_over_several_parts_and_batches(spark):
    """One conversation has most turns, so it is dealt over several ranges; a copy of it ends a little earlier."""
    rows = [(7, t, "u", f"{t % 5}") for t in range(400)] + [(8, t, "u", f"{t % 5}") for t in range(390)] + drawn(6, range(4))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_many_members_of_one_node(spark):
    """More ids than a chunk holds, negative ones among them, in numerical order."""
    ids = [*range(-10, 5000), 10**12, -(10**12)]
    rows = [(c, 0, "system", "hi") for c in ids]
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", depth int, F string")
    assert prefix_trie.prefix_trie(empty).count() == 0
    only = prefix_trie.prefix_trie(empty, spark.createDataFrame([(4,), (None,)], "conv_id int"))
    assert nodes(only) == by_hand([], [4])
    long = "x" * 300_000
    rows = [(1, None, None, None), (1, None, None, None), (2, None, "", ""), (3, 1, "u", long), (4, 2, "u", long)]
    clash = spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA + ", depth int, F string")
    assert nodes(prefix_trie.prefix_trie(clash)) == by_hand(rows)


def test_rebuilt_takes_the_first_turns_of_the_hundred(spark):
    import zlib

    rows = [(c, t, "u", f"{c} {t}") for c in (0, 1, 2, 57, 99, 101, 250) for t in range(4)]
    turns, ids = prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in turns.collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    own = {c: [t for x, _, _, t in rows if x == c] for c, *_ in rows}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        assert [t for _, t in sorted(got.get(c, []))] == own.get(c - c % 100, [])[:h] + own[c][h:]
    assert sorted(r[0] for r in ids.collect()) == sorted(own)
