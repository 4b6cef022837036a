import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrat.llm import decontaminate
from quadrat.llm.decontaminate import ItemIndex, clean_run, simhash
from quadrat.llm.shingles import U, Words


def shingles(w):
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def holds(words, item, least=0.8):
    want, n = shingles(item), len(item)
    for size in (n, n - 1, n + 1) if n > 5 else (n,):
        for at in range(len(words) - size + 1):
            own = shingles(words[at : at + size])
            shared = (own & want).total()
            if shared / (own.total() + want.total() - shared) >= least:
                return True
    return False


def test_simhash_is_the_majority_of_the_bits():
    import numpy as np

    rng = np.random.default_rng(1)
    for m in (1, 2, 4, 5, 11, 12):
        x = rng.integers(0, 2**63, (50, m)).astype(U)
        want = [sum(1 << b for b in range(64) if sum(int(v) >> b & 1 for v in row) * 2 >= m) for row in x.tolist()]
        assert simhash(x).tolist() == want


def test_block_lookup_finds_all_within_the_radius(words):
    import numpy as np

    index = ItemIndex([(i, " ".join(words(30, i))) for i in range(20)])
    rng = random.Random(5)
    for *_, tables in index.sized + index.runs:
        radius = len(tables[3]) - 1
        prints = np.array([int(p) ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(radius + 3))}) for p in tables[0].tolist() * 3], U)
        which, item, place = index.proposals(prints, tables)
        want = {(w, int(tables[1][k]), int(tables[2][k])) for w in range(len(prints)) for k in range(len(tables[0])) if bin(int(prints[w]) ^ int(tables[0][k])).count("1") <= radius}
        assert set(zip(which.tolist(), item.tolist(), place.tolist(), strict=True)) == want


def test_item_sized_windows_alone_find_passages_within_the_radius(words):
    """Without the run windows: what the items' own windows propose within the radius is found, wherever it stands."""
    for size in (15, 30, 59):
        item = words(size, size)
        index = ItemIndex([(7, " ".join(item)), (8, " ".join(words(size, 1000 + size)))])
        index.runs = []
        own = list(item)
        own[-1] = "changed"
        apart = int(np.bitwise_count(index.sized[0][2][0][0] ^ simhash(decontaminate._rolling(Words(pa.array([" ".join(own)])).hash, 5)[None, :])[0]))
        for text, near in ((item, True), (own, apart <= decontaminate.RADIUS)):
            found = index.leaks(Words(pa.array(["", " ".join(words(33, 1) + text + words(41, 2))])))
            assert [(x[0], x[1]) for x in found] == [(1, 0)] * near and (not near or found[0][2] == 33)


@pytest.mark.parametrize("size", [3, 5, 9, 14, 20, 33, 45, 59, 120])
def test_edited_passages(words, size):
    rng = random.Random(size)
    item = words(size, size)
    index = ItemIndex([(7, " ".join(item))])
    assert clean_run(size) >= min(size, 5)
    for trial in range(60):
        own = list(item)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[f"new{trial}"], [], [own[k], "more"]])
            if not own:
                break
        text = words(rng.randrange(30), trial) + own + words(rng.randrange(30), trial + 1)
        assert bool(index.leaks(Words(pa.array([" ".join(text)])))) == (best_of_any_length(text, item) >= 0.8)


def best_of_any_length(words, item):
    want = shingles(item)
    size = min(5, len(item))
    best = 0.0
    for a in range(len(words) - size + 1):
        own, shared = Counter(), 0
        for k in range(a, min(len(words) - size + 1, a + 2 * len(item))):
            gram = tuple(words[k : k + size])
            own[gram] += 1
            shared += own[gram] <= want[gram]
            best = max(best, shared / (own.total() + want.total() - shared))
    return best


@pytest.mark.parametrize(("size", "cut"), [(59, 2), (59, 7), (30, 2), (30, 4), (30, 5), (15, 2)])
def test_shortened_passages(words, size, cut):
    item = words(size, size)
    index = ItemIndex([(7, " ".join(item))])
    for own in (item[:-cut], item[cut:]):
        for text in (own, words(23, 1) + own + words(20, 2)):
            found = index.leaks(Words(pa.array([" ".join(text)])))
            assert [x[3] for x in found] == [size - cut] and found[0][4] == pytest.approx((size - cut - 4) / (size - 4))


@pytest.mark.parametrize("size", [3, 6, 11, 15, 22, 30, 40, 59])
def test_windows_of_any_length(words, size):
    rng = random.Random(100 + size)
    for trial in range(16):
        item = words(size, size + trial)
        if trial % 4 == 0:  # words that recur
            item = [rng.choice(item[: max(2, size // 2)]) for _ in item]
        own = list(item)
        for _ in range(rng.randrange(4)):
            k, d = rng.randrange(len(own)), rng.randrange(1, 5)
            own = rng.choice([own[:k] + own[k + 1 :], own[:-1], own[1:], own[d:], own[:k] + ["new"] + own[k:], own[:k] + own[max(0, k - d) :], own[k:] + own[:k]]) or ["x"]
        text = words(rng.randrange(20), trial) + own + words(rng.randrange(20), trial + 1)
        want = best_of_any_length(text, item)
        found = ItemIndex([(7, " ".join(item))]).leaks(Words(pa.array([" ".join(text)])))
        assert [round(x[4], 9) for x in found] == ([round(want, 9)] if want >= 0.8 else []), (trial, item, text)


def test_tables(spark, documents, words):
    item = " ".join(words(30, 1))
    docs = documents(["clean text only", f"before {item} after", None, "", item.upper(), " ".join(words(3000, 8)) + " " + item, f"twice {item} {item}"])
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "y"), (None, "a b c d e f g", "z"), (3, "  ", "w"), (1, item, "again")], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: sorted({x["item_id"] for x in r["leaks"]}) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {0: [], 1: [1], 2: [], 3: [], 4: [1], 5: [1], 6: [1]}
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert decontaminate.drop_leaks(docs, bench.where("false")).count() == 7
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0
    assert decontaminate.with_leaks(docs, bench, block_words=1).where("size(__leaks) > 0").count() == 4
    more = bench.unionByName(bench.where("item_id = 1").selectExpr("10L AS item_id", "text", "doc_id"))
    rows = documents([None, item, f"x {item}"], ids=[4, None, 4]).withColumn("__leaks", F.lit("own")).withColumn("d", F.lit(1))
    for block_words in (1, 10**6):
        got = decontaminate.with_leaks(rows, more, block_words=block_words, column="found")
        assert got.columns == [*rows.columns, "found"]
        assert sorted((str(r["doc_id"]), r["text"] is None, sorted({x["item_id"] for x in r["found"]})) for r in got.collect()) == [("4", False, [1, 10]), ("4", True, []), ("None", False, [1, 10])]
    assert decontaminate.drop_leaks(rows, more).collect()[0]["__leaks"] == "own"
