import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quadrat.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark, words):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(900):
        w = words(rng.choice([6, 40, 200]), i)
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["Blockhead", "nitwit,", "DUNCE"])
        rows.append((i, " ".join(w), "en"))
        marks.append((i, int(bad), 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in rows)


def test_held_out_labels_are_never_learned_from(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, turned))
    assert np.allclose(a.weights, b.weights, rtol=1e-6, atol=1e-9) and abs(a.intercept - b.intercept) < 1e-6


def test_ngrams_are_those_of_each_text():
    texts = ["Abc def", "", None, "ab", "é-é", "abc abc"]
    got = toxicity.ngrams(pa.array(texts))
    alone = [toxicity.ngrams(pa.array([t], pa.string())) for t in texts]
    assert got.tolist() == [i << toxicity.BITS | int(k) for i, own in enumerate(alone) for k in own]
    assert len(toxicity.ngrams(pa.array(["abcdef"]))) == len({f" abcdef "[i : i + n] for n in toxicity.SIZES for i in range(9 - n)})
    wanted = np.zeros(1 << toxicity.BITS, bool)
    wanted[got[::2] & (1 << toxicity.BITS) - 1] = True
    assert toxicity.ngrams(pa.array(texts), wanted).tolist() == [k for k in got.tolist() if wanted[k & (1 << toxicity.BITS) - 1]]


def test_odd_tables(spark, documents):
    docs = documents(["one two", None, "", "one two"], ids=[3, 3, None, 9])
    labels = spark.createDataFrame([(3, 1), (9, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    for own in (labels, labels.where("false"), labels.where("doc_id = 3")):
        rows = toxicity.score(docs, own).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.where("false"), labels).count() == 0


def by_hand(texts, marks, held, share):
    """Scores of all texts by the plain definition: counts feature by feature, log ratios, Newton's method on all weights."""
    sets = [set(toxicity.ngrams(pa.array([t], pa.string())).tolist()) for t in texts]
    train = [i for i in range(len(texts)) if not held[i]]
    n = [sum(marks[i] == c for i in train) for c in (0, 1)]
    total, rate, scale = sum(n), n[1] / sum(n), {}
    for f in sorted(set().union(*(sets[i] for i in train))):
        has = [sum(f in sets[i] for i in train if marks[i] == c) for c in (0, 1)]
        df = sum(has)
        if df < 2:
            continue
        z2 = (has[1] - df * rate) ** 2 / (df * rate * (1 - rate) * max(1 - df / total, 0.02))
        scale[f] = (np.log((has[1] + 1) / (n[1] + 2)) - np.log((has[0] + 1) / (n[0] + 2))) * z2 / (z2 + toxicity.NOISE**2)
    names = list(scale)
    x = np.array([[scale[f] if f in s else 0.0 for f in names] + [1.0] for s in sets])
    # the best weights are sums of the texts' own features: Newton's method on one number a text, and the intercept
    own, y = x[train], np.array([marks[i] for i in train], float)
    gram, a, b = own[:, :-1] @ own[:, :-1].T / toxicity.RIDGE, np.zeros(len(train)), 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(gram @ a + b)))
        curve = np.diag(p * (1 - p))
        top = np.concatenate([np.eye(len(train)) + curve @ gram, (p * (1 - p))[:, None]], axis=1)
        step = np.linalg.solve(np.concatenate([top, [[*((p * (1 - p)) @ gram), (p * (1 - p)).sum()]]]), np.append(y - p - a, (y - p).sum()))
        a, b = a + step[:-1], b + step[-1]
    w = np.append(own[:, :-1].T @ a / toxicity.RIDGE, b)
    return 1 / (1 + np.exp(-(x @ w + np.log(share[1] / share[0]) - np.log(n[1] / n[0])))), len(names)


def test_scores_equal_the_plain_definition(spark, words):
    rng = random.Random(9)
    texts, marks = [], []
    for i in range(160):
        w = words(rng.choice([5, 30]), 500 + i)
        marks.append(int(i % 4 == 0))
        if marks[-1]:
            w.insert(rng.randrange(len(w)), rng.choice(["nitwit", "dunce"]))
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lost = [(1000 + i, 1) for i in range(50)]  # labels without a document count for nothing
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + lost, "doc_id long, toxic int")
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(160)]
    share = [sum(m == c for m, h in zip(marks, held, strict=True) if not h) for c in (0, 1)]
    want, features = by_hand(texts, marks, held, share)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    assert features > 1000  # every feature of two training texts
    assert np.allclose([got[i] for i in range(160)], want, atol=2e-3)


def test_columns_of_any_name_stay(documents, spark):
    from pyspark.sql import functions as F

    docs = documents(["one two", None], ids=[3, None]).withColumn("__score", F.lit("own")).withColumn("score", F.lit(7))
    kept = toxicity.keep_clean(docs, spark.createDataFrame([(3, 0)], "doc_id long, toxic int"))
    assert kept.schema.simpleString() == docs.schema.simpleString() and {(r["__score"], r["score"]) for r in kept.collect()} == {("own", 7)}


def test_small_tables_are_told_apart(spark, words):
    """No switch by size: a few dozen labels give as many scores as there are texts, and the toxic ones the highest."""
    texts = [" ".join(words(20, 900 + i) + (["nitwit"] if i % 6 == 0 else [])) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(60)], "doc_id long, toxic int")
    rows = sorted(toxicity.score(docs, labels).collect(), key=lambda r: -r["score"])
    assert len({r["score"] for r in rows}) >= 55  # a text whose features no other text has gets the intercept
    assert sum(r["doc_id"] % 6 == 0 for r in rows[:10]) >= 9


def test_least_finds_the_minimum():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 12))
    h, b = a.T @ a + 0.1 * np.eye(12), rng.normal(size=12)
    found = toxicity.least(lambda x: (float(x @ h @ x / 2 - b @ x), h @ x - b), np.zeros(12), rounds=200, tolerance=1e-14)
    assert np.allclose(found, np.linalg.solve(h, b), atol=1e-4)


def test_packed_places_come_back():
    rng = np.random.default_rng(8)
    own = [np.sort(rng.choice(1 << 20, n, replace=False)) for n in (0, 1, 5, 4000, 0, 90_000)] + [np.array([0]), np.array([0, 255, 510, 511]), np.array([], np.int64)]
    text = np.repeat(np.arange(len(own)), [len(x) for x in own])
    data = toxicity.packed(text, np.concatenate(own).astype(np.int64), len(own))
    for rows in (pa.array(data, pa.binary()), pa.array([b"xyz", *data], pa.binary()).slice(1)):
        places, first = toxicity.unpacked(rows)
        assert [places[lo:hi].tolist() for lo, hi in zip(first, first[1:])] == [x.tolist() for x in own]
    assert toxicity.packed(np.empty(0, np.int64), np.empty(0, np.int64), 2) == [b"", b""]
