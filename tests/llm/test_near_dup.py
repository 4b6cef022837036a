from collections import Counter

import numpy as np
import pytest

from quadrat.llm import near_dup
from quadrat.llm.shingles import Words, similarity, units


def shingles(text):
    w = (text or "").lower().split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def jaccard(a, b):
    shared = (a & b).total()
    return shared / ((a.total() + b.total() - shared) or 1)


def classes(texts, ids, least=0.8):
    """Connected components of all pairs, by brute force."""
    own = [shingles(t) for t in texts]
    label = dict(zip(ids, ids, strict=True))
    for i in range(len(ids)):
        for j in range(i):
            if own[i] and own[j] and (ids[i] == ids[j] or jaccard(own[i], own[j]) >= least):
                a, b = sorted((label[ids[i]], label[ids[j]]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


def test_similarity_is_exact(words):
    import pyarrow as pa

    texts = [" ".join(words(n, n)) for n in (1, 3, 4, 5, 6, 50, 500)] + ["", None, "a b a b a b a b a b a b", "A  b\na b a b a b"]
    for other in texts:
        got = similarity(pa.array(texts, pa.string()), pa.array([other] * len(texts), pa.string()))
        assert np.allclose(got, [jaccard(shingles(t), shingles(other)) if shingles(t) and shingles(other) else 0 for t in texts])


def test_signatures_agree_as_weighted_similarity(words):
    import pyarrow as pa

    a = words(600, 1)
    b = a[:500] + words(100, 2)
    text, region, weight = units(*Words(pa.array([" ".join(a), " ".join(b)])).shingles())
    m = near_dup.dart_minhash(text, region, weight, 1024)
    assert abs((m[0] == m[1]).mean() - jaccard(shingles(" ".join(a)), shingles(" ".join(b)))) < 0.05
    assert np.isfinite(m).all()


@pytest.fixture(scope="module")
def near(words):
    """Copies, near copies, chains of them, boilerplate and short texts."""
    base, other, passage = words(200, 1), words(120, 2), words(60, 3)
    edited = lambda w, seed, n: " ".join([f"z{seed}" if i in {(seed * 37 + k * 61) % len(w) for k in range(n)} else x for i, x in enumerate(w)])
    out = [" ".join(base)] * 3 + [edited(base, s, 1 + s % 6) for s in range(40)] + [" ".join(other), " ".join(other).upper(), " ".join(other[:100])]
    out += [" ".join(words(40, 50 + i) + passage) for i in range(30)] + ["", None, "   ", "one two", "one two", "one two three"]
    return out


def test_classes_equal_brute_force(documents, near):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(documents(near)).collect()}
    assert got == classes(near, list(range(len(near))))


def test_large_buckets_go_by_blocks(documents, near, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 2)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 5)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(documents(near)).collect()}
    assert got == classes(near, list(range(len(near))))


def test_odd_tables(spark, documents, words):
    text = " ".join(words(50, 9))
    docs = documents([text, text, None, text, "lone"], ids=[5, 5, 6, None, 7])
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (6, 6), (7, 7), (None, None)]
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 5, 6, 7]
    none = docs.where("false")
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.keep_one(none).count() == 0


def test_rows_of_one_doc_id_have_the_links_of_all_their_texts(documents, words):
    one, two = words(80, 11), words(80, 12)
    near = " ".join(two[:40] + ["changed"] + two[41:])
    for ids in ([5, 5, 9, 3], [4, 5, 9, 3], [9, 9, 5, 3]):
        docs = documents([" ".join(one), " ".join(two), near, "other words"], ids=ids)
        got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
        assert got == classes([" ".join(one), " ".join(two), near, "other words"], ids)
    kept = near_dup.keep_one(documents([" ".join(two), " ".join(one), near], ids=[5, 5, 9]))
    assert [(r["doc_id"], r["text"]) for r in kept.collect()] == [(5, min(" ".join(one), " ".join(two)))]


def test_members_beyond_the_reach_of_a_head(documents, words):
    """Families around a common template: many at 0.6 to 0.8 of one another, with links among those far from the smallest."""
    import random

    base, out = words(150, 21), []
    for s in range(60):
        own, rng = list(base), random.Random(s // 2)
        for k in range(rng.randint(2, 9)):
            own[rng.randrange(150)] = f"y{s // 2}k{k}"
        if s % 2:
            own[rng.randrange(150)] = f"x{s}"
        out.append(" ".join(own))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(documents(out)).collect()}
    assert got == classes(out, list(range(len(out))))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101)], "a long, b long")
    got, _ = near_dup.components(edges)
    assert {r["class_id"] for r in got.where("id <= 60").collect()} == {0}
    assert {r["class_id"] for r in got.where("id >= 100").collect()} == {100}
