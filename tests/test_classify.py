"""Classifiers, abundances, denoising and curation against plain definitions."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import abundance, classify, denoise

RNG = random.Random(11)
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from quadrat.session import ship

    ship(spark)


def genome(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def minimizers_by_hand(seq, k, size):
    rank, out = {c: i for i, c in enumerate(classify.LETTERS)}, Counter()
    for i in range(len(seq) - k + 1):
        window = seq[i : i + k].upper()
        if set(window) <= set("ACGT"):
            words = [window[j : j + size] for j in range(k - size + 1)]
            words += ["".join(COMPLEMENT[c] for c in reversed(w)) for w in words]
            out[min(words, key=lambda w: [rank[c] for c in w])] += 1
    return out


@pytest.mark.parametrize(("k", "size"), [(5, 5), (12, 7), (35, 31)])
def test_minimizers(spark, k, size):
    seqs = {"a": genome(200, 1), "b": genome(60, 2).lower() + "NN" + genome(50, 3), "c": "ACG", "d": "", "e": None, "f": "A" * 50}
    table = spark.createDataFrame(list(seqs.items()), "name string, seq string")
    got = defaultdict(Counter)
    for r in classify.minimizers(table, k, size).withColumn("w", classify.word_text(F.col("minimizer"), size)).collect():
        got[r["name"]][r["w"]] += r["n"]
    assert dict(got) == {name: own for name, seq in seqs.items() if (own := minimizers_by_hand(seq or "", k, size))}


def test_a_long_sequence_is_cut_without_loss(spark):
    import pyarrow as pa

    seq = genome(5000, 8)
    batch = pa.RecordBatch.from_pydict({"own": pa.array([{"x": 1}]), "seq": pa.array([seq])})
    counts = [Counter(), Counter()]
    for n, most in enumerate((1 << 20, 700)):
        for part in classify._minimized(iter([batch]), 15, 9, most):
            for word, many in zip(part.column("minimizer").to_pylist(), part.column("n").to_pylist()):
                counts[n][word] += many
    assert counts[0] == counts[1] and sum(counts[0].values()) == 5000 - 14


def test_index_and_paths_equal_brute_force(spark):
    k, size = 10, 7
    core, refs = genome(60, 20), []
    for i, lineage in enumerate([["b", "x", "1"], ["b", "x", "2"], ["b", "y", "3"], ["c", "z", "4"], ["c"], None]):
        refs.append((lineage, core + genome(120, 30 + i) + (genome(40, 99) if i < 2 else "")))
    reads = [("none", genome(50, 77)), ("short", "ACGT"), ("core", core), ("none", None)] + [(f"r{i}", refs[i % 6][1][50 + i : 130 + i] + refs[(i * 5 + 1) % 6][1][60 : 60 + 2 * i]) for i in range(20)]
    index = classify.minimizer_index(spark.createDataFrame(refs, "lineage array<string>, seq string"), k, size)
    held = defaultdict(set)
    for lineage, seq in refs:
        for w in minimizers_by_hand(seq, k, size):
            held[w].add(tuple(lineage or ()))

    def shared(paths):
        paths = list(paths)
        return next(p for n in range(len(min(paths, key=len)), -1, -1) if len({q[:n] for q in paths}) == 1 for p in [paths[0][:n]])

    want = {w: (shared(own), len(own)) for w, own in held.items()}
    got = {r["w"]: (tuple(r["lineage"]), r["n_lineages"]) for r in index.withColumn("w", classify.word_text(F.col("minimizer"), size)).collect()}
    assert got == want

    table = spark.createDataFrame(reads, "read string, seq string")
    for confidence in (0.0, 0.6):
        rows = {r["read"]: (None if r["lineage"] is None else tuple(r["lineage"]), r["score"], r["hits"], r["windows"]) for r in classify.classified_reads(table, index, k, size, confidence).collect()}
        assert len(rows) == len({name for name, _ in reads})
        for name in rows:
            words = sum((minimizers_by_hand(s or "", k, size) for n, s in reads if n == name), Counter())
            hits = Counter()
            for w, n in words.items():
                if w in want:
                    hits[want[w][0]] += n
            if not hits:
                assert rows[name] == (None, 0, 0, sum(words.values()))
                continue
            score = {p: sum(n for q, n in hits.items() if p[: len(q)] == q) for p in hits}
            best = shared([p for p in score if score[p] == max(score.values())])
            if confidence:
                chain = [best[:n] for n in range(len(best), -1, -1) if sum(m for q, m in hits.items() if q[:n] == best[:n]) >= confidence * sum(words.values())]
                best = chain[0] if chain else None
            assert rows[name] == (best, max(score.values()), sum(hits.values()), sum(words.values()))


def test_bayes_scores_and_support(spark):
    training = [("g1", genome(80, 1)), ("g1", genome(80, 1)[:60] + genome(20, 5)), ("g2", genome(80, 2)), ("g3", genome(70, 3)), (None, genome(70, 4)), ("g3", None)]
    reads = [("a", genome(80, 1)[10:70]), ("b", genome(80, 2)[:40] + genome(70, 3)[:38]), ("c", "ACG"), ("d", genome(60, 44))]
    words = lambda s: {s[i : i + 8] for i in range(len(s or "") - 7)}
    own = [(g, words(s)) for g, s in training if g]
    genera = Counter(g for g, _ in own)
    prior = {w: (sum(w in x for _, x in own) + 0.5) / (len(own) + 1) for w in set().union(*(x for _, x in own))}
    score = lambda ws, g: sum(math.log((sum(w in x for h, x in own if h == g) + prior[w]) / (genera[g] + 1)) for w in ws if w in prior)
    train, table = spark.createDataFrame(training, "genus string, seq string"), spark.createDataFrame(reads, "read string, seq string")
    got = {(r["read"], r["genus"]): r["score"] for r in classify.bayes_scores(classify.different_words(table), classify.bayes_model(train), ["read"]).collect()}
    want = {(n, g): score(words(s), g) for n, s in reads for g in genera if any(w in x for h, x in own if h == g for w in words(s))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    named = {r["read"]: r for r in classify.bayes_genera(table, train).collect()}
    assert named["a"]["genus"] == "g1" and named["a"]["support"] > 0.95
    assert "c" not in named
    # support against trials drawn here: its error is that of two draws of a hundred
    r, ws, hit = random.Random(3), sorted(words(reads[1][1])), 0
    for _ in range(400):
        some = [w for w in ws if r.random() < 1 / classify.PART and w in prior]
        hit += bool(some) and min(genera, key=lambda g: (-score(some, g), g)) == named["b"]["genus"]
    assert abs(hit / 400 - named["b"]["support"]) < 4 * math.sqrt(0.25 / 100 + 0.25 / 400)


def em_by_hand(rows, rounds):
    reads = defaultdict(dict)
    for read, ref, loglik in rows:
        reads[read][ref] = max(loglik, reads[read].get(ref, -1e9))
    refs = sorted({r for own in reads.values() for r in own})
    like = np.array([[math.exp(own[r] - max(own.values())) if r in own else 0 for r in refs] for own in reads.values()])
    share, fits = np.full(len(refs), 1 / len(refs)), []
    for _ in range(rounds):
        part = like * share
        fits.append(np.log(part.sum(axis=1)).sum())
        share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
    return dict(zip(refs, share)), fits


def test_em_equals_a_dense_one(spark):
    r = random.Random(6)
    rows = {s: [(f"{s}{i}", f"t{j}", -r.random() * 5) for i in range(60) for j in r.sample(range(6), r.choice([1, 2, 3]))] for s in "xy"}
    rows["x"] += [("x0", "t1", -9.0), ("x1", "t1", -9.0)]
    rows["x"] += [(f"x{90 + i}", t, -1.0) for i in range(20) for t in ("t2", "t5")]  # equal reads
    table = spark.createDataFrame([(s, *row) for s, own in rows.items() for row in own] + [("x", "x7", None, -1.0), ("x", "x8", "t1", None)], "sample string, read string, ref string, loglik double")
    trace = []
    got = abundance.em_abundance(table, rounds=6, gain=0.0, trace=trace).collect()
    for s, own in rows.items():
        share, fits = em_by_hand(own, 7)
        mine = {g["ref"]: g["share"] for g in got if g["sample"] == s}
        assert mine.keys() == share.keys() and all(abs(mine[k] - share[k]) < 1e-9 for k in share)
        seen = [t[s] for t in trace]
        assert np.allclose(seen, fits[: len(seen)]) and all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))
        assert abs(sum(g["reads"] for g in got if g["sample"] == s) - len({x[0] for x in own})) < 1e-6


def test_rare_references_go_and_rounds_end(spark):
    rows = [("s", f"r{i}", "big", -1.0) for i in range(50)] + [("s", "r0", "small", -6.0), ("t", "only", "one", 0.0)]
    out = {(r["sample"], r["ref"]): r["share"] for r in abundance.em_abundance(spark.createDataFrame(rows, "sample string, read string, ref string, loglik double"), least=0.01).collect()}
    assert out == {("s", "big"): 1.0, ("t", "one"): 1.0}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(seq, n, r):
    s = list(seq)
    for _ in range(n):
        at = r.randrange(len(s))
        s[at : at + 1] = r.choice([[r.choice("ACGT")], [], [s[at], r.choice("ACGT")]])
    return "".join(s)


@pytest.mark.parametrize("alpha", [2.0, 1.0])
def test_denoising_equals_the_quadratic_rule(spark, alpha):
    r, rows = random.Random(8), []
    for base in (genome(40, 1), genome(44, 2), genome(12, 3), "ACG"):
        rows.append((base, r.choice([3000, 40_000])))
        rows += [(mutated(base, r.choice([1, 1, 2, 3, 5]), r), r.choice([1, 8, 20, 100, 900])) for _ in range(45)]
    rows += [(None, 99), ("", 9), ("T", 8000), ("TA", 9)]
    size = Counter()
    for seq, n in rows:
        if seq is not None:
            size[seq] += n
    size = {s: n for s, n in size.items() if n >= 8}
    may = lambda s, t: math.floor((math.log2(size[t] / size[s]) - 1) / alpha + 1e-9)
    links = {(s, t): d for s in size for t in size if s != t and size[t] > size[s] and may(s, t) >= 1 and abs(len(s) - len(t)) <= may(s, t) and (d := edit(s, t)) <= may(s, t)}
    table = spark.createDataFrame(rows, "seq string, size long")
    summed = table.groupBy("seq").agg(F.sum("size").alias("size"))
    got = {(x["child"], x["parent"]): x["differences"] for x in denoise.skew_links(summed, alpha).collect()}
    assert got == links and len(links) > 100
    centres, want = set(), {}
    for s in sorted(size, key=lambda s: -size[s]):
        own = [(links[s, t], -size[t], t) for t in centres if (s, t) in links]
        want[s] = (min(own)[2], min(own)[0]) if own else (s, 0)
        centres |= set() if own else {s}
    assert {x["seq"]: (x["centroid"], x["differences"]) for x in denoise.denoised(table, alpha).collect()} == want


@pytest.mark.parametrize("short", [0, 3, 8])
def test_links_of_short_sequences_meet_by_what_is_left(spark, monkeypatch, short):
    """Whether seeds or deletions find them, the links are those of all pairs; each pair is looked for at its own differences."""
    monkeypatch.setattr(denoise, "SHORT", short)
    r = random.Random(9)
    size = {"".join(r.choice("abc") for _ in range(r.randint(1, 9))): r.choice([7, 8, 30, 70, 300, 2500]) for _ in range(160)}
    size |= {"": 5000, "a": 40, "ab": 9000}
    may = lambda s, t: min(2, math.floor((math.log2(size[t] / size[s]) - 1) / 2 + 1e-9))
    good = [s for s in size if size[s] >= 8]
    want = {(s, t, d) for s in good for t in good if s != t and may(s, t) >= 1 and (d := edit(s, t)) <= may(s, t)}
    table = spark.createDataFrame(list(size.items()), "seq string, size long")
    got = denoise.skew_links(table, most=2).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 100


@pytest.mark.parametrize(("short", "cell"), [(8, 4096), (8, 3), (1, 5)])
def test_links_at_many_differences_are_whole(spark, monkeypatch, short, cell):
    """Without a bound the sizes alone tell how many differences a link may have, for short sequences too."""
    monkeypatch.setattr(denoise, "SHORT", short)
    monkeypatch.setattr(denoise, "CELL", cell)
    r = random.Random(10)
    size = {"".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))): r.choice([8, 9, 31, 64, 300, 1024, 2500, 70_000, 5_000_000]) for _ in range(200)}
    size |= {"": 5_000_000, "É": 8, "abcd": 8 << 13}
    may = lambda s, t: math.floor((math.log2(size[t] / size[s]) - 1) / 2 + 1e-9)
    want = {(s, t, d) for s in size for t in size if s != t and may(s, t) >= 1 and (d := edit(s, t)) <= may(s, t)}
    got = denoise.skew_links(spark.createDataFrame(list(size.items()), "seq string, size long")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) and {d for _, _, d in want} >= {3, 4, 5, 6}


def test_the_query_of_links_has_no_bound(spark):
    from quadrat.plans.denoise_queries import _words, skew_links

    size = {x["seq"]: x["size"] for x in _words(spark, "/root/testdata/sf0.001").collect() if x["size"] >= 8}
    far = [(s, t) for s in size for t in size if size[t] >= 128 * size[s] and abs(len(s) - len(t)) <= 4]
    want = {(s, t) for s, t in far if 3 <= edit(s, t) <= math.floor((math.log2(size[t] / size[s]) - 1) / 2 + 1e-9)}
    got = {(x["child"], x["parent"]) for x in skew_links(spark, "/root/testdata/sf0.001").collect() if x["differences"] >= 3}
    assert got == want and len(want) > 10


def test_sequences_are_counted_once_for_their_links(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    table = spark.createDataFrame([("AAAA", 100), ("AAAC", 8), ("AATT", 8)], "seq string, size long")
    assert [tuple(x) for x in denoise.skew_links(table.mapInPandas(count, table.schema)).collect()] == [("AAAC", "AAAA", 1)]
    assert seen.value == 3


def test_denoising_of_nothing_and_with_a_bound(spark):
    table = spark.createDataFrame([("AAAA", 100), ("AAAC", 8), ("AATT", 8)], "seq string, size long")
    assert denoise.denoised(table.where("false")).count() == 0
    assert {(r["seq"], r["centroid"]) for r in denoise.denoised(table.where("size = 8")).collect()} == {("AAAC", "AAAC"), ("AATT", "AATT")}
    assert {(r["child"]) for r in denoise.skew_links(table, most=1).collect()} == {"AAAC"}


def test_curation_equals_the_plain_rule(spark):
    r = random.Random(4)
    counts = {(f"s{i}", f"o{j}"): r.choice([0, 1, 5, 40]) for i in range(8) for j in range(25) if r.random() < 0.7}
    matches = [(f"o{a}", f"o{b}", r.choice([80.0, 84.0, 97.0])) for a, b in combinations(range(25), 2) if r.random() < 0.5]
    own = defaultdict(dict)
    for (s, o), n in counts.items():
        if n:
            own[o][s] = n
    rank = {o: (-len(x), -sum(x.values()), o) for o, x in own.items()}
    near = {frozenset(m[:2]) for m in matches if m[2] >= 84}
    parent = {}
    for o in own:
        good = [p for p in own if frozenset((o, p)) in near and p != o and rank[p] < rank[o]]
        good = [p for p in good if (both := own[o].keys() & own[p].keys()) and len(both) >= 0.6 * len(own[o]) and min(own[p][s] / own[o][s] for s in both) > 0.1]
        if good:
            parent[o] = min(good, key=rank.get)
    limits = {"ratio": 0.1, "together": 0.6}
    c = spark.createDataFrame([(s, o, n) for (s, o), n in counts.items()], "sample string, otu string, reads long")
    m = spark.createDataFrame([(b, a, i) if r.random() < 0.5 else (a, b, i) for a, b, i in matches], "otu string, other string, identity double")
    assert {x["otu"]: x["parent"] for x in denoise.parents(c, m, **limits).collect()} == parent and len(parent) > 5

    def root(o):
        return root(parent[o]) if o in parent else o

    want = Counter()
    for (s, o), n in counts.items():
        want[s, root(o)] += n
    assert {(x["sample"], x["otu"]): x["reads"] for x in denoise.curated(c, m, **limits).collect()} == dict(want)


def test_roots_of_a_long_chain(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("otu"), (F.col("id") - 1).alias("parent"))
    assert {r["root"] for r in denoise.roots(chain).collect()} == {0}


def test_bayes_by_blocks_and_parts(spark, monkeypatch):
    """Blocks of reads and parts of the genera change no score, and no row of words, trials and genera leaves a task."""
    rng = random.Random(8)
    train = spark.createDataFrame([(f"g{k % 5}", "".join(rng.choice("ACGT") for _ in range(60))) for k in range(15)], "genus string, seq string")
    reads = spark.createDataFrame([(f"r{k % 20}", "".join(rng.choice("ACGT") for _ in range(300))) for k in range(25)] + [(None, "ACGTACGTACGT")], "read string, seq string")
    found = []
    for words, gains in ((10**6, 10**6), (400, 150)):
        monkeypatch.setattr(classify, "BLOCK_WORDS", words)
        monkeypatch.setattr(classify, "MOST_GAINS", gains)
        scores = classify.bayes_scores(classify.different_words(reads), classify.bayes_model(train), ["read"])
        assert "Join" not in scores._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
        named = classify.bayes_genera(reads, train)
        found.append(({(r["read"], r["genus"]): round(r["score"], 6) for r in scores.collect()}, {r["read"]: (r["genus"], round(r["score"], 6), r["support"]) for r in named.collect()}))
    assert found[0] == found[1] and len(found[0][0]) > 20 and any(v[2] > 0 for v in found[0][1].values())
