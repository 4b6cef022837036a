"""Queries and operators that take whole tables and texts, against brute force on small inputs."""

import itertools
import random
import re
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from quadrat.operators import community, genomes, stats
from quadrat.plans import catalogue, stats_queries

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def bases(n, rng):
    return "".join(rng.choice("ACGT") for _ in range(n))


def documents(spark, path, texts, langs=None):
    rows = [(i, t, "en" if langs is None else langs[i]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return [re.sub("[^acgt]", "", t.lower()).upper() for t in texts], str(path)


def test_whole_sequences_are_dereplicated(spark, tmp_path):
    rng = random.Random(1)
    own = [bases(80, rng) for _ in range(5)]
    texts = [*own, own[0], own[1][::-1].translate(COMPLEMENT), own[2][:40] + bases(40, rng), own[2][:6], "no such letters: ???", ""]
    seqs, path = documents(spark, tmp_path, texts)
    want = Counter(min(x, x[::-1].translate(COMPLEMENT)) for x in seqs)
    got = {r["seq"]: r["size"] for r in catalogue.QUERIES["dereplicated"](spark, path).collect()}
    assert got == {md5(x.encode()).hexdigest(): n for x, n in want.items()}


def test_frames_of_whole_sequences(spark, tmp_path):
    rng = random.Random(2)
    open_codons = [c for c in (a + b + x for a in "ACGT" for b in "ACGT" for x in "ACGT") if c not in ("TAA", "TAG", "TGA")]
    texts = ["".join(rng.choice(open_codons) for _ in range(n)) for n in (49, 50, 51, 60, 400)] + [bases(n, rng) for n in (0, 2, 149, 152, 170, 200)] + ["GCC" * 60, "GCC" * 60 + "TAA", "GCC" * 60 + "TA", "GCC" * 25 + "ATAA" + "GCC" * 40]
    seqs, path = documents(spark, tmp_path, texts)

    def frames(x):
        codons = [[x[k : k + 3] for k in range(f, len(x) - 2, 3)] for f in range(3)]
        return sum(3 * len(c) >= 150 and not {"TAA", "TAG", "TGA"} & set(c) for c in codons)

    got = {r["doc_id"]: r["frames"] for r in catalogue.QUERIES["open_frames"](spark, path).collect()}
    assert got == {i: frames(x) for i, x in enumerate(seqs)} and len(set(got.values())) > 2


def adjusted(ps):
    order, out, low = sorted(range(len(ps)), key=lambda i: ps[i]), [0.0] * len(ps), 1.0
    for r in range(len(ps), 0, -1):
        i = order[r - 1]
        low = min(low, ps[i] * len(ps) / r)
        out[i] = low
    return out


def test_adjustment_of_all_orders(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    want = adjusted([(k % 997 + 1) / 1000 for k in range(2000)])
    got = {r["id"]: r["q"] for r in catalogue.QUERIES["benjamini_hochberg"](spark, str(tmp_path)).collect()}
    assert len(got) == 2000 and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_adjustment_in_groups_with_nulls(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, round(rng.random() ** 3, 2)])) for i in range(400)]
    got = {r["i"]: r["q"] for r in stats.benjamini_hochberg(spark.createDataFrame(data, "i long, g string, p double"), by=["g"]).collect()}
    assert len(got) == 400 and all((got[i] is None) == (p is None) for i, _, p in data)
    for g in ("a", "b", None):
        own = [(i, p) for i, x, p in data if x == g and p is not None]
        assert [got[i] for i, _ in own] == pytest.approx(adjusted([p for _, p in own]))


def test_no_window_takes_all_rows(spark):
    """Windows without a key see one row for each part of the values."""
    tests = spark.range(50_000).select("id", ((F.col("id") * 7919 % 50_000) / 50_000).alias("p"))
    assert community.upper_median(tests, "p").first()["median"] == 0.5
    assert stats.benjamini_hochberg(tests).count() == 50_000
    cuts = community.running_counts(tests, "p", []).groupBy("__part").count().collect()
    assert len(cuts) > 32 and max(r["count"] for r in cuts) < 2000


def tetramers(seqs):
    """Scores of all 256 by the plain definition, both strands of each run of four bases or more."""
    count = {k: Counter() for k in (2, 3, 4)}
    for seq in seqs:
        for strand in (seq.upper(), seq.upper()[::-1].translate(COMPLEMENT)):
            for run in re.split("[^ACGT]+", strand):
                for k in count:
                    if len(run) >= 4:
                        count[k].update(run[i : i + k] for i in range(len(run) - k + 1))
    out = {}
    for kmer in map("".join, itertools.product("ACGT", repeat=4)):
        a, b, m = count[3][kmer[:3]], count[3][kmer[1:]], count[2][kmer[1:3]]
        variance = a * b / m * (m - a) * (m - b) / m**2 if m else 0
        out[kmer] = (count[4][kmer] - a * b / m) / variance**0.5 if variance > 0 else 0.0
    return out


def test_tetramers_of_all_documents(spark, tmp_path):
    rng = random.Random(4)
    langs = [rng.choice(["en", "fr"]) for _ in range(30)]
    seqs, path = documents(spark, tmp_path, [bases(rng.randrange(60), rng) for _ in langs], langs)
    want = {(g, k): z for g in set(langs) for k, z in tetramers([x for x, y in zip(seqs, langs, strict=True) if y == g]).items()}
    got = {(r["name"], r["kmer"]): r["z"] for r in catalogue.QUERIES["tetramer_profile"](spark, path).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
    assert min(want.values()) < 0


def test_tetramers_of_odd_sequences(spark):
    rows = [("x", "ACGNTTTTACG"), ("x", "acgtacgtt"), ("y", None), ("z", "NNN"), (None, "ACGT"), ("w", "")]
    got = {}
    for r in genomes.tetramer_profile(spark.createDataFrame(rows, "name string, seq string")).collect():
        got.setdefault(r["name"], {})[r["kmer"]] = r["z"]
    assert set(got) == {"x", "z", "w"} and all(len(v) == 256 for v in got.values())
    want = tetramers(["ACGNTTTTACG", "acgtacgtt"])
    assert all(got["x"][k] == pytest.approx(want[k]) for k in want) and set(got["z"].values()) == {0.0}


def test_tails_at_any_degrees_of_freedom(spark):
    known = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (6.634897, 1, 0.01), (0.0, 2, 1.0)]
    got = spark.createDataFrame(known, "h double, df long, p double").select("p", stats.chi2_p(F.col("h"), F.col("df")).alias("got")).collect()
    assert all(r["got"] == pytest.approx(r["p"], abs=1e-6) for r in got)


def test_lineages_of_all_parts(spark, tmp_path):
    data = [("a", "t1", "b1", 1), ("a", "t1", "b2", 30), ("b", "t1", "b1", 40), ("b", "t1", "b1", 50), ("c", "t1", "b1", 2), ("c", "t2", "b1", 9)]
    spark.createDataFrame(data, "p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["shared_lineages"](spark, str(tmp_path)).collect()}
    assert got == {("a", 2, "t1", None), ("b", 2, "t1", "b1"), ("c", 2, None, None)}


def test_queries_over_whole_jobs(spark, monkeypatch):
    from quadrat.operators import selection

    sf = "/root/testdata/sf0.001"
    k = stats.kruskal(stats_queries._values(spark, sf), ["taxon"]).where("k >= 2").count()
    assert catalogue.QUERIES["kruskal_p"](spark, sf).where("p IS NOT NULL").count() == k
    asked = []
    real = selection.accumulation
    monkeypatch.setattr(selection, "accumulation", lambda features, orders=100, seed=1: asked.append(orders) or real(features, orders, seed))
    catalogue.QUERIES["accumulation"](spark, sf)
    assert asked == [100]


def test_equal_sequences_and_references_meet_once(spark):
    from quadrat.sources import references

    own = spark.createDataFrame([(i, "acgt" if i % 2 else "ccgg", "Aa--other" if i % 3 else "Bb") for i in range(60)] + [(60, None, "Aa"), (61, "acgt", None)], "feature_id long, seq string, genus string")
    known = spark.createDataFrame([("ACGT", "Aa", "Aa x")] * 50 + [("ccgg", "Bb", "Bb y"), ("CCGG", "Bb", "Bb z")] * 50, "seq string, genus string, species string")
    out = references.exact_species(own, known)
    assert {r["feature_id"]: r["species"] for r in out.collect()} == {i: "Aa x" if i % 2 and i % 3 and i < 60 else None for i in range(62)}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    at = next(i for i, line in enumerate(joins) if "Join Inner" in line)
    assert sum("Aggregate" in line for line in joins[at:]) >= 2  # both sides are different rows


def test_ranks_are_those_of_different_values(spark):
    rng = random.Random(5)
    rows = [(f"g{i % 2}", float(rng.randrange(6)), float(rng.randrange(4))) for i in range(400)] + [("one", 1.0, 2.0)] * 5
    out = stats.spearman(spark.createDataFrame(rows, "grp string, x double, y double"), ["grp"])
    assert "rank(" not in out._jdf.queryExecution().optimizedPlan().toString()  # no window over the rows of a group
    got = {r["grp"]: (r["n"], r["rho"]) for r in out.collect()}
    for g in ("g0", "g1"):
        own = [r for r in rows if r[0] == g]
        r = [[sum(o[k] < v[k] for o in own) + (sum(o[k] == v[k] for o in own) + 1) / 2 for v in own] for k in (1, 2)]
        mx, my = (sum(v) / len(own) for v in r)
        want = sum((a - mx) * (b - my) for a, b in zip(*r)) / (sum((a - mx) ** 2 for a in r[0]) * sum((b - my) ** 2 for b in r[1])) ** 0.5
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(want, abs=1e-12)
    assert got["one"] == (5, None)


def test_the_first_hit_of_equal_lines_is_the_first_in_the_file(spark, tmp_path):
    import os

    for t in ("supplier", "nation", "region"):
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    n = spark.read.parquet(str(tmp_path / "supplier.parquet")).count()
    rows = [(k % 500, (k * 7) % n, 1, 0.0, 1.0) for k in range(40_000)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_discount double, l_extendedprice double")
    table.coalesce(1).write.option("parquet.block.size", "65536").parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = {r["query"]: r["subject"] for r in catalogue.QUERIES["first_hit_names"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    held = table.coalesce(1).collect()
    want = {}
    for r in held:
        want.setdefault(r["l_orderkey"], r["l_suppkey"])
    assert got == want


def test_parents_by_groups_are_those_of_the_pairs(spark):
    """Also sliced, and with no row for a pair."""
    from quadrat.operators import denoise
    from quadrat.session import ship

    ship(spark)
    rng = random.Random(9)
    counts = spark.createDataFrame([(s, o, float(rng.randrange(1, 9))) for o in range(80) for s in range(6) if rng.random() < 0.7], "sample long, otu long, reads double")
    parts = spark.createDataFrame([(o, f"n{o % 3}" if o % 11 else None, rng.randrange(30) if o % 13 else None) for o in range(80)], "otu long, grp string, place int")
    other = parts.toDF("other", "grp", "p2")
    pairs = parts.join(other, "grp").where("otu < other").select("otu", "other", (100.0 - F.abs(F.col("place") - F.col("p2"))).alias("identity"))
    loose = {"ratio": 0.3, "together": 0.7}
    want = {r["otu"]: r["parent"] for r in denoise.parents(counts, pairs, **loose).collect()}
    links = denoise.group_parents(counts, parts, ["grp"], **loose)
    assert {r["otu"]: r["parent"] for r in links.collect()} == want and len(want) > 5
    table = counts.join(parts.where("grp = 'n1'"), "otu").toArrow()
    for most in (1, 1000, 1 << 22):
        found = denoise._first_parents(table, 84.0, 0.3, 0.7, most).to_pylist()
        assert {r["otu"]: r["other"] for r in found} == {o: p for o, p in want.items() if o % 3 == 1}


def test_letters_are_taken_in_small_slices():
    """Also of a batch of many long rows, of one row longer than a slice, and of nulls."""
    import pyarrow as pa

    from quadrat.operators import reads

    texts = ["ACGTN" * 40_000, None, "ACG", ""] + ["acgt" * 30_000] * 40 + [None]
    batch = pa.record_batch([pa.array(texts)], names=["seq"])
    sizes = [(p.num_rows, sum(len(x or "") for x in p.column(0).to_pylist())) for p in reads._slices(iter([batch]), reads.MOST)]
    assert sum(n for n, _ in sizes) == len(texts) and all(n == 1 or letters <= reads.MOST for n, letters in sizes)
    found = {}
    for part in reads._counted(iter([batch]), 2, 1000):
        for code, n in zip(part.column("code").to_pylist(), part.column("n").to_pylist()):
            found[code] = found.get(code, 0) + n
    want = {}
    for x in texts:
        x = (x or "").upper()
        for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
            two = "ACGT"[a] + "ACGT"[b]
            want[a * 4 + b] = want.get(a * 4 + b, 0) + x.count(two)
    assert found == {k: n for k, n in want.items() if n}


def test_places_of_a_quality_are_counted_before_the_shuffle(spark):
    """Also with null and empty texts and keys, letters beyond ASCII, and slices of a few letters."""
    from quadrat.functions.sequences import quality_scores
    from quadrat.operators import reads
    from quadrat.session import ship

    ship(spark)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(2), rng.choice([None, "", "!I~", "é😀I", "".join(rng.choice("!5I") for _ in range(rng.randrange(60)))])) for _ in range(200)]
    table = spark.createDataFrame(rows, "file string, lane int, qual string")
    for by in (["file"], ["file", "lane"]):
        out = reads.position_quality(table, by)
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for each letter
        want = table.select(*by, F.posexplode(quality_scores("qual")).alias("pos", "q")).groupBy(*by, "pos", "q").agg(F.count("*").alias("n"))
        assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect())) and out.schema.names == want.schema.names
    found = {}
    for part in reads._placed(iter(table.select("qual", "file").toArrow().to_batches()), ["file"], 5):
        for r in part.to_pylist():
            key = r["file"], r["pos"], r["q"]
            found[key] = found.get(key, 0) + r["n"]
    assert found == {(r["file"], r["pos"], r["q"]): r["n"] for r in reads.position_quality(table).collect()}


def test_first_places_of_a_set_are_one_row(spark):
    from quadrat.operators import selection

    rng = random.Random(4)
    rows = [(f"s{s}", f, float(rng.randrange(3))) for s in range(7) for f in range(60)]
    out = selection.accumulation(spark.createDataFrame(rows, "sample string, feature_id long, reads double"), orders=6)
    sets = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line and "in#" in line.split("]")[0]]
    assert len(sets) == 1  # the sets are keys once, not again for each order
    import hashlib

    seen = [[] for _ in range(7)]
    for o in range(1, 7):
        order = sorted((f"s{s}" for s in range(7)), key=lambda s: hashlib.md5(f"{s}-{o}-1".encode()).hexdigest())
        for k in range(7):
            seen[k].append(len({f for s, f, n in rows if n > 0 and s in order[: k + 1]}))
    got = {r["samples"]: r["mean"] for r in out.collect()}
    assert got == {k + 1: pytest.approx(sum(v) / 6) for k, v in enumerate(seen)}


def test_sets_of_names_are_not_shuffled(spark):
    from quadrat.operators import rrna

    hits = spark.createDataFrame(
        [("a", 1, 1, 99.0, 90.0, 100.0), ("a", 2, 2, 99.0, 90.0, 100.0), ("b", 1, 1, 99.0, 70.0, 50.0), ("c", 1, 9, 99.0, 90.0, 50.0), ("d", 1, 1, 91.0, None, 5.0), ("e", 1, 1, 96.0, 90.0, 5.0), ("e", 2, 2, 99.0, 99.0, 4.0), (None, 1, 1, 99.0, 99.0, 4.0)],
        "query string, place int, taxid int, pident double, qcov double, bits double",
    )
    lineages = spark.createDataFrame([(1, "Bacteria", "", "P", "F", "G", "n"), (2, "Bacteria", "", "P", "F", "H", "n")], "taxid int, superkingdom string, kingdom string, phylum string, family string, genus string, name string")
    out = rrna.grouped_names(spark.createDataFrame([(q,) for q in "abcdef"] + [(None,)], "query string"), hits, lineages)
    got = {r["query"]: tuple(r)[1:] for r in out.collect()}
    none = ("Unclassified record", "Unclassified record", "group", 1)
    assert got == {"a": ("Bacteria", "F", "family", 2), "b": ("Bacteria", "Bacteria", "group", 1), "c": none, "d": ("Bacteria", "Bacteria", "group", 1), "e": ("Bacteria", "G", "genus", 1), "f": ("No match", "No match", "", 0), None: ("No match", "No match", "", 0)}
    rows = out._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [k for k, line in enumerate(rows) if "partial_collect_set" in line]
    assert at and not any("Exchange" in rows[k - 1] for k in at)
