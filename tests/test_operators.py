"""Operators on the 6 x 3 count matrix and other small inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from quadrat.operators import community, diversity, genomes, intervals, naming, network, ordination, reads, stats

MATRIX = {"f0": (50, 10, 0), "f1": (30, 30, 30), "f2": (5, 40, 20), "f3": (10, 0, 40), "f4": (3, 3, 3), "f5": (2, 17, 7)}


@pytest.fixture(scope="module")
def features(spark):
    rows = [(f"s{i + 1}", f, float(n)) for f, own in MATRIX.items() for i, n in enumerate(own) if n]
    return spark.createDataFrame(rows, "sample string, feature_id string, reads double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_alpha(features):
    a = {r["sample"]: r for r in diversity.alpha(features).collect()}
    assert a["s1"]["observed"] == 6 and a["s1"]["chao1"] == 6
    assert abs(a["s1"]["simpson"] - 0.6462) < 1e-12
    assert abs(a["s1"]["shannon"] + sum(p * math.log(p) for p in (0.5, 0.3, 0.05, 0.1, 0.03, 0.02))) < 1e-12


def test_bray_curtis_and_jaccard(features):
    assert abs(rows(diversity.bray_curtis(features), "i", "j")[0][2] - 0.5) < 1e-12
    assert abs(rows(diversity.bray_curtis(features, on_counts=True), "i", "j")[0][2] - 0.5) < 1e-12
    assert rows(diversity.jaccard(features), "i", "j")[0] == ("s1", "s2", pytest.approx(1 - 5 / 6))


def test_bray_curtis_of_samples_without_common_features_and_empty_ones(spark):
    f = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), ("c", "z", 0.0), ("d", "z", 0.0)], "sample string, feature_id string, reads double")
    out = {(r["i"], r["j"]): r["d"] for r in diversity.bray_curtis(f).collect()}
    assert out == {("a", "b"): 1.0, ("a", "c"): 1.0, ("a", "d"): 1.0, ("b", "c"): 1.0, ("b", "d"): 1.0, ("c", "d"): 0.0}


def test_empty_tables(spark, features):
    none = features.where("false")
    assert diversity.alpha(none).count() == 0
    assert diversity.bray_curtis(none).count() == 0
    assert community.top_taxa(community.with_share(none.withColumnRenamed("feature_id", "taxon")), 3).count() == 0
    assert community.looks_like_ppm(none).first()[0] is False


def test_top_taxa_keep_unclassified_apart(features):
    counts = community.with_share(features.select("sample", F.when(F.col("feature_id") == "f1", "Unclassified").otherwise(F.col("feature_id")).alias("taxon"), "reads"))
    top = {(r["sample"], r["taxon"]): r["value"] for r in community.top_taxa(counts, 2).collect()}
    assert set(t for _, t in top) == {"f0", "f2", "Other", "Unclassified"}
    assert top["s1", "Other"] == pytest.approx(15.0) and top["s3", "Unclassified"] == pytest.approx(30.0)


def test_negative_controls_flag(spark):
    c = spark.createDataFrame([("n", "A", 90.0), ("n", "B", 10.0), ("s", "A", 1.0), ("s", "B", 99.0)], "sample string, taxon string, reads double")
    got = rows(community.negative_controls(community.with_share(c), spark.createDataFrame([("n",)], "sample string")), "taxon")
    assert [(r[0], r[-1]) for r in got] == [("A", True), ("B", False)]


def test_interval_union_and_merge(spark):
    iv = spark.createDataFrame([("k", 0, 10), ("k", 5, 20), ("k", 20, 25), ("k", 40, 50)], "k string, start int, end int")
    assert intervals.union_length(iv, ["k"]).first()["covered"] == 35
    iv = spark.createDataFrame([("k", 1, 5), ("k", 100, 200), ("k", 150, 300)], "k string, start int, end int")
    merged = intervals.islands(iv, ["k"], gap=10)
    assert rows(merged, "start") == [("k", 1, 5), ("k", 100, 300)]
    assert rows(intervals.gaps(merged.select("k", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")), ["k"], 0.0, 400.0, 50), "start") == [("k", 5.0, 100.0), ("k", 300.0, 400.0)]


def test_n50_and_runs(spark):
    x = spark.createDataFrame([("a", n) for n in (2, 2, 2, 3, 3, 4, 8, 8)], "k string, length long")
    assert rows(intervals.n50(x, ["k"]), "k") == [("a", 8, 32, 8)]
    depth = spark.createDataFrame([("a", i, d) for i, d in enumerate([5, 1, 0, 7, 2, 2, 2])], "k string, pos int, depth int")
    assert rows(intervals.low_runs(depth, ["k"], "pos", "depth", 2).select("start", "end", "n"), "start") == [(1, 2, 2), (4, 6, 3)]


def test_kruskal_and_adjustment(spark):
    v = spark.createDataFrame([("t", "a", x) for x in (1.0, 2.0, 3.0)] + [("t", "b", x) for x in (4.0, 5.0, 6.0)], "taxon string, grp string, value double")
    k = stats.kruskal(v, ["taxon"]).first()
    assert k["h"] == pytest.approx(3.857142857) and k["df"] == 1
    p = spark.createDataFrame([(i, x) for i, x in enumerate((0.01, 0.04, 0.03, 0.005, None))], "i int, p double")
    q = [r["q"] for r in stats.benjamini_hochberg(p).orderBy("i").collect()]
    assert q[:4] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and q[4] is None


def test_permanova_matches_its_statistic(spark, features):
    d = diversity.bray_curtis(features).unionByName(spark.createDataFrame([("s1", "s4", 0.9), ("s2", "s4", 0.2), ("s3", "s4", 0.8)], "i string, j string, d double"))
    groups = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("s3", "x"), ("s4", "y")], "sample string, grp string")
    a, b = stats.permanova_statistic(d, groups).first(), ordination.permanova(d, groups, 99).first()
    assert a["r2"] == pytest.approx(b["r2"]) and a["f"] == pytest.approx(b["f"]) and 0 < b["p"] <= 1


def test_ordination_and_trees(spark):
    d = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 6.0), ("b", "c", 6.0)], "i string, j string, d double")
    merges = rows(ordination.clusters(d).select("step", "left", "right", "height"), "step")
    assert merges == [(0, "a", "b", 2.0), (1, "c", "#3", 6.0)] or merges == [(0, "a", "b", 2.0), (1, "c", "#0", 6.0)]
    p = ordination.pcoa(d).collect()
    at = {r["sample"]: (r["axis1"], r["axis2"]) for r in p}
    assert math.dist(at["a"], at["b"]) == pytest.approx(2) and math.dist(at["a"], at["c"]) == pytest.approx(6)
    nj = {(r["parent"], r["node"]): r["length"] for r in ordination.neighbour_joining(d).collect()}
    assert sorted(nj.values()) == pytest.approx([1.0, 1.0, 5.0])


def hits(spark, rows_):
    return spark.createDataFrame(rows_, "query string, subject string, pident double, bitscore double, qcov double")


@pytest.fixture(scope="module")
def lineages(spark):
    lin = [("r1", "Chordata", "Actinopteri", "O", "F", "Gadus", "Gadus one"), ("r2", "Chordata", "Actinopteri", "O", "F", "Gadus", "Gadus two"), ("r3", "Chordata", "Actinopteri", "O2", "F", "Gadus", "Gadus one"), ("h", "Chordata", "Mammalia", "P", "H", "Homo", "Homo sapiens")]
    return spark.createDataFrame([(*x, "db", None) for x in lin], "subject string, phylum string, class string, order string, family string, genus string, species string, source string, species_all array<string>")


def test_naming_by_ties(spark, lineages):
    h = hits(spark, [("two", "r1", 99.0, 500.0, 100.0), ("two", "r2", 98.8, 499.0, 100.0), ("one", "r1", 99.0, 500.0, 100.0), ("renamed", "r1", 99.0, 500.0, 100.0), ("renamed", "r3", 99.0, 500.0, 100.0), ("low", "r1", 96.0, 400.0, 100.0), ("human", "h", 99.5, 510.0, 100.0), ("human", "r1", 98.6, 480.0, 100.0), ("unknown", "zzz", 99.0, 1.0, 1.0)])
    got = {r["query"]: r for r in naming.assign(h, lineages, limit="fish").collect()}
    assert (got["two"]["species"], got["two"]["genus"], got["two"]["n_ties"]) == (None, "Gadus", 2)
    assert got["one"]["species"] == "Gadus one" and got["one"]["target"] == "yes"
    assert got["renamed"]["species"] == "Gadus one" and got["renamed"]["order"] == "O"
    assert (got["low"]["species"], got["low"]["genus"]) == (None, "Gadus")
    assert got["human"]["species"] == "Homo sapiens" and got["human"]["target"] == "no"
    assert "unknown" not in got


def test_combining_with_a_second_database(spark, lineages):
    h = hits(spark, [(q, "r1", 99.0, 500.0, 100.0) for q in ("agree", "tie", "better", "differ", "nohit", "unchecked")] + [("offtarget", "h", 99.5, 500.0, 100.0)])
    local = naming.assign(h, lineages, limit="fish").withColumn("best_name", F.col("species"))
    local = local.unionByName(local.where("query = 'agree'").select(F.lit("only").alias("query"), *(F.lit(None).cast("string").alias(r) for r in naming.RANKS), "best_subject", F.lit(0.0).alias("pident"), "qcov", "n_ties", F.lit("").alias("target"), F.lit("none").alias("rank_reached"), F.lit("").alias("best_name")))
    second = spark.createDataFrame(
        [("agree", 1, "Gadus one", 99.0, "x"), ("tie", 1, "Gadus one", 99.0, "x"), ("tie", 2, "Gadus two", 98.9, "x"), ("better", 1, "Gadus two", 97.0, "x"), ("differ", 1, "Gadus two", 99.2, "x"), ("offtarget", 1, "Gadus one", 99.4, "x"), ("only", 1, "Gadus two", 99.0, "x")],
        "query string, rank int, species string, pident double, accession string",
    )
    checked = local.select("query").where("query <> 'unchecked'")
    genus = spark.createDataFrame([("Gadus", "Chordata", "Actinopteri", "O", "F")], "genus string, phylum string, class string, order string, family string")
    got = {r["query"]: r for r in naming.combine(local, second, genus, checked).collect()}
    assert {q: r["agreement"] for q, r in got.items()} == {"agree": "agree", "tie": "ncbi_tie", "better": "local_better", "differ": "differ", "nohit": "ncbi_no_hit", "unchecked": "not_checked", "offtarget": "outside_limit", "only": "ncbi_only"}
    assert got["tie"]["species"] is None and got["tie"]["genus"] == "Gadus" and got["tie"]["check"] == "yes"
    assert got["differ"]["species"] is None and got["differ"]["genus"] == "Gadus"
    assert got["only"]["species"] == "Gadus two" and got["only"]["family"] == "F"


def test_consensus_skips_unnamed_ranks_and_stops_at_disagreement(spark):
    lin = spark.createDataFrame([("a", "P", None, "X"), ("b", "P", None, "X"), ("c", "P", None, "Y")], "subject string, phylum string, class string, genus string")
    ranks = ["phylum", "class", "genus"]
    h = hits(spark, [("q1", "a", 99.0, 1.0, 1.0), ("q1", "b", 99.0, 1.0, 1.0), ("q2", "a", 99.0, 1.0, 1.0), ("q2", "c", 99.0, 1.0, 1.0)])
    got = {r["query"]: (r["phylum"], r["class"], r["genus"]) for r in naming.consensus(h, lin, ranks=ranks).collect()}
    assert got == {"q1": ("P", None, "X"), "q2": ("P", None, None)}


def test_gene_families_and_hosts(spark):
    paf = [(f"r{i}", 150, 0, 150, "t1", 1000, 100 * i, 100 * i + 150, 149, 150, 0.005) for i in range(8)] + [("bad", 150, 0, 150, "t1", 1000, 0, 150, 120, 150, 0.2)]
    p = spark.createDataFrame(paf, "qname string, qlen int, qs int, qe int, tname string, tlen int, ts int, te int, nmatch int, alen int, de double")
    cat = spark.createDataFrame([("t1", "blaTEM-1", "blaTEM", 1000, "AMR", "BETA-LACTAM"), ("t2", "blaTEM-2", "blaTEM", 1000, "AMR", "BETA-LACTAM")], "tname string, allele string, symbol string, length int, type string, class string")
    g = genomes.gene_families(p, cat, 1e6).first()
    assert (g["gene"], g["reads"], g["breadth"]) == ("blaTEM", 8, 85.0)
    half = spark.createDataFrame([("blaTEM", True, "Bacillus", "Bacillus subtilis")] * 4 + [("blaTEM", True, None, None)] * 4, "gene string, classified boolean, genus string, species string")
    h = genomes.gene_hosts(half).first()
    assert (h["host_taxon"], h["host_share"], h["host_status"]) == ("Bacillus subtilis", 50.0, "mixed")


def test_split_bins(spark):
    names = ["Salmonella"] * 3 + ["Escherichia"] * 3 + ["Shigella", None]
    c = spark.createDataFrame([("b", f"c{i}", 200_000, g) for i, g in enumerate(names)], "bin string, contig string, length long, genus string")
    got = {r["contig"]: r["part"] for r in genomes.split_bins(c).collect()}
    assert {k for k, v in got.items() if v == got["c6"]} >= {"c6", "c7"} and len(set(got.values())) == 2
    assert set(r["contig"] for r in genomes.split_bins(c, orphans="drop").collect()) == {f"c{i}" for i in range(6)}


def test_reads(spark):
    r = spark.createDataFrame([("f", "ACGT", "IIII"), ("f", "AC", "!!"), ("f", "ACGTAC", "IIIIII")], "file string, seq string, qual string")
    s = reads.read_statistics(r).first()
    assert (s["reads"], s["bases"], s["n50"], s["median_length"]) == (3, 12, 6, 4)
    q = rows(reads.position_quantiles(reads.position_quality(r)).where("pos = 0"), "pos")[0]
    assert q[3:] == (0, 40, 40)
    assert {tuple(x) for x in reads.dereplicate(spark.createDataFrame([("ACC",), ("GGT",), (None,)], "seq string")).collect()} == {("ACC", 2)}


def test_network_equals_dense_correlation(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    grid = rng.integers(0, 4, (12, 5))
    long = spark.createDataFrame([(int(i), f"t{j}", float(grid[i, j])) for i in range(12) for j in range(5) if grid[i, j]] + [(i, "base", 1.0) for i in range(12)], "sample int, taxon string, value double")

    def mid(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    got = {(r["a"], r["b"]): r["rho"] for r in network.correlations(long, 0.0).where("rho IS NOT NULL").collect()}
    for a in range(5):
        for b in range(a + 1, 5):
            if (f"t{a}", f"t{b}") in got:
                assert got[f"t{a}", f"t{b}"] == pytest.approx(np.corrcoef(mid(grid[:, a]), mid(grid[:, b]))[0, 1])


def test_distances_are_not_shuffled_to_meet_their_groups(spark):
    """Groups made by joins have no known size; they are written once, so that the distances, which are many more, stay where they are."""
    names = spark.range(6).selectExpr("id AS sample", "id % 2 AS k").join(spark.range(2).selectExpr("id AS k", "concat('g', id) AS grp"), "k")
    d = spark.range(6).selectExpr("id AS i").join(spark.range(6).selectExpr("id AS j"), F.col("i") < F.col("j")).withColumn("d", F.lit(0.5))
    out = diversity.within_between(d, names)
    assert {(r["kind"], r["n"]) for r in out.collect()} == {("within", 3), ("between", 9)}
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join [" in line]
    assert len(joins) == 2 and all("BroadcastHashJoin" in j for j in joins)
