"""Operators on small inputs with known results, and readers of tool tables."""

import gzip
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.functions import kernels
from quadrat.operators import bins, controls, diversity, markers, network, ordination, reads, rrna, stats, summaries
from quadrat.sources import alignments, classifiers, fastx, references, tables


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


# Tails: values of published tables.
def test_tails_equal_tables():
    assert kernels.t_tail([2.228139, 12.7062, 0.0], [10, 1, 5]) == pytest.approx([0.05, 0.05, 1.0], abs=1e-6)
    assert kernels.f_tail([4.964603, 3.7389, 0.0], [1, 4, 2], [10, 12, 3]) == pytest.approx([0.05, 0.0338, 1.0], abs=2e-3)
    assert kernels.normal_tail([1.959964, 0.0, 2.575829]) == pytest.approx([0.05, 1.0, 0.01], abs=1e-6)
    assert kernels.lgamma(np.array([0.5, 1, 2, 5.5, 100])) == pytest.approx([math.lgamma(x) for x in (0.5, 1, 2, 5.5, 100)], rel=1e-13, abs=1e-13)
    x = np.array([0.1, 0.5, 0.9])
    assert kernels.beta_cdf(x, 2.0, 3.0) == pytest.approx(6 * x**2 - 8 * x**3 + 3 * x**4)


def plain_clusters(d, method):
    """Merges by the definition: all pairs of clusters, the nearest first."""
    clusters, heights = [[i] for i in range(len(d))], []
    while len(clusters) > 1:
        def apart(a, b):
            own = [d[i, j] for i in a for j in b]
            if method == "ward":
                whole = lambda c: sum(d[i, j] ** 2 for i in c for j in c) / (2 * len(c))
                return math.sqrt(max(2 * (whole(a + b) - whole(a) - whole(b)), 0))
            return {"average": sum(own) / len(own), "complete": max(own), "single": min(own)}[method]

        a, b = min(itertools.combinations(clusters, 2), key=lambda p: apart(*p))
        heights.append((round(apart(a, b), 9), tuple(sorted(a + b))))
        clusters = [c for c in clusters if c not in (a, b)] + [a + b]
    return sorted(heights)


@pytest.mark.parametrize("method", ["average", "complete", "single", "ward"])
def test_clusters_equal_the_definition(method):
    rng = np.random.default_rng(3)
    for n in (2, 3, 9, 14):
        x = rng.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
        members, got = {i: (i,) for i in range(n)}, []
        for k, (a, b, h, size) in enumerate(kernels.linkage(d, method)):
            members[n + k] = tuple(sorted(members[a] + members[b]))
            assert size == len(members[n + k])
            got.append((round(h, 9), members[n + k]))
        assert sorted(got) == plain_clusters(d, method)
        assert [h for h, _ in got] == sorted(h for h, _ in got)


def distances(spark, x):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    return d, spark.createDataFrame([(f"s{i:02d}", f"s{j:02d}", float(d[i, j])) for i in range(len(x)) for j in range(i + 1, len(x))], "i string, j string, d double")


def test_group_tests(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(8, 2)), rng.normal(size=(8, 2)) + 4, rng.normal(size=(8, 2)) * 6 + 4])
    d, long = distances(spark, x)
    labels = np.repeat([0, 1, 2], 8)
    groups = spark.createDataFrame([(f"s{i:02d}", f"g{g}") for i, g in enumerate(labels)] + [("alone", None)], "sample string, grp string")
    r = ordination.permanova(long, groups).first()
    total = (d**2).sum() / 2 / 24
    within = sum((d[np.ix_(labels == g, labels == g)] ** 2).sum() / 2 / 8 for g in range(3))
    assert r["r2"] == pytest.approx((total - within) / total) and r["f"] == pytest.approx((total - within) / 2 / (within / 21))
    shuffled = [kernels.permanova_ratio(d**2, rng.permutation(labels))[1] for _ in range(2000)]
    assert r["p"] == pytest.approx(np.mean([f >= r["f"] for f in shuffled]), abs=0.02)
    plain = stats.permanova_statistic(long, groups.where("grp IS NOT NULL")).first()
    assert (plain["r2"], plain["f"]) == pytest.approx((r["r2"], r["f"]))
    pairs = {(p["grp_a"], p["grp_b"]): p for p in ordination.pairwise_permanova(long, groups, 199).collect()}
    assert set(pairs) == {("g0", "g1"), ("g0", "g2"), ("g1", "g2")} and pairs["g0", "g1"]["p"] <= 0.01
    assert all(p["q"] >= p["p"] for p in pairs.values())
    both = np.isin(labels, [0, 1])
    assert pairs["g0", "g1"]["f"] == pytest.approx(kernels.permanova_ratio(d[np.ix_(both, both)] ** 2, labels[both])[1])
    a = ordination.anosim(long, groups, 199).first()
    assert a["r"] == pytest.approx(stats.anosim_statistic(long, groups.where("grp IS NOT NULL")).first()["r"]) and a["p"] <= 0.01
    spread = ordination.dispersion(long, groups, 199).first()
    centre = np.array([x[labels == g].mean(axis=0) for g in range(3)])[labels]
    own = np.sqrt(((x - centre) ** 2).sum(axis=1))
    assert spread["f"] == pytest.approx(kernels.anova_ratio(own, labels)) and spread["p"] <= 0.01
    few = spark.createDataFrame([(f"s{i:02d}", f"g{i}") for i in range(24)], "sample string, grp string")
    assert ordination.permanova(long, few).count() == 0
    assert controls.comparable(few).first()["comparable"] is False and controls.comparable(groups.where("grp IS NOT NULL")).first()["comparable"] is True


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    counts = [(f"s{i}", f"t{j}", float(c)) for i in range(6) for j in range(5) if (c := rng.integers(0, 30)) > 3]
    log = diversity.clr(spark.createDataFrame(counts, "sample string, taxon string, reads double"))
    scores, scree = ordination.centred_pca(log)
    x = np.log1p(pd.DataFrame(counts).pivot(index=0, columns=1, values=2).fillna(0).sort_index().to_numpy())
    x = x - x.mean(axis=1, keepdims=True)
    x = x - x.mean(axis=0)
    s = np.linalg.svd(x, compute_uv=False)
    assert [r["pct"] for r in scree.orderBy("component").collect()] == pytest.approx(100 * s**2 / (s**2).sum(), abs=1e-9)
    got = np.array([(r["axis1"], r["axis2"]) for r in scores.orderBy("sample").collect()])
    assert (got**2).sum(axis=0) == pytest.approx(s[:2] ** 2)


def test_principal_components_of_more_samples_than_a_dense_matrix_takes(spark, monkeypatch):
    monkeypatch.setattr(ordination, "MOST_SAMPLES", 5)
    rng = np.random.default_rng(3)
    counts = [(f"s{i:02d}", f"t{j}", float(c)) for i in range(40) for j in range(5) if (c := rng.integers(0, 30)) > 6 or j == i % 5]
    log = diversity.clr(spark.createDataFrame(counts, "sample string, taxon string, reads double"))
    scores, scree = ordination.centred_pca(log)
    x = np.log1p(pd.DataFrame(counts).pivot(index=0, columns=1, values=2).fillna(0).sort_index().to_numpy())
    want, share = kernels.clr_pca(x - x.mean(axis=1, keepdims=True))
    assert [r["pct"] for r in scree.orderBy("component").collect()] == pytest.approx(list(share), abs=1e-9)
    assert np.allclose([(r["axis1"], r["axis2"]) for r in scores.orderBy("sample").collect()], want, atol=1e-9)


def test_trees(spark):
    edges = [("#0", "a", 1.0), ("#0", "b", 2.0), ("#1", "#0", 3.0), ("#1", "c", 4.0), ("#1", "d", 0.5)]
    t = spark.createDataFrame([("m", *e) for e in edges], "matrix string, parent string, node string, length double")
    rooted = {(r["parent"], r["node"]): r["length"] for r in ordination.midpoint_rooted(t).collect()}
    # the longest path is b - #0 - #1 - c, of 9: its middle lies 0.5 from #1 towards #0
    assert rooted == {("#root", "#1"): 0.5, ("#root", "#0"): 2.5, ("#0", "a"): 1.0, ("#0", "b"): 2.0, ("#1", "c"): 4.0, ("#1", "d"): 0.5}
    tips = {r["label"]: (r["x0"], r["y0"]) for r in ordination.tree_layout(t).where("kind = 'tip'").collect()}
    assert tips == {"a": (4.0, 1.0), "b": (5.0, 2.0), "c": (4.0, 3.0), "d": (0.5, 4.0)}
    assert ordination.tree_layout(t).where("kind = 'edge'").count() == 10
    back = ordination.parse_newick(ordination.newick(t))
    lengths = lambda df: sorted((r["node"] if not r["node"].startswith("#") else "", r["length"]) for r in df.collect())
    assert lengths(back) == lengths(t)
    odd = spark.createDataFrame([("m", "('it''s a':1,(b:2e-1,c)x:3)root;")], "matrix string, tree string")
    assert rows(ordination.parse_newick(odd), "parent", "node", "length") == [("root", "it's a", 1.0), ("root", "x", 3.0), ("x", "b", 0.2), ("x", "c", 0.0)]
    merges = spark.createDataFrame([("m", 0, "a", "b", 1.0, 2), ("m", 1, "c", "#0", 2.0, 3)], "matrix string, step int, left string, right string, height double, size int")
    d = ordination.dendrogram(merges)
    assert {r["label"]: r["x0"] for r in d.where("kind = 'leaf'").collect()} == {"c": 0.0, "a": 1.0, "b": 2.0}
    assert (0.0, 2.0, 1.5, 2.0) in rows(d.where("kind = 'edge'"), "x0", "y0", "x1", "y1")


def test_exclusive_taxa_are_linked(spark):
    counts = [(f"s{i}", "a" if i < 10 else "b", float(1 + i % 10)) for i in range(20)] + [(f"s{i}", "c", 5.0 + i) for i in range(20)] + [("s0", "rare", 1.0)]
    got = {(r["a"], r["b"]): r for r in network.correlations(spark.createDataFrame(counts, "sample string, taxon string, value double"), 0.0).collect()}
    wide = pd.DataFrame(counts).pivot(index=0, columns=1, values=2).fillna(0).rank().corr()
    assert set(got) == {("a", "b"), ("a", "c"), ("a", "rare"), ("b", "c"), ("b", "rare"), ("c", "rare")}
    for (x, y), r in got.items():
        assert r["rho"] == pytest.approx(wide.loc[x, y])
    assert got["a", "b"]["both"] == 0 and got["a", "b"]["rho"] < -0.8 and got["a", "b"]["p"] < 1e-4
    strong = network.correlations(spark.createDataFrame(counts, "sample string, taxon string, value double"), 0.6, 0.05).collect()
    assert {(r["a"], r["b"]) for r in strong} == {k for k, r in got.items() if abs(r["rho"]) >= 0.6 and r["p"] <= 0.05}


def test_z_scores_of_absent_samples(spark):
    shares = spark.createDataFrame([("s1", "a", 30.0), ("s2", "a", 10.0), ("s3", "b", 5.0), ("s1", "k", 2.0), ("s2", "k", 2.0), ("s3", "k", 2.0)], "sample string, taxon string, pct double")
    got = {(r["sample"], r["taxon"]): r["z"] for r in diversity.z_scores(shares).collect()}
    v = np.array([30.0, 10.0, 0.0])
    assert len(got) == 9 and [got[s, "a"] for s in ("s1", "s2", "s3")] == pytest.approx((v - v.mean()) / v.std(ddof=1)) and got["s1", "k"] == 0


def test_kmers_of_any_length(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGTNacgt") for _ in range(rng.randrange(80))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame([(x,) for x in seqs], "seq string")
    for k in (1, 3, 13, 31):
        want = {}
        for x in seqs:
            for i in range(len(x or "") - k + 1):
                w = x[i : i + k].upper()
                if set(w) <= set("ACGT"):
                    want[w] = want.get(w, 0) + 1
        assert {r["kmer"]: r["n"] for r in reads.kmer_table(df, k).collect()} == want


def test_mock_families_rescue_genera(spark):
    shares = spark.createDataFrame([("m", "A", 60.0), ("m", "A2", 5.0), ("m", "X", 20.0), ("m", "Unclassified", 15.0)], "sample string, taxon string, pct double")
    expected = spark.createDataFrame([("A", 1.0, "fa", ["A2"]), ("B", 1.0, "fb", None), ("C", 2.0, "fc", [])], "taxon string, weight double, family string, names array<string>")
    families = spark.createDataFrame([("m", "fb", 20.0), ("m", "fc", 3.0)], "sample string, family string, pct double")
    got = {r["taxon"]: r for r in controls.mock_genera(shares, expected, families).collect()}
    assert got["A"]["observed"] == 65.0 and not got["A"]["missing"] and got["B"]["family_only"] and not got["B"]["missing"] and got["C"]["missing"]
    v = controls.mock_verdicts(shares, expected, families).first()
    assert (v["bray_curtis"], v["other_pct"], v["missing"]) == (pytest.approx((40 + 25 + 50 + 20) / 200), 20.0, "C")


def test_group_columns(spark):
    m = spark.createDataFrame([("s1", "x", "1", "a"), ("s2", "x", "2", " "), ("s3", "", "3", "b")], "sample string, Description string, batch string, kind string")
    assert controls.chosen_group_column(m) == "batch" and controls.chosen_group_column(m, chosen="kind") == "kind" and controls.chosen_group_column(m, "batch", "kind") == "batch"
    assert controls.chosen_group_column(m.withColumn("Group", F.lit("g"))) == "Group" and controls.chosen_group_column(m.select("sample", "Description")) is None


def test_suffixes_and_sites(spark):
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    assert markers.common_suffix(names("KK-NE-1-COI", "KK-SW-CT-COI")).first()["suffix"] == "-COI"
    assert markers.common_suffix(names("a1", "b1")).first()["suffix"] == "" and markers.common_suffix(names("one")).first()["suffix"] == ""
    assert markers.common_suffix(names("x-12S", "-12S")).first()["suffix"] == ""
    got = {r["key"]: (r["site"], r["replicate"], r["is_control"]) for r in markers.sample_keys(names("KK-NE-1_co", "KK-NE-CT_co", "KK-NE_co", "KK-NE-rep02_co")).collect()}
    assert got == {"KK-NE-1": ("KK-NE", "1", False), "KK-NE-CT": ("KK-NE", "CT", True), "KK-NE": ("KK-NE", "", False), "KK-NE-rep02": ("KK-NE", "02", False)}


def test_functions_meet_by_parts_of_names(spark):
    taxa = spark.createDataFrame([("Paenibacillus",), ("Bac",), ("Nitrosomonas",), ("Other",)], "taxon string")
    functions = spark.createDataFrame([("spores", "bacillus"), ("nitrification", "Nitrosomonas"), ("x", "none")], "function string, genus string")
    assert rows(markers.function_matches(taxa, functions)) == [("Bac", "spores"), ("Nitrosomonas", "nitrification"), ("Paenibacillus", "spores")]


def test_strains_and_headers(spark):
    h = "NR_119358.1 Acinetobacter baumannii strain ATCC 19606 16S ribosomal RNA, partial sequence"
    sub = "NR_1.1 Bacillus subtilis subsp. spizizenii strain NRRL B-23049 16S ribosomal RNA"
    df = spark.createDataFrame([(h, "KCTC3922(T)"), (sub, "BCT-7112T"), ("X", "type strain: DSM 1T"), (None, None)], "h string, s string")
    got = [(r["x"]["accession"], r["x"]["species"], r["x"]["strain"], r["st"]) for r in df.select(rrna.rrna_header("h").alias("x"), rrna.clean_strain("s").alias("st")).collect()]
    assert got[:2] == [("NR_119358.1", "Acinetobacter baumannii", "ATCC 19606", "KCTC3922"), ("NR_1.1", "Bacillus subtilis subsp. spizizenii", "NRRL B-23049", "BCT-7112")]
    assert got[2][3] == "DSM 1"
    label = df.select(rrna.strain_label("h", "s", "h").alias("l")).collect()
    assert label[0]["l"].endswith(h) and " KCTC3922T " in label[0]["l"]
    keys = spark.createDataFrame([("Cronobacter sakazakii NBRC 102416",), ("Bacillus subtilis subsp. spizizenii W23",), ("Alone",), (None,)], "n string").select(rrna.species_key("n").alias("k")).collect()
    assert [r["k"] for r in keys] == ["Cronobacter sakazakii", "Bacillus subtilis subsp. spizizenii", "Alone", ""]


def test_copies_with_a_mislabelled_record(spark):
    hits = [("c1", "t9", 100.0, "Klebsiella pneumoniae", None), ("c1", "t1", 99.9, "Acinetobacter baumannii", None), ("c1", "t2", 99.9, "Acinetobacter pittii", None), ("c1", "t3", 99.0, "Acinetobacter far", None), ("c1", "t4", 99.95, "[Bacillus] odd", None), ("c2", "t1", 99.0, None, "Acinetobacter")]
    got = {r["copy"]: r for r in rrna.named_copies(spark.createDataFrame(hits, "copy string, target string, pident double, species string, genus string")).collect()}
    assert got["c1"]["genus"] == "Acinetobacter" and got["c1"]["tied"] == ["Acinetobacter baumannii", "Acinetobacter pittii"] and got["c1"]["off_genus"] == ["Klebsiella pneumoniae"]
    assert got["c2"]["genus"] == "Acinetobacter" and got["c2"]["n_tied"] == 0


def test_amplicons_on_either_strand(spark):
    inner = "TTTTTCCCCC"
    plus = "GG" + "ACGTG" + inner + "GGTAA" + "CC"
    minus = plus[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(plus,), (minus,), ("ACGTGGGTAA",), ("nothing",), (None,)], "seq string")
    assert [r["a"] for r in df.select(rrna.amplicon("seq", "AC.TG", "GG.AA", 5, 50).alias("a")).collect()] == [inner, inner, None, None, None]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") if path.suffix == ".gz" else open(path, "w") as out:
        out.write(text)
    return str(path)


def test_fasta_with_marks_in_headers(spark, tmp_path):
    path = write(tmp_path / "a.fasta", ">p1 a note -> b\nACGT\nac\n>c\nGG\n\n>d >e\n")
    assert rows(fastx.read_fasta(spark, path)) == [("c", "c", "GG"), ("d", "d >e", ""), ("p1", "p1 a note -> b", "ACGTAC")]


def test_classifier_tables(spark, tmp_path):
    b = write(tmp_path / "s1.bracken", "name\ttaxonomy_id\ttaxonomy_lvl\tnew_est_reads\nBacillus_a  b\t1\tS\t30\nBacillus a b\t1\tS\t10\nGenus\t2\tG\t99\nc d\t3\tS\t60\nbad\t4\tS\tx\n")
    assert rows(classifiers.read_bracken(spark, b), "sample", "taxid", "species", "value", "share") == [("s1", 1, "Bacillus a b", 40.0, 40.0), ("s1", 3, "c d", 60.0, 60.0)]
    c = write(tmp_path / "s2.tsv", "name\ttaxRank\tnumReads\na b\tSpecies\t5\nc\tgenus\t7\n")
    assert rows(classifiers.read_centrifuge(spark, c), "species", "share") == [("a b", 100.0)]
    g = write(tmp_path / "s3.tsv", "LEVEL\tNAME\tREL_ABUNDANCE\nspecies\ta_b\t0.25\nspecies\tc d\t0.75\ngenus\ta\t1\n")
    assert rows(classifiers.read_gottcha2(spark, g), "species", "share") == [("a b", 25.0), ("c d", 75.0)]
    tree = spark.createDataFrame([("s", "R", "root", 90), ("s", "U", "u", 10), ("t", "U", "u", 5), ("s", "S", "a  b", 30)], "sample string, rank string, name string, clade_reads long")
    assert rows(classifiers.classified_share(tree)) == [("s", 90.0), ("t", None)] and rows(classifiers.species_shares(tree), "species", "share") == [("a b", 100.0)]
    m = write(tmp_path / "p.tsv", "#c\nk__B|g__Bacillus\t1\t40.5\tx\nk__B|g__Bacillus\t2\t1.5\t\nk__B|g__Bacillus|s__x\t1\t9\t\n")
    assert rows(classifiers.read_clade_profile(spark, m)) == [("p", "Bacillus", 42.0)]
    n = write(tmp_path / "names.tsv.gz", "U1\tATP synthase\nU2\tother\nU3\t\n")
    assert rows(classifiers.read_names(spark, n, "atp")) == [("U1", "ATP synthase")] and classifiers.read_names(spark, n).count() == 2
    logs = tmp_path / "logs"
    write(logs / "a.log", "Unaligned reads after nucleotide alignment: 60 %\nUnaligned reads after nucleotide alignment: 40.5 %\nUnaligned reads after translated alignment: 10.25 %\n")
    write(logs / "b.log", "Unaligned reads after nucleotide alignment: 70 %")
    write(logs / "c.log", "nothing")
    assert rows(classifiers.read_mapped_shares(spark, str(logs))) == [("a", 59.5, 30.25, 10.25), ("b", 30.0, 0.0, 70.0)]
    pw = write(tmp_path / "path.tsv.gz", "pathway\tdescription\ts1\ts2\nP1\tone\t3\t0\nP2\ttwo\t1\t4\n")
    assert rows(classifiers.read_pathways(spark, pw)) == [("s1", "P1", "one", 3.0, 75.0), ("s1", "P2", "two", 1.0, 25.0), ("s2", "P2", "two", 4.0, 100.0)]
    ns = write(tmp_path / "nsti.tsv", "sample\tweighted_NSTI\ns1\t0.05\n")
    assert rows(classifiers.read_nsti(spark, ns)) == [("s1", 0.05)]
    amr = write(tmp_path / "x.amr.tsv", "Contig id\tGene symbol\tElement type\tClass\nc1\tblaTEM\tAMR\t\nc2\t\tSTRESS\tMERCURY\n")
    assert rows(classifiers.read_tool_table(spark, amr, ["contig", "gene", "type", "class", "depth"])) == [("x", "c1", "blaTEM", "AMR", None, None), ("x", "c2", None, "STRESS", "MERCURY", None)]
    taxa = spark.createDataFrame([("g__Faecalibacterium.s__F_prausnitzii",), ("unclassified",), ("",), (None,), ("plain",), ("g__A_b|x",)], "t string")
    assert [r["g"] for r in taxa.select(classifiers.genus_of("t").alias("g")).collect()] == ["Faecalibacterium", "Unclassified", "", "", "plain", "A b"]


def test_lineages_of_wanted_accessions(spark, tmp_path):
    f = write(tmp_path / "gtdb.csv", "ident,superkingdom,phylum,genus,species\nRS_GCF_1.1,d__Bacteria,p__X,g__Y,s__Y z\nGB_GCA_2.1,d__B,p__,g__,s__\n")
    want = spark.createDataFrame([("GCF_1.2",), ("GCF_9.1",)], "accession string")
    assert rows(references.read_lineages(spark, f, want)) == [("GCF_1.2", "Bacteria", "X", "Y", "Y z")]


def test_reference_shapes(spark):
    heads = lambda make, n=30: spark.createDataFrame([(make(i),) for i in range(n)], "header string")
    r = references.inspected(heads(lambda i: f">Arthropoda_{i};Insecta_2;Diptera_3;Muscidae_4;Musca_5;Musca domestica_{i};")).first()
    assert (r["depth"], r["numbered"], r["kind"]) == (6, True, "trainset") and references.rank_levels(6, r["has_species"], r["has_kingdom"], True)[0] == "Phylum"
    r = references.inspected(heads(lambda i: f">ACC{i} Bacillus subtilis")).first()
    assert r["kind"] == "species_assignment"
    r = references.inspected(heads(lambda i: f">Bacteria;Bacillati;P;C;O;F;G{i};G{i} x;")).first()
    assert (r["depth"], r["has_species"], r["has_kingdom"]) == (8, True, True) and references.rank_levels(8, True, True, False) == references.LEVELS
    assert references.rank_levels(7, None, True, False)[0] == "Domain" and references.rank_levels(7, True, False, False)[-1] == "Species" and references.rank_levels(9, None, None, False)[1] == "Supergroup"
    assert references.inspected(heads(lambda i: "x", 0)).count() == 0
    t = spark.createDataFrame([("a", None, "x"), ("b", "s", "y")], "id string, species string, Species2 string")
    assert rows(references.merged_species_columns(t, ["species", "Species2"])) == [("a", "x"), ("b", "y")]


def test_groups_of_files(spark):
    files = [("FAX12345_pass_barcode09_x_1.fastq.gz", "runA"), ("FAX12345_pass_barcode09_x_2.fastq.gz", "runA"), ("FAX12345_pass_barcode10_x_0.fastq.gz", "runA"), ("FAX54321_pass_barcode09_y_0.fastq.gz", "runB/pass"), ("x_fail_1.fastq", "runA"),
             ("a.fastq.gz", "lab/Sample_OP-SCN5"), ("mine_2.fq", None), ("notes.txt", "runA")]
    got = {r["sample"]: (r["folder"], r["unit"], r["files"]) for r in references.grouped_files(spark.createDataFrame(files, "name string, folder string")).collect()}
    assert got["barcode09"] == ("runA", "barcode09", ["FAX12345_pass_barcode09_x_1.fastq.gz", "FAX12345_pass_barcode09_x_2.fastq.gz"])
    assert got["barcode09_runB"][0] == "runB/pass" and got["OP-SCN5"][2] == ["a.fastq.gz"] and got["mine_2"][2] == ["mine_2.fq"] and "barcode10" in got and len(got) == 5


def test_whole_genome_alignments(spark, tmp_path):
    p = write(tmp_path / "g1.delta", "/a /b\nNUCMER\n>r1 q1 1000 1000\n1 100 200 101 5 5 0\n0\n51 150 1 100 0 0 0\n-3\n0\n>r2 q1 50 1000\n1 10 1 10 1 1 0\n0\n")
    r = alignments.alignment_identity(alignments.read_delta(spark, p)).first()
    assert (r["pair"], r["ref_aligned"], r["query_aligned"]) == ("g1", 160, 200) and r["ani"] == pytest.approx(100 * (190 + 200 + 18) / 420)
    f = write(tmp_path / "g2.tsv", "f1\ts\t99\t1000\t10\t1020\t0\nf1\ts\t80\t1000\t10\t1020\t0\nf2\ts\t90\t100\t0\t1020\t0\nf3\ts\t97\t900\t5\t1020\t20\nbad\tline\n")
    r = alignments.fragment_identity(alignments.read_fragments(spark, f)).first()
    assert (r["ani"], r["aligned"], r["fragments"]) == (98.0, 1880, 2)
    one = spark.createDataFrame([(":6*ag:3+tt-c*tc",), ("",)], "cs string").select(alignments.differences("cs").alias("x")).collect()
    assert [tuple(r["x"]) for r in one] == [(2, 2, 3), (0, 0, 0)]
    prof = spark.createDataFrame([("a", k, float(i)) for i, k in enumerate("wxyz")] + [("b", k, 2.0 * i + 1) for i, k in enumerate("wxyz")], "name string, kmer string, z double")
    assert alignments.profile_correlation(prof, "a", "b").first()["r"] == pytest.approx(1.0)


def test_precedence_of_identifications(spark):
    columns = "genome string, sketch_species string, sketch_genus string, sketch_ani double, checked_ani double, rrna_species string, rrna_genus string, strain_level string, strain_species string, strain_ani double"
    g = [("a", "B x", "B", 96.0, None, "B y", "B", None, None, None), ("b", "B x", "B", 96.0, 93.0, None, None, None, None, None), ("c", None, None, None, None, "B sp.", "B", None, None, None), ("d", "B x", "B", 96.0, None, None, None, "known", "C z", 97.123), ("e", None, None, None, None, None, None, None, None, None), ("f", "B x", "B", 96.0, None, None, None, "novel", "B sp.", 91.0)]
    got = {r["genome"]: (r["method"], r["species"], r["genus"], r["ani"], r["call"]) for r in bins.identified(spark.createDataFrame(g, columns)).collect()}
    assert got == {"a": ("sketch", "B x", "B", 96.0, "species"), "b": ("ANI", "B x", "B", 93.0, "genus"), "c": ("16S", "B sp.", "B", None, "16S only"), "d": ("type strain", "C z", "C", 97.12, "species"), "e": (None, None, None, None, "unresolved"), "f": ("type strain", "B sp.", "B", 91.0, "potential novel species")}


def test_modules_are_those_of_greedy_modularity(spark):
    names = [f"{g}{i}" for g in "ab" for i in range(4)]
    edges = [(x, y, 0.9) for x, y in itertools.combinations(names, 2) if x[0] == y[0]] + [("a0", "b0", 0.7)]
    got = {r["taxon"]: r["module"] for r in network.modules(spark.createDataFrame(edges, "a string, b string, rho double")).collect()}
    assert got == {n: 1 if n[0] == "a" else 2 for n in names}
    lone = network.modules(spark.createDataFrame([("x", "y", 0.9), ("p", "q", 0.8)], "a string, b string, rho double"))
    assert rows(lone) == [("p", 1), ("q", 1), ("x", 2), ("y", 2)]
    roles = {r["taxon"]: r for r in network.roles(spark.createDataFrame(edges, "a string, b string, rho double"), network.modules(spark.createDataFrame(edges, "a string, b string, rho double"))).collect()}
    assert roles["a0"]["zi"] == pytest.approx(1.5) and roles["a0"]["pi"] == pytest.approx(1 - (9 + 1) / 16) and roles["a1"]["pi"] == 0


def test_peaks_keep_their_distance(spark):
    h = [0.0] * 101
    for at, n in ((40, 600), (43, 300), (60, 200), (90, 10)):
        for k in range(-2, 3):
            h[at + k] += n * (3 - abs(k)) / 9
    bins = spark.createDataFrame([("s", i, c) for i, c in enumerate(h)], "sample string, at int, count double")
    got = [r["at"] for r in summaries.separated_peaks(bins, ["sample"]).collect()]
    assert len(got) == 2 and 40 <= got[0] <= 42 and got[1] == 60


def test_tables_of_unknown_layout(spark, tmp_path):
    for i, sep in enumerate(",;\t|"):
        p = write(tmp_path / f"{i}.txt", f"﻿sample{sep}group{sep}note\ns1{sep}a{sep}\ns2{sep}b\n")
        t = tables.read_csv(spark, p, sep=None)
        assert t.columns == ["sample", "group", "note"] and rows(t, "sample", "group") == [("s1", "a"), ("s2", "b")]
    p = write(tmp_path / "info.txt", "## made today\n#seq_name\tlength\tcirc.\nc1\t100\tY\nc2\t50\n\n")
    t = tables.read_tool_lines(spark, p)
    assert t.columns == ["seq_name", "length", "circ."] and rows(t) == [("c1", "100", "Y"), ("c2", "50", None)]
    f = write(tmp_path / "f.tsv", "# Gene Family\ts1_Abundance-RPKs\nUNMAPPED\t9\nK1: x\t1\nK1: x|g__A.s__B\t2\nK2: y\t3\n")
    assert rows(tables.read_stratified(spark, f, keep="^K1")) == [("s1", "K1: x", "g__A.s__B", 2.0), ("s1", "K1: x", None, 1.0)]
    g = write(tmp_path / "panels.tsv", "panel\tgroup\tgene\tko\tuniref_pattern\tnote\np\tg\ta\tK1, K2\t\t\np\tg\tb\t\t(broken\t\np\tg\tc\t\tnif[HD]\t\nq\tg\td\tK3\t\t\n")
    assert rows(tables.read_gene_panels(spark, g, ["p"]), "gene", "pattern") == [("a", None), ("c", "nif[HD]")]
    assert tables.read_gene_panels(spark, g).count() == 3


def test_cleaned_taxonomy(spark):
    raw = [("1", "k__Animalia_1", "order_x", "Musca_7", "Musca_7"), ("2", "Fungi_2", "Rosales_incertae_sedis", "g__Rosa_3", "Rosa canina_9"), ("3", "NA", "Unidentified", None, "")]
    t = tables.cleaned_taxonomy(spark.createDataFrame(raw, "feature_id string, kingdom string, order string, genus string, species string"), numbered=True)
    assert rows(t, "feature_id", "kingdom", "order", "genus", "species") == [("1", "Animalia", None, "Musca", None), ("2", "Fungi", None, "Rosa", "Rosa canina"), ("3", None, None, None, None)]


def test_read_pairs_and_nested_results(spark):
    names = ["a_R1_001.fastq.gz", "a_R2_001.fastq.gz", "b_1.fq", "b_2.fq", "c_R1.fastq", "d.fastq", "notes.txt"]
    got = {r["sample"]: r["files"] for r in summaries.read_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {"a": names[:2], "b": names[2:4], "c_R1": ["c_R1.fastq"], "d": ["d.fastq"]}
    df = spark.createDataFrame([("s", [(1, "x"), (2, "y")], [])], "sample string, hits array<struct<n:int,v:string>>, none array<struct<n:int>>")
    out = dict(summaries.nested_tables(df, "sample", ["hits", "none"]))
    assert rows(out["hits"]) == [("s", 1, "x"), ("s", 2, "y")] and out["none"].count() == 0 and out["none"].columns == ["sample", "n"]
    features = spark.createDataFrame([("s", "ACGT", 5.0), ("t", "GG", 9.0), ("s", "TT", 0.0)], "sample string, feature_id string, reads double")
    own, lines = summaries.numbered_sequences(features)
    assert rows(own) == [("s", "ASV2", 5.0), ("t", "ASV1", 9.0)] and rows(lines) == [(">ASV1\nGG",), (">ASV2\nACGT",)]


def test_headers_of_all_shapes(spark):
    heads = {
        "Bacteria;Firmicutes;Bacilli;O;F;Bacillus": ("Bacteria", "Firmicutes", "Bacilli", "O", "F", "Bacillus", None),
        "Bacteria;Bacillati;Bacillota;Bacilli;O;F;Bacillus;Bacillus subtilis;": ("Bacteria", "Bacillota", "Bacilli", "O", "F", "Bacillus", "Bacillus subtilis"),
        "Eukaryota;TSAR;Alveolata;Dino;Dinophyceae;O;F;Genus;Genus_sp1": ("Eukaryota", "Alveolata", "Dinophyceae", "O", "F", "Genus", "Genus sp1"),
        "Arthropoda_6656;Insecta_50557;order_X_1;Muscidae_7366;Musca_7369;Musca domestica_7370;": (None, "Arthropoda", "Insecta", None, "Muscidae", "Musca", "Musca domestica"),
        "Metazoa_33208;Chordata_7711;Actinopteri_186623;O_1;F_2;Danio_3;Danio rerio_4": ("Metazoa", "Chordata", "Actinopteri", "O", "F", "Danio", "Danio rerio"),
        "Name|AB1|SH1|reps|k__Fungi;p__Ascomycota;c__Eurotiomycetes;o__X_incertae_sedis;f__unidentified;g__Aspergillus;s__Aspergillus_niger": ("Fungi", "Ascomycota", "Eurotiomycetes", None, None, "Aspergillus", "Aspergillus niger"),
        "Fungi_sp|X1|SH9|reps|k__Fungi;p__Ascomycota;c__unidentified;o__unidentified;f__unidentified;g__unidentified;s__Fungi_sp": ("Fungi", "Ascomycota", None, None, None, None, None),
        "": (None,) * 7,
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string")
    got = df.orderBy("i").select(*(c.alias(r) for r, c in tables.lineage_columns("h").items())).collect()
    assert [tuple(r) for r in got] == list(heads.values())
    m = spark.createDataFrame([("s1", "1", "x"), ("s2", "2", "x"), ("s3", "3", "y")], "sample string, run string, kind string")
    assert controls.first_grouping(m) == "kind" and controls.first_grouping(m.select("sample", "run")) == "run"
