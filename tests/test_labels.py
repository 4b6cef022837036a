"""Names, keys and sequences as column expressions: exact values."""

from pyspark.sql import functions as F

from quadrat.functions import kernels, labels, sequences


def values(spark, expressions, rows, schema):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*expressions).collect()]


def test_blanks_and_labels(spark):
    rows = [("g__Bacillus",), (" NA ",), ("g__",), ("uncultured",), (None,), ("Bacillus--other",), ("Eperythrozoon",)]
    got = values(spark, [labels.clean_label("x"), labels.missing_to_null("x"), labels.blank_to_null("x"), labels.clean_genus("x")], rows, "x string")
    assert [r[0] for r in got] == ["Bacillus", "Unclassified", "Unclassified", "Unclassified", "Unclassified", "Bacillus--other", "Eperythrozoon"]
    assert [r[1] for r in got] == ["g__Bacillus", None, "g__", "uncultured", None, "Bacillus--other", "Eperythrozoon"]
    assert [r[2] for r in got] == ["g__Bacillus", None, "g__", None, None, "Bacillus--other", "Eperythrozoon"]
    assert [r[3] for r in got][5:] == ["Bacillus", "Haemoplasma group"]


def test_rank_label_uses_deepest_higher_rank(spark):
    rows = [("Bacillota", "Bacillus", "B. subtilis"), ("Bacillota", "Bacillus", ""), ("Bacillota", None, "NA"), (None, None, None)]
    got = values(spark, [labels.rank_label(["phylum", "genus", "species"], "species"), labels.deepest_rank(["phylum", "genus", "species"])], rows, "phylum string, genus string, species string")
    assert got == [("B. subtilis", "species"), ("Bacillus unidentified", "genus"), ("Bacillota unidentified", "phylum"), ("Unassigned", "none")]


def test_species_label(spark):
    rows = [("Bacillus", "subtilis"), ("Bacillus", "Bacillus subtilis"), ("Bacillus", "Bacillus sp."), (None, "subtilis"), ("Bacillus", None)]
    assert [r[0] for r in values(spark, [labels.species_label("g", "s")], rows, "g string, s string")] == ["Bacillus subtilis", "Bacillus subtilis", "Unclassified", "subtilis", "Unclassified"]


def test_keys_and_numbers(spark):
    rows = [("Sample-01 (A)", "1,234.5", "4.6 Mb"), ("s10", "x", "800k"), ("s9", None, "?")]
    got = values(spark, [labels.folded_key("a"), labels.number_or_null("b"), labels.base_pairs("c"), labels.natural_key("a")], rows, "a string, b string, c string")
    assert [r[:3] for r in got] == [("sample01a", 1234.5, 4.6e6), ("s10", None, 8e5), ("s9", None, None)]
    assert got[2][3] < got[1][3]


def test_valid_binomial(spark):
    rows = [("Homo sapiens",), ("Homo sp.",), ("uncultured fish",), ("Homo cf. sapiens",), ("Homo",)]
    assert [bool(r[0]) for r in values(spark, [labels.valid_binomial("x")], rows, "x string")] == [True, False, False, False, False]


def test_sequences(spark):
    rows = [("ACGTN",), ("GGCC",), ("",), ("acgtry",)]
    got = values(spark, [sequences.reverse_complement("s"), sequences.gc_percent("s"), sequences.gc_skew("s"), sequences.canonical_strand("s")], rows, "s string")
    assert got == [("NACGT", 50.0, 0.0, "ACGTN"), ("GGCC", 100.0, 0.0, "GGCC"), ("", None, None, ""), ("RYACGT", 50.0, 0.0, "ACGTRY")]


def test_quality_primers_and_frames(spark):
    rows = [("II", "TTACGTGGG"), ("", "GG"), ("!I", "ACNTRGACNTRG")]
    q = sequences.quality_scores("q")
    got = values(spark, [q, sequences.mean_quality(q), sequences.best_primer_match("s", "ACNTRG"), sequences.kmers("s", 8), sequences.fragments("s", 4)], rows, "q string, s string")
    assert got[0][0] == [40, 40] and abs(got[0][1] - 40) < 1e-9
    assert got[1][0] == [] and got[1][1] is None
    assert abs(got[2][1] - 3.0098) < 1e-3
    assert tuple(got[0][2]) == (0, 2)
    assert got[0][3] == ["TTACGTGG", "TACGTGGG"] and got[1][3] == []
    assert got[0][4] == ["TTAC", "GTGG", "G"]
    frames = values(spark, [sequences.open_frames("s", ["TAA", "TAG", "TGA"], 6)], [("ATGGCCGCC",), ("ATGTAAGCC",), ("ATG",)], "s string")
    assert [r[0] for r in frames] == [3, 2, 0]


def test_tails():
    assert abs(kernels.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(kernels.chi2_tail(9.487729036781154, 4) - 0.05) < 1e-9
    assert abs(kernels.t_tail(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(kernels.f_tail(4.102821015, 2, 10) - 0.05) < 1e-7
    assert abs(kernels.normal_tail(1.959963984540054) - 0.05) < 1e-12
    assert kernels.chi2_tail(0, 3) == 1.0 and kernels.f_tail(0, 2, 3) == 1.0


def test_hurlbert_is_the_mean_over_all_subsamples():
    from itertools import combinations

    import numpy as np

    reads = [0] * 5 + [1] * 3 + [2]
    for n in (1, 3, 6):
        subsets = list(combinations(range(9), n))
        want = sum(len({reads[i] for i in c}) for c in subsets) / len(subsets)
        assert abs(kernels.hurlbert(np.array([5, 3, 1]), n) - want) < 1e-9
