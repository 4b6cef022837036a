"""What grows with the features is not held whole by a task: plans, and results against brute force."""

import re

import pytest

from quadrat.operators import abundance, genomes, rrna
from quadrat.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gene_families", "faith_pd", "detected_lineages", "krona_lines", "named_copies", "unifrac"])
def test_rows_of_features_are_not_broadcast(spark, name):
    assert not re.search(r"BroadcastHashJoin \[(feature_id|l_partkey|tname|rep)#", plan(catalogue.QUERIES[name](spark, SMALL)))


def test_gene_families_meet_their_spans_once(spark):
    """A window over a family sorts its different spans, not its alignments."""
    hits = [(f"r{k}", 150, 0, 150, "t1", 1000, 350 * (k % 3), 350 * (k % 3) + 300, 148, 150, 0.0) for k in range(30)]
    paf = spark.createDataFrame(hits, "qname string, qlen long, qs long, qe long, tname string, tlen long, ts long, te long, nmatch long, alen long, de double")
    alleles = spark.createDataFrame([("t1", "a1", "g", 1000, "AMR", "c"), ("t2", "a2", "g", 1000, "AMR", "c")], "tname string, allele string, symbol string, length long, type string, class string")
    out = genomes.gene_families(paf, alleles, 1e6)
    assert re.search(r"HashAggregate\(keys=\[symbol#\d+, length#\d+L, ts#\d+L, te#\d+L\], functions=\[\]", plan(out))
    row = out.first()
    assert (row["reads"], row["breadth"], row["depth"], row["allele"]) == (30, 90.0, 9.0, "a1")


def test_bins_are_split_by_one_join(spark):
    rows = [("x", 1, 60, "A"), ("x", 2, 30, "B"), ("x", 3, 5, "C"), ("x", 4, 5, None), ("y", 5, 90, "A"), ("y", 6, 10, "B"), ("z", 7, 50, "B"), ("z", 8, 50, "A")]
    contigs = spark.createDataFrame(rows, "bin string, contig long, length long, genus string")
    out = genomes.split_bins(contigs, least_length=20, least_share=0.2)
    assert plan(out).count("Join") == 1
    assert {(r["contig"], r["part"]) for r in out.collect()} == {(1, "A"), (2, "B"), (3, "A"), (4, "A"), (7, "B"), (8, "A")}
    dropped = genomes.split_bins(contigs, least_length=20, least_share=0.2, orphans="drop")
    assert {r["contig"] for r in dropped.collect()} == {1, 2, 7, 8}


def test_bins_are_dealt_by_their_rows(spark, monkeypatch):
    """As many tasks as the contigs ask for, whatever a partition packs to; the window and the join take them as dealt."""
    monkeypatch.setattr(genomes, "ROWS", 100)
    contigs = spark.range(4000).selectExpr("id div 4 AS bin", "id AS contig", "10 + id % 4 AS length", "concat('G', id % 2) AS genus")
    out = genomes.split_bins(contigs, least_length=20, least_share=0.2)
    assert set(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(out))) and all(x.endswith(", 40") for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(out)))
    assert out.count() == 4000 and out.rdd.getNumPartitions() == 40


def test_hits_of_a_copy_meet_once(spark):
    hits = [
        (1, 10, 99.0, "Aa x", "Aa"), (1, 11, 98.9, "Bb y", "Bb"), (1, 12, 98.8, "Bb z", "Bb"), (1, 13, 90.0, "Cc q", "Cc"), (1, 14, 98.85, "Bb y", "Bb"),
        (2, 20, 97.0, "[Dd] w", "Dd"), (2, 21, 97.0, "Ee v", "Ee"), (2, 22, 97.0, "Ff u", "Ff"), (3, 30, 95.0, None, "Gg"), (3, 31, None, "Hh t", "Hh"), (None, 40, 95.0, "Ii s", "Ii"),
    ]
    out = rrna.named_copies(spark.createDataFrame(hits, "copy long, target long, pident double, species string, genus string"))
    assert plan(out).count("Exchange hashpartitioning") == 1 and "Join" not in plan(out)
    got = {r["copy"]: (r["identity"], r["genus"], r["species"], r["tied"], r["n_tied"], r["off_genus"]) for r in out.collect()}
    assert got == {
        1: (99.0, "Bb", "Bb y", ["Bb y", "Bb z"], 2, ["Aa x"]), 2: (97.0, "Ff", "Ff u", ["Ff u"], 1, ["Ee v"]),
        3: (95.0, "Gg", None, [], 0, []), None: (95.0, None, None, [], 0, []),
    }


def test_copies_are_made_once_for_their_names(spark):
    """The frame is read three times, but not computed three times."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    copies = spark.createDataFrame([("s", 1, "A", ["A x", "A y"]), ("s", 2, "A", ["A x"]), ("t", 3, None, [])], "sample string, copy long, genus string, tied array<string>")
    out = rrna.agreed_names(copies.mapInPandas(count, copies.schema))
    assert {(r["sample"], r["species"], r["resolved"], r["max_tied"]) for r in out.collect()} == {("s", "A x", True, 2), ("t", "", False, 0)}
    assert seen.value == 3


def test_reads_meet_their_references_without_broadcasts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(abundance, "em_abundance", lambda rows, **k: seen.append(plan(rows)) or rows.limit(0).selectExpr("sample", "ref", "0.0 AS share", "0.0 AS reads"))
    catalogue.QUERIES["em_abundance"](spark, SMALL)
    assert "BroadcastHashJoin" not in seen[0]
