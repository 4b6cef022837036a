"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from quadrat.sources import fastx, reports, sinks, tables
from tests.test_operators import MATRIX


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


LAYOUTS = {
    "dada2": ("s1,s2,s3,sequence", [f"{a},{b},{c},{f}" for f, (a, b, c) in MATRIX.items()]),
    "id_first": ("tax_id,s1,s2,s3", [f"{f},{a},{b},{c}" for f, (a, b, c) in MATRIX.items()]),
    "samples_as_rows": ("sample_id," + ",".join(MATRIX), [f"s{i + 1}," + ",".join(str(v[i]) for v in MATRIX.values()) for i in range(3)]),
}


@pytest.mark.parametrize("kind", LAYOUTS)
def test_count_layouts(spark, tmp_path, kind):
    head, lines = LAYOUTS[kind]
    got = tables.features_from_wide(tables.read_csv(spark, write(tmp_path, "t.csv", "\n".join([head, *lines]))))
    assert {(r["feature_id"], r["sample"]): r["reads"] for r in got.collect()} == {(f, f"s{i + 1}"): float(n) for f, own in MATRIX.items() for i, n in enumerate(own) if n}


def test_taxonomy_and_shift(spark, tmp_path):
    path = write(tmp_path, "x.csv", "ASV_ID,Kingdom,Phylum,Class,Order,Family,Genus\na,Chordata_1,Actinopteri_2,O_3,F_4,G_5,G one_6\nb,Chordata_1,Actinopteri_2,O_3,F_4,G_5,NA\n")
    t = {r["feature_id"]: r for r in tables.shifted_ranks_repaired(tables.taxonomy_from_wide(tables.read_csv(spark, path))).collect()}
    assert (t["a"]["phylum"], t["a"]["genus"], t["a"]["species"]) == ("Chordata", "G", "G one")
    assert (t["b"]["genus"], t["b"]["species"]) == ("G", None)


def test_tracking_repeats_skipped_stages(spark, tmp_path):
    t = tables.tracking_from_wide(tables.read_csv(spark, write(tmp_path, "t.csv", "sample,input,qc,final\na,100,,80\n")))
    assert [(r["stage"], r["reads"]) for r in t.orderBy("stage_no").collect()] == [("input", 100), ("qc", 100), ("final", 80)]


def test_metadata_by_values(spark, tmp_path):
    w = tables.read_csv(spark, write(tmp_path, "m.csv", "no,name,group\n1,S-1,x\n2,s 2,y\n3,other,z\n"))
    got = {r["sample"]: r["attrs"] for r in tables.metadata_for(w, ["s1", "s2"]).collect()}
    assert got == {"s1": {"group": "x"}, "s2": {"group": "y"}}
    twice = tables.read_csv(spark, write(tmp_path, "d.csv", "name,group\ns1,x\nS1,y\n"))
    with pytest.raises(ValueError, match="more than once"):
        tables.metadata_for(twice, ["s1"])


def test_report_tree(spark, tmp_path):
    lines = ["10.0\t10\t10\tU\t0\tunclassified", "90.0\t90\t0\tR\t1\troot", "90\t90\t0\tD\t2\t  Bacteria", "90\t90\t0\tP\t1239\t    Bacillota", "90\t90\t0\tG\t1386\t      Bacillus", "60\t60\t60\tS\t1423\t        Bacillus subtilis", "30\t30\t30\tS\t1396\t        Bacillus cereus", "broken line"]
    tree = reports.read_reports(spark, write(tmp_path, "k1.report", "\n".join(lines)))
    s = {r["taxid"]: r for r in reports.species_table(tree).collect()}
    assert s[1423]["genus"] == "Bacillus" and s[1396]["reads"] == 30 and s[1423]["sample"] == "k1"
    assert tuple(reports.totals(tree).first())[1:] == (90, 10)
    assert {r["taxid"]: r["parent"] for r in tree.collect()}[1396] == 1386


def test_fasta_and_fastq(spark, tmp_path):
    fa = fastx.read_fasta(spark, write(tmp_path, "a.fasta", ">one first\nAC\nGT\n>two\nacg\n>three\n"))
    assert [(r["name"], r["seq"]) for r in fa.orderBy("name").collect()] == [("one", "ACGT"), ("three", ""), ("two", "ACG")]
    d = tmp_path / "fq"
    d.mkdir()
    (d / "x_R1.fastq.gz").write_bytes(gzip.compress(b"@a\nACG\n+\nIII\n@b\nAC\n+\nII\n@cut\nAC"))
    (d / "x_R2.fastq").write_bytes(b"@a\nTTT\n+\n!!!\n@b\nGG\n+\n##\n")
    r = fastx.read_fastq(spark, str(d))
    assert r.count() == 4 and fastx.read_fastq(spark, str(d), most=1).count() == 2
    p = fastx.pairs(r, "x_R1.fastq.gz", "x_R2.fastq").orderBy("read_no").collect()
    assert [(x["seq1"], x["seq2"]) for x in p] == [("ACG", "TTT"), ("AC", "GG")]
    files = spark.createDataFrame([("x_R1.fastq.gz",), ("x_R2.fastq",), ("notes.txt",)], "file string")
    assert [tuple(x) for x in fastx.sample_pairs(files).collect()] == [("x", "x_R1.fastq.gz", "x_R2.fastq")]


def test_hits_paf_and_functions(spark, tmp_path):
    h = tables.read_hits(spark, write(tmp_path, "b.tsv", "q\tlcl|s\t99.5\t100\t101\t180.0\t99\t1e-50\nragged\trow\n"))
    assert [tuple(r) for r in h.select("query", "subject", "pident", "length").collect()] == [("q", "s", 99.5, 100)]
    p = tables.read_paf(spark, write(tmp_path, "a.paf", "q\t10\t0\t10\t+\tt\t20\t5\t15\t9\t10\t60\ttp:A:P\tde:f:0.01\n"))
    assert tuple(p.select("ts", "te", "de", "cs").first()) == (5, 15, 0.01, None)
    f = tables.read_stratified(spark, write(tmp_path, "f.tsv", "# Gene\ta_Abundance-RPKs\nK1: x\t5\nK1: x|g__A.s__B\t2\nUNMAPPED\t9\n"))
    assert {(r["feature"], r["taxon"], r["value"]) for r in f.collect()} == {("K1: x", None, 5.0), ("K1: x", "g__A.s__B", 2.0)}


def test_lineage_headers(spark):
    rows = [("SH1|refs|k__Fungi;p__Asco;c__C;o__O;f__F;g__G;s__G_x",), ("Bacteria;Bacillota;Bacilli;O;F;Bacillus",)]
    got = spark.createDataFrame(rows, "h string").select(*(c.alias(r) for r, c in tables.lineage_columns("h").items())).collect()
    assert got[0]["kingdom"] == "Fungi" and got[0]["species"] == "G x"
    assert got[1]["kingdom"] == "Bacteria" and got[1]["genus"] == "Bacillus" and got[1]["species"] is None


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("s1", "a", 1.0), ("s2", "a", 5.0), ("s1", "b", 10.0)], "sample string, feature_id string, reads double")
    assert [tuple(r) for r in sinks.wide_features(f, ["s1", "s2"]).collect()] == [("b", 10.0, 0.0), ("a", 1.0, 5.0)]
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "y int, z int")
    assert sinks.union_columns([a, b]).columns == ["x", "y", "z"]
    t = spark.createDataFrame([("a", "P", None), ("b", "P", "G")], "feature_id string, phylum string, genus string")
    assert {r["line"] for r in sinks.krona(f, t, ["phylum", "genus"]).where("sample = 's1'").collect()} == {"1\tP", "10\tP\tG"}
    n = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "name string, position int")
    assert [r["unique"] for r in sinks.unique_names(n).orderBy("position").collect()] == ["x", "x_2", "y"]
    sinks.write_csv(f, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_streaming_histogram_equals_batch(spark, tmp_path):
    from quadrat.operators import reads
    from quadrat.streaming import read_qc

    r = spark.createDataFrame([("f", "ACGT", "IIII"), ("f", "AC", "!!"), ("g", "ACGTAC", "I!I!I!")], "file string, seq string, qual string")
    r.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = read_qc.running_histogram(stream).writeStream.outputMode("complete").format("memory").queryName("qc").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(x) for x in spark.table("qc").collect()} == {tuple(x) for x in reads.histogram(reads.read_table(r), ["file"], "mean_q", 1.0).collect()}


def test_zipped_fasta(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.fasta", ">x one\nacg\nt\n>y\nAC\n")
        z.writestr("__MACOSX/a.fasta", ">no\nA\n")
        z.writestr("sub/b.fa", ">z two words\r\nGG\r\nTT")
        z.writestr("empty.fa", "")
    got = {r["name"]: (r["description"], r["seq"]) for r in fastx.read_fasta(spark, str(tmp_path / "two.zip")).collect()}
    assert got == {"x": ("x one", "ACGT"), "y": ("y", "AC"), "z": ("z two words", "GGTT")}


@pytest.mark.parametrize("code, text", [("UTF-8", "sample,กลุ่ม\ns1,น้ำ\n"), ("cp874", "sample,กลุ่ม\ns1,น้ำ €\n"), ("ISO-8859-1", "sample,größe\ns1,üþÿ\n"), ("UTF-8", "sample,plain\ns1,x\n")])
def test_encodings_are_told_apart(spark, tmp_path, code, text):
    p = tmp_path / "m.csv"
    p.write_bytes(text.encode(code))
    assert tables.found_encoding(spark, str(p)) == code
    df = tables.read_csv(spark, str(p), encoding=None)
    head, row = (line.split(",") for line in text.splitlines())
    assert df.columns == head and [list(r) for r in df.collect()] == [row]


def test_manifest_before_names(spark, tmp_path):
    import json

    from quadrat.operators import summaries

    files = spark.createDataFrame([(n,) for n in ("a_R1.fastq.gz", "a_R2.fastq.gz", "b.fastq", "c1.fq", "c2.fq")], "name string")
    rows = [{"sample": "one/x ", "file1": "a_R1.fastq.gz", "file2": "a_R2.fastq.gz"}, {"sample": "two", "file1": "c2.fq", "file2": "lost.fq"}, {"sample": "two", "file1": "c1.fq"}, {"sample": "two", "file1": "c1.fq"}, {"sample": "", "file1": "b.fastq"}, {"sample": "gone", "file1": "no.fq"}, {"sample": "bare"}]
    manifest = tables.read_manifest(spark, write(tmp_path, "m.json", json.dumps(rows)))
    got = {r["sample"]: (r["r1"], r["r2"]) for r in summaries.sample_files(files, manifest).collect()}
    assert got == {"one_x": (["a_R1.fastq.gz"], ["a_R2.fastq.gz"]), "two": (["c1.fq", "c2.fq"], [])}
    by_name = {"a": (["a_R1.fastq.gz"], ["a_R2.fastq.gz"]), "b": (["b.fastq"], []), "c1": (["c1.fq"], []), "c2": (["c2.fq"], [])}
    for m in (None, manifest.where("sample = 'gone'")):
        assert {r["sample"]: (r["r1"], r["r2"]) for r in summaries.sample_files(files, m).collect()} == by_name
