"""Queries on readers: each writes files of a layout from the given tables, reads them, and drops them when its result is written."""

from pyspark.sql import functions as F

from quadrat.operators import summaries
from quadrat.plans.analogue import BASE, query, site_counts, table, taxonomy
from quadrat.rounds import Rounds
from quadrat.schemas import RANKS
from quadrat.sources import fastx, tables


def _read_back(spark, rows, form, options, read):
    keep = Rounds(spark, "files")
    out = keep(read(keep.files(rows, form, **options)))
    keep.keep(out)
    return out


@query("fasta_records", "SELECT 'p' || p_partkey AS name, 'p' || p_partkey || ' ' || p_brand AS description, upper(regexp_replace(p_name, '\\s', '', 'g')) AS seq FROM part")
def fasta_records(s, d):
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    lines = table(s, d, "part").select(F.concat(F.lit(">"), name, F.lit(" "), F.col("p_brand"), F.lit("\n"), F.replace("p_name", F.lit(" "), F.lit("\n"))).alias("value"))
    return _read_back(s, lines, "text", {}, lambda path: fastx.read_fasta(s, path))


@query("fastq_records", "SELECT 'o' || o_orderkey AS header, o_orderpriority AS seq, repeat('I', length(o_orderpriority)) AS qual FROM orders")
def fastq_records(s, d):
    record = F.concat(F.lit("@o"), F.col("o_orderkey").cast("string"), F.lit("\n"), F.col("o_orderpriority"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("o_orderpriority")))
    return _read_back(s, table(s, d, "orders").select(record.alias("value")), "text", {"compression": "gzip"}, lambda path: fastx.read_fastq(s, f"{path}/*.gz").select("header", "seq", "qual"))


@query("counts_of_wide_file", BASE + "SELECT taxon AS feature_id, sample, reads FROM e WHERE reads > 0")
def counts_of_wide_file(s, d):
    """Samples are the columns of a file: 25 nations."""
    wide = site_counts(s, d).groupBy(F.col("taxon").alias("feature_id")).pivot("sample").agg(F.sum("reads"))
    return _read_back(s, wide, "csv", {"header": "true", "sep": ";"}, lambda path: tables.features_from_wide(tables.read_csv(s, path, sep=None, encoding=None)))


@query("taxonomy_of_file", BASE + "SELECT CAST(feature_id AS VARCHAR) AS feature_id, phylum, genus, species FROM t")
def taxonomy_of_file(s, d):
    rows = taxonomy(s, d).select(F.col("feature_id").alias("ASV_ID"), F.col("phylum").alias("Phylum"), F.coalesce("genus", F.lit("NA")).alias("Genus"), F.col("species").alias("Species"))
    return _read_back(s, rows, "csv", {"header": "true", "sep": "\t"}, lambda path: tables.taxonomy_from_wide(tables.read_csv(s, path, sep=None)).select("feature_id", *[r for r in RANKS if r in ("phylum", "genus", "species")]))


@query("listed_files", """WITH f AS (SELECT DISTINCT 'o' || l_orderkey || '_R' || l_linenumber || '.fastq.gz' AS name FROM lineitem WHERE l_linenumber <= 2),
r AS (SELECT 'c' || o_custkey AS sample, 'o' || o_orderkey || '_R1.fastq.gz' AS file1, 'o' || o_orderkey || '_R2.fastq.gz' AS file2 FROM orders)
SELECT sample, string_agg(file1, '|' ORDER BY file1) AS r1, coalesce(string_agg(b.name, '|' ORDER BY b.name), '') AS r2 FROM r JOIN f a ON a.name = file1 LEFT JOIN f b ON b.name = file2 GROUP BY 1""")
def listed_files(s, d):
    """An order's first two items are its files; a customer is a sample with the files of all its orders."""
    name = lambda k, n: F.concat(F.lit("o"), F.col(k).cast("string"), F.lit("_R"), n, F.lit(".fastq.gz"))
    files = table(s, d, "lineitem").where("l_linenumber <= 2").select(name("l_orderkey", F.col("l_linenumber").cast("string")).alias("name"))
    manifest = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("sample"), name("o_orderkey", F.lit("1")).alias("file1"), name("o_orderkey", F.lit("2")).alias("file2"))
    return summaries.listed_files(manifest, files).select("sample", F.array_join(F.sort_array("r1"), "|").alias("r1"), F.array_join(F.sort_array("r2"), "|").alias("r2"))
