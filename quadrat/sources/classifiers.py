"""Result tables of classifiers and function profilers, as long tables. ``sample`` is a file's name up to its first dot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.operators.controls import first_filled
from quadrat.sources.tables import read_csv

_SAMPLE = r"([^/]+?)(\.[^/]*)?$"


def _sample() -> Column:
    return F.regexp_extract(F.input_file_name(), _SAMPLE, 1)


def _table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    rows = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    return rows.withColumn("__sample", _sample())


def plain_name(c: str | Column) -> Column:
    """A species name with single spaces, without underscores."""
    return F.trim(F.regexp_replace(F.translate(F.col(c) if isinstance(c, str) else c, "_", " "), r"\s+", " "))


def _shares(rows: DataFrame) -> DataFrame:
    """(sample, species, value, share): per cent of the sample's sum."""
    s = rows.where("species IS NOT NULL AND value IS NOT NULL").groupBy("sample", "species").agg(F.sum("value").alias("value"))
    return s.withColumn("share", F.coalesce(F.try_divide(100 * F.col("value"), F.sum("value").over(Window.partitionBy("sample"))), F.lit(0.0)))


def read_bracken(spark: SparkSession, path: str) -> DataFrame:
    """(sample, taxid, species, value, share) of the species rows."""
    t = _table(spark, path)
    level = F.coalesce(F.col("taxonomy_lvl"), F.lit("S")) if "taxonomy_lvl" in t.columns else F.lit("S")
    rows = t.where(level == "S").select(F.col("__sample").alias("sample"), F.col("taxonomy_id").try_cast("long").alias("taxid"), plain_name("name").alias("species"), F.col("new_est_reads").try_cast("double").alias("value"))
    return _shares(rows).join(rows.groupBy("sample", "species").agg(F.min("taxid").alias("taxid")), ["sample", "species"]).select("sample", "taxid", "species", "value", "share")


def read_centrifuge(spark: SparkSession, path: str) -> DataFrame:
    """(sample, species, value, share) of the species rows of a Centrifuge or Centrifuger report."""
    t = _table(spark, path)
    return _shares(t.where(F.lower(F.trim("taxRank")) == "species").select(F.col("__sample").alias("sample"), plain_name("name").alias("species"), F.col("numReads").try_cast("double").alias("value")))


def read_gottcha2(spark: SparkSession, path: str) -> DataFrame:
    """(sample, species, value, share) of the species rows."""
    t = _table(spark, path)
    return _shares(t.where(F.lower(F.trim("LEVEL")) == "species").select(F.col("__sample").alias("sample"), plain_name("NAME").alias("species"), F.col("REL_ABUNDANCE").try_cast("double").alias("value")))


def species_shares(tree: DataFrame) -> DataFrame:
    """(sample, species, value, share) of the species rows of indented reports."""
    return _shares(tree.where("rank = 'S'").select("sample", plain_name("name").alias("species"), F.col("clade_reads").cast("double").alias("value")))


def classified_share(tree: DataFrame) -> DataFrame:
    """(sample, pct): reads under the root, per cent of all; null where a report has no root."""
    s = tree.groupBy("sample").agg(F.sum(F.when(F.col("rank") == "R", F.col("clade_reads"))).alias("c"), F.sum(F.when(F.col("rank") == "U", F.col("clade_reads"))).alias("u"))
    return s.select("sample", F.try_divide(100.0 * F.col("c"), F.coalesce("u", F.lit(0)) + F.col("c")).alias("pct"))


def read_mapped_shares(spark: SparkSession, path: str) -> DataFrame:
    """(sample, nucleotide_pct, translated_pct, unmapped_pct) of profiler logs: of several runs in a log the last counts."""
    text = spark.read.text(path, wholetext=True).select(_sample().alias("sample"), "value")
    last = lambda kind: F.element_at(F.regexp_extract_all("value", F.lit(rf"Unaligned reads after {kind} alignment:\s*([0-9.]+)\s*%"), 1), -1).cast("double")
    found = lambda kind: F.when(F.col("value").rlike(rf"Unaligned reads after {kind} alignment:\s*[0-9.]+\s*%"), last(kind))
    t = text.select("sample", found("nucleotide").alias("n"), found("translated").alias("t")).where("n IS NOT NULL")
    return t.select("sample", F.round(100 - F.col("n"), 4).alias("nucleotide_pct"), F.round(F.coalesce(F.col("n") - F.col("t"), F.lit(0.0)), 4).alias("translated_pct"), F.round(F.coalesce("t", "n"), 4).alias("unmapped_pct"))


def read_clade_profile(spark: SparkSession, path: str, prefix: str = "g__") -> DataFrame:
    """(sample, taxon, pct) of the clades of one rank of a profile whose lines are lineages joined by bars."""
    v = F.split("value", "\t")
    last = F.element_at(F.split(v[0], r"\|"), -1)
    rows = spark.read.text(path).select(_sample().alias("sample"), "value").where(~F.col("value").startswith("#") & (F.size(v) >= 3) & last.startswith(prefix))
    return rows.groupBy("sample", F.translate(F.substring(last, len(prefix) + 1, 1 << 30), "_", " ").alias("taxon")).agg(F.sum(F.coalesce(v[2].try_cast("double"), F.lit(0.0))).alias("pct"))


def read_pathways(spark: SparkSession, path: str) -> DataFrame:
    """(sample, feature, description, value, pct) of a predicted pathway table; pct of the sample's sum. A column named description is one."""
    wide = read_csv(spark, path, sep="\t")
    key = wide.columns[0]
    description = F.col("description") if "description" in wide.columns else F.lit(None).cast("string")
    samples = [c for c in wide.columns[1:] if c != "description"]
    long = wide.select(F.col(f"`{key}`").alias("feature"), description.alias("description"), *(F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias(c) for c in samples)).unpivot(["feature", "description"], samples, "sample", "value")
    return long.withColumn("pct", F.coalesce(F.try_divide(100 * F.col("value"), F.sum("value").over(Window.partitionBy("sample"))), F.lit(0.0))).where("value > 0").select("sample", "feature", "description", "value", "pct")


def read_nsti(spark: SparkSession, path: str) -> DataFrame:
    """(sample, nsti): weighted distance of each sample to sequenced genomes."""
    v = F.split("value", "\t")
    return spark.read.text(path).select(v[0].alias("sample"), F.get(v, F.lit(1)).try_cast("double").alias("nsti")).where("nsti IS NOT NULL")


def read_names(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(id, name) of a two-column map, plain or compressed; only names that match the pattern, in any case, if one is given."""
    v = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(v[0].alias("id"), F.get(v, F.lit(1)).alias("name")).where("name <> ''")
    return rows if pattern is None else rows.where(F.col("name").rlike(f"(?i){pattern}"))


#: Names of columns that tools give to the same thing.
ALIASES = {
    "contig": ["Contig id", "contig_id", "seq_name", "SEQUENCE", "#Sequence Id"], "gene": ["Element symbol", "Gene symbol", "GENE", "Gene"], "type": ["Type", "Element type", "molecule_type"], "subtype": ["Subtype", "Element subtype"],
    "class": ["Class", "RESISTANCE"], "subclass": ["Subclass"], "name": ["Element name", "Sequence name", "PRODUCT", "Product"], "method": ["Method"], "identity": ["% Identity to reference", "% Identity to reference sequence", "%IDENTITY"],
    "coverage": ["% Coverage of reference", "% Coverage of reference sequence", "%COVERAGE"], "depth": ["cov."], "circular": ["circ."], "length": ["length", "size"], "completeness": ["Completeness"], "contamination": ["Contamination"],
    "bin": ["Name"], "cluster": ["primary_cluster_id"], "start": ["Start", "START"], "end": ["Stop", "END"], "strand": ["Strand", "STRAND"],
}


def read_tool_table(spark: SparkSession, path: str, fields: list[str], aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(sample, the fields as text) of a tool's tab-separated table: each field from the first of its known columns that is there and filled."""
    t = _table(spark, path)
    t = t.toDF(*(c.strip() for c in t.columns))
    return t.select(F.col("__sample").alias("sample"), *(first_filled([f, *aliases.get(f, [])], t.columns).alias(f) for f in fields))


def genus_of(taxon: str | Column) -> Column:
    """Genus of a stratified taxon (``g__Bacillus.s__B_subtilis``); Unclassified for unclassified ones; text without a genus stays; empty stays empty."""
    c = F.col(taxon) if isinstance(taxon, str) else taxon
    return F.when(c.rlike(r"g__[^.|]+"), F.translate(F.regexp_extract(c, r"g__([^.|]+)", 1), "_", " ")).when(F.lower(c).startswith("unclassified"), "Unclassified").otherwise(F.coalesce(c, F.lit("")))
