"""The star-schema tables read as the library's tables, so every operator can run on them.

A supplier is a sample, a part a feature, quantities are reads; a part's type,
brand and name are its lineage, unnamed for small parts; a supplier's region is
its group. Orders are queries with line items as hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL twin if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)  # some operators have Python functions that import this package
    return spark.read.parquet(f"{d}/{name}.parquet")


def features(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").cast("double").alias("reads"))


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    big = F.col("p_size") > 5
    return table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("phylum"), F.when(big, F.col("p_brand")).alias("genus"), F.when(big, F.col("p_name")).alias("species"))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("sample"), F.col("r_name").alias("grp"), F.col("n_name").alias("site"), F.col("s_acctbal").alias("acctbal"))


#: The same tables for the SQL twins: f, t, m; n: features with lineage; c, p: counts and per cent by genus; e, g: the same by nation.
BASE = """WITH f AS (SELECT l_suppkey AS sample, l_partkey AS feature_id, CAST(sum(l_quantity) AS DOUBLE) AS reads FROM lineitem GROUP BY 1, 2),
t AS (SELECT p_partkey AS feature_id, p_type AS phylum, CASE WHEN p_size > 5 THEN p_brand END AS genus, CASE WHEN p_size > 5 THEN p_name END AS species FROM part),
m AS (SELECT s_suppkey AS sample, r_name AS grp, n_name AS site, s_acctbal AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT f.*, phylum, genus, species FROM f LEFT JOIN t USING (feature_id)),
c AS (SELECT sample, coalesce(genus, 'Unclassified') AS taxon, sum(reads) AS reads FROM n GROUP BY 1, 2),
p AS (SELECT *, coalesce(100 * reads / nullif(sum(reads) OVER (PARTITION BY sample), 0), 0) AS pct FROM c),
e AS (SELECT site AS sample, taxon, sum(reads) AS reads FROM c JOIN m USING (sample) GROUP BY 1, 2),
g AS (SELECT *, 100 * reads / sum(reads) OVER (PARTITION BY sample) AS pct FROM e)
"""


def genus_counts(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.functions.labels import analysis_label
    from quadrat.operators import community

    return community.with_share(community.rank_counts(community.with_taxonomy(features(spark, d), taxonomy(spark, d)), analysis_label("genus")))


def site_counts(spark: SparkSession, d: str) -> DataFrame:
    """Genus counts with nations as samples: 25 samples whatever the scale."""
    from quadrat.operators import community

    c = genus_counts(spark, d).join(metadata(spark, d).select("sample", "site"), "sample")
    return community.with_share(c.groupBy(F.col("site").alias("sample"), "taxon").agg(F.sum("reads").alias("reads")))


def site_groups(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).select(F.col("site").alias("sample"), "grp").distinct()


def as_features(counts: DataFrame) -> DataFrame:
    return counts.select("sample", F.col("taxon").alias("feature_id"), "reads")


def mode():
    """A line item's number as the name of a tool or a genus."""
    return F.concat(F.lit("M"), F.col("l_linenumber").cast("string"))
