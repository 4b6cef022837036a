"""Queries on mixed models: logs of brands' shares by the suppliers' balance, with their nations as subjects."""

from pyspark.sql import functions as F

from quadrat.operators import mixed
from quadrat.plans.analogue import BASE, genus_counts, metadata, query


def _values(s, d):
    return genus_counts(s, d).where("pct > 0").select("sample", "taxon", F.log2("pct").alias("value"))


def _metadata(s, d):
    return metadata(s, d).select("sample", F.col("site").alias("subject"), (F.col("acctbal") / 1000).alias("balance"))


@query("mixed_sums", BASE + """, y AS (SELECT taxon, site, acctbal / 1000 AS x, log2(pct) AS y FROM p JOIN m USING (sample) WHERE pct > 0),
s AS (SELECT taxon, site, count(*) AS n, sum(x) AS x, sum(y) AS c, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM y GROUP BY 1, 2)
SELECT taxon, n, count(*) AS subjects, round(sum(xx), 4) AS xx, round(sum(xy), 4) AS xy, round(sum(yy), 4) AS yy, round(sum(x * x), 4) AS bb, round(sum(x * c), 4) AS bc, round(sum(c * c), 4) AS cc FROM s GROUP BY 1, 2""")
def mixed_sums(s, d):
    out = mixed.mixed_sums(_values(s, d), _metadata(s, d), ["balance"])
    cells = {"xx": F.get("xx", F.lit(3)), "xy": F.get("xy", F.lit(1)), "yy": F.col("yy"), "bb": F.get("bb", F.lit(3)), "bc": F.get("bc", F.lit(1)), "cc": F.col("cc")}
    return out.select("taxon", "n", "subjects", *[F.round(c, 4).alias(n) for n, c in cells.items()])


@query("mixed_effects")
def mixed_effects(s, d):
    out = mixed.mixed_effects(_values(s, d), _metadata(s, d), ["balance"])
    return out.select("taxon", "variable", "samples", "subjects", *[F.round(c, 5).alias(c) for c in ("estimate", "error", "subject_share", "t", "p", "q")])
