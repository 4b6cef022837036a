"""Queries on models of differential abundance. Suppliers are samples, their regions groups, brands taxa."""

from pyspark.sql import functions as F

from quadrat.operators import differential
from quadrat.plans.analogue import BASE, genus_counts, metadata, query

_S = BASE + """, y AS (SELECT sample, taxon, reads FROM c WHERE reads > 0),
lv AS (SELECT taxon, sum(ln(reads)) / (SELECT count(DISTINCT sample) FROM y) AS level FROM y GROUP BY 1), rf AS (SELECT sample, median(ln(reads) - level) AS f FROM y JOIN lv USING (taxon) GROUP BY 1),
sf AS (SELECT sample, exp(f - (SELECT avg(f) FROM rf)) AS factor FROM rf)"""


@query("size_factors", _S + " SELECT sample, round(factor, 6) AS factor FROM sf")
def size_factors(s, d):
    return differential.size_factors(genus_counts(s, d)).select("sample", F.round("factor", 6).alias("factor"))


@query("nb_dispersions", _S + """, gr AS (SELECT taxon, sample, grp, factor, coalesce(reads, 0) AS reads FROM (SELECT taxon FROM y GROUP BY 1 HAVING count(*) >= greatest(0.1 * (SELECT count(*) FROM sf), 1)) a CROSS JOIN (SELECT sample, grp, factor FROM sf JOIN m USING (sample)) b LEFT JOIN y USING (taxon, sample)),
pg AS (SELECT taxon, grp, count(*) AS n, sum(reads / factor) AS s, sum(pow(reads / factor, 2)) AS q, sum(1 / factor) AS inv FROM gr GROUP BY 1, 2),
mo AS (SELECT taxon, sum(n) AS n, sum(s) / sum(n) AS mu, sum(q - s * s / n) AS inn, sum(inv) AS inv, sum(n) - count(*) AS df FROM pg GROUP BY 1)
SELECT taxon, round(mu, 4) AS base_mean, df::BIGINT AS df, round(least(greatest((greatest(inn, 0) / df - inv / n * mu) / (mu * mu), 1e-8), 100), 6) AS dispersion FROM mo""")
def nb_dispersions(s, d):
    out = differential.nb_moments(genus_counts(s, d), metadata(s, d))
    return out.select("taxon", F.round("base_mean", 4).alias("base_mean"), "df", F.round("dispersion", 6).alias("dispersion"))


@query("nb_wald")
def nb_wald(s, d):
    groups = metadata(s, d)
    out = differential.nb_wald(genus_counts(s, d), groups, _reference(groups))
    return out.select("taxon", "grp", *[F.round(c, 5).alias(c) for c in ("base_mean", "dispersion", "log2_change", "error", "z", "p", "q")])


def _reference(groups):
    return groups.agg(F.min("grp")).first()[0]  # the first name, as factors have it


@query("log_differences", BASE + """, y AS (SELECT sample, taxon, grp, ln(reads) AS v FROM c JOIN m USING (sample) WHERE reads > 0), k AS (SELECT taxon FROM y GROUP BY 1 HAVING count(*) >= greatest(0.1 * (SELECT count(DISTINCT sample) FROM m), 1)),
a AS (SELECT taxon, grp, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM y JOIN k USING (taxon) GROUP BY 1, 2), z AS (SELECT taxon, sum(n * var) / (sum(n) - count(*)) AS s2 FROM a GROUP BY 1 HAVING sum(n) > count(*)), r AS (SELECT * FROM a WHERE grp = (SELECT min(grp) FROM m))
SELECT a.taxon, a.grp, (a.n + r.n)::BIGINT AS n, round(a.mean - r.mean, 6) AS difference, round(s2 * (1.0 / a.n + 1.0 / r.n), 6) AS variance FROM a JOIN r ON r.taxon = a.taxon JOIN z ON z.taxon = a.taxon WHERE a.grp <> r.grp""")
def log_differences(s, d):
    groups = metadata(s, d)
    out = differential.log_differences(genus_counts(s, d), groups, _reference(groups))
    return out.select("taxon", "grp", "n", F.round("difference", 6).alias("difference"), F.round("variance", 6).alias("variance"))


@query("bias_corrected_tests")
def bias_corrected_tests(s, d):
    groups = metadata(s, d)
    out = differential.bias_corrected_tests(genus_counts(s, d), groups, _reference(groups))
    return out.select("taxon", "grp", "n", *[F.round(c, 5).alias(c) for c in ("difference", "error", "z", "p", "q")])
