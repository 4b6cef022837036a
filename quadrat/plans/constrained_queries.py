"""Queries on constrained ordination: brands of suppliers by the suppliers' balance and the number of their nation."""

from pyspark.sql import functions as F

from quadrat.operators import constrained
from quadrat.plans.analogue import BASE, genus_counts, query, table

_VARIABLES = ["balance", "nation"]


def _variables(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))


@query("constrained_f", BASE + """, l AS (SELECT sample, taxon, ln(1 + reads) AS l FROM c WHERE reads > 0 AND sample IN (SELECT s_suppkey FROM supplier)), k AS (SELECT count(DISTINCT taxon) AS taxa FROM l),
mi AS (SELECT sample, sum(l) / (SELECT taxa FROM k) AS m FROM l GROUP BY 1), x0 AS (SELECT s_suppkey AS sample, s_acctbal AS a, s_nationkey::DOUBLE AS b FROM supplier WHERE s_suppkey IN (SELECT sample FROM l)),
x AS (SELECT sample, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b FROM x0),
gx AS (SELECT count(*) AS n, sum(m) AS m, sum(m * m) AS mm, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * m) AS am, sum(b * m) AS bm FROM x JOIN mi USING (sample)),
tx AS (SELECT taxon, sum(l) AS l, sum(l * l) AS ll, sum(a * l) - any_value(am) AS ba, sum(b * l) - any_value(bm) AS bb2 FROM l JOIN x USING (sample) CROSS JOIN gx GROUP BY 1),
o AS (SELECT sum(ll) AS ll, sum(pow(tx.l - gx.m, 2)) AS d, sum(ba * ba) AS oaa, sum(ba * bb2) AS oab, sum(bb2 * bb2) AS obb FROM tx CROSS JOIN gx),
ex AS (SELECT n, (bb * oaa - 2 * ab * oab + aa * obb) / (aa * bb - ab * ab) AS e, ll - (SELECT taxa FROM k) * mm - d / n AS total FROM o CROSS JOIN gx)
SELECT n::BIGINT AS samples, 2::BIGINT AS df, (n - 3)::BIGINT AS residual_df, round(e, 5) AS explained, round(total - e, 5) AS residual, round((e / 2) / ((total - e) / (n - 3)), 6) AS f FROM ex""")
def constrained_f(s, d):
    out = constrained.constrained_test(genus_counts(s, d), _variables(s, d), _VARIABLES, permutations=0)
    return out.select("samples", "df", "residual_df", F.round("explained", 5).alias("explained"), F.round("residual", 5).alias("residual"), F.round("f", 6).alias("f"))


@query("constrained_test")
def constrained_test(s, d):
    return constrained.constrained_test(genus_counts(s, d), _variables(s, d), _VARIABLES)


@query("constrained_axes")
def constrained_axes(s, d):
    out = constrained.constrained_axes(genus_counts(s, d), _variables(s, d), _VARIABLES)
    return out.select("kind", "name", "axis", F.round("value", 6).alias("value"), F.round("share", 6).alias("share"))
