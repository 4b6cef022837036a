"""Queries on diversity, distances, ordination and networks."""

from pyspark.sql import functions as F

from quadrat.operators import diversity as v
from quadrat.operators import network, ordination
from quadrat.operators import stats as st
from quadrat.plans.analogue import BASE, as_features, features, genus_counts, metadata, query, site_counts, site_groups, table
from quadrat.plans.stats_queries import beta_sql

# Raw counts of single lines, so that small counts occur: reads of a part at a supplier are numbers of lines.
_LINES = "WITH f AS (SELECT l_suppkey AS sample, l_partkey AS feature_id, CAST(count(*) AS DOUBLE) AS reads FROM lineitem GROUP BY 1, 2) "
_ALPHA = """, x AS (SELECT sample, round_even(reads, 0) AS c, round_even(reads, 0) / sum(round_even(reads, 0)) OVER (PARTITION BY sample) AS p FROM f WHERE round_even(reads, 0) > 0),
s AS (SELECT sample, count(*) AS s, count(*) FILTER (WHERE c = 1)::DOUBLE AS f1, count(*) FILTER (WHERE c = 2)::DOUBLE AS f2, count(*) FILTER (WHERE c <= 10)::DOUBLE AS sr, coalesce(sum(c) FILTER (WHERE c <= 10), 0) AS nr,
 coalesce(sum(c * (c - 1)) FILTER (WHERE c <= 10), 0) AS q, -sum(p * ln(p)) AS h, 1 - sum(p * p) AS d FROM x GROUP BY 1)
"""
_ACE = "CASE WHEN nr > 0 AND nr <> f1 THEN s - sr + sr / (1 - f1 / nr) + f1 / (1 - f1 / nr) * CASE WHEN nr > 1 THEN greatest(sr / (1 - f1 / nr) * q / (nr * (nr - 1)) - 1, 0) ELSE 0 END ELSE s END"


def _lines(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature_id")).agg(F.count("*").cast("double").alias("reads"))


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


_SE = "CASE WHEN f1 > 0 THEN sqrt(f1 * (f1 - 1) / (2 * (f2 + 1)) + f1 * (2 * f1 - 1) ** 2 / (4 * (f2 + 1) ** 2) + f1 * f1 * f2 * (f1 - 1) ** 2 / (4 * (f2 + 1) ** 4)) ELSE 0 END"


@query("alpha_diversity", _LINES + _ALPHA + f"SELECT sample, s AS observed, round(s + f1 * (f1 - 1) / (2 * (f2 + 1)), 6) AS chao1, round({_SE}, 6) AS se_chao1, round({_ACE}, 6) AS ace, round(h, 6) AS shannon, round(d, 6) AS simpson FROM s")
def alpha_diversity(s, d):
    return _rounded(v.alpha(_lines(s, d)), "chao1", "se_chao1", "ace", "shannon", "simpson")


@query("chao1_classic", _LINES + _ALPHA + "SELECT sample, round(CASE WHEN f2 > 0 THEN s + f1 * f1 / (2 * f2) ELSE s + f1 * (f1 - 1) / 2 END, 6) AS chao1 FROM s")
def chao1_classic(s, d):
    return _rounded(v.alpha(_lines(s, d), classic_chao=True).select("sample", "chao1"), "chao1")


@query("evenness", _LINES + _ALPHA + "SELECT sample, round(h / nullif(ln(s), 0), 6) AS evenness FROM s")
def evenness(s, d):
    return _rounded(v.evenness(_lines(s, d)), "evenness")


@query("rank_abundance", BASE + "SELECT sample, feature_id, (row_number() OVER (PARTITION BY sample ORDER BY reads DESC, feature_id))::INT AS rank, round(reads / sum(reads) OVER (PARTITION BY sample), 9) AS share FROM f WHERE reads > 0")
def rank_abundance(s, d):
    return v.rank_abundance(features(s, d)).withColumn("share", F.round("share", 9))


_EXPECTED = "sum(CASE WHEN n >= big THEN 1 WHEN big - reads < n THEN 1 ELSE 1 - exp(lgamma(big - reads + 1) - lgamma(n + 1) - lgamma(greatest(big - reads - n, 0) + 1) - (lgamma(big + 1) - lgamma(n + 1) - lgamma(greatest(big - n, 0) + 1))) END)"


@query("rarefaction", BASE + f""", x AS (SELECT sample, sum(reads) AS big FROM e GROUP BY 1), y AS (SELECT DISTINCT sample, big, greatest(1, floor(big * pow(i / 30.0, 1.6)))::BIGINT AS n FROM x, range(1, 31) r(i)),
z AS (SELECT sample, big, n FROM y UNION SELECT sample, big, big::BIGINT FROM x)
SELECT sample, n AS depth, round({_EXPECTED}, 4) AS expected FROM z JOIN e USING (sample) GROUP BY sample, big, n""")
def rarefaction(s, d):
    return v.rarefaction(as_features(site_counts(s, d))).withColumn("expected", F.round("expected", 4))


@query("richness_plateau", BASE + f", x AS (SELECT sample, sum(reads) AS big, count(*) AS k FROM e GROUP BY 1), y AS (SELECT *, floor(big * 0.9)::BIGINT AS n FROM x) SELECT sample, round(100 * (any_value(k) - {_EXPECTED}) / any_value(k), 4) AS gained_pct FROM y JOIN e USING (sample) GROUP BY sample, big, n")
def richness_plateau(s, d):
    return v.plateau(as_features(site_counts(s, d))).withColumn("gained_pct", F.round("gained_pct", 4))


_BRAY = """, q AS (SELECT sample, feature_id, reads / sum(reads) OVER (PARTITION BY sample) AS p FROM f), s AS (SELECT DISTINCT sample FROM f),
b AS (SELECT a.sample AS i, b.sample AS j, sum(least(a.p, b.p)) AS m FROM q a JOIN q b ON a.feature_id = b.feature_id AND a.sample < b.sample GROUP BY 1, 2),
d AS (SELECT a.sample AS i, b.sample AS j, 1 - coalesce(m, 0) AS d FROM s a JOIN s b ON a.sample < b.sample LEFT JOIN b ON b.i = a.sample AND b.j = b.sample)
"""
_BRAY = _BRAY.replace("FROM s a JOIN s b ON a.sample < b.sample LEFT JOIN b ON b.i = a.sample AND b.j = b.sample", "FROM s a JOIN s z ON a.sample < z.sample LEFT JOIN b ON b.i = a.sample AND b.j = z.sample").replace("SELECT a.sample AS i, b.sample AS j, 1 -", "SELECT a.sample AS i, z.sample AS j, 1 -")


@query("bray_curtis", BASE + _BRAY + "SELECT i, j, round(d, 6) AS d FROM d")
def bray_curtis(s, d):
    return _rounded(v.bray_curtis(features(s, d)), "d")


@query("bray_curtis_counts", BASE + ", x AS (SELECT sample, sum(reads) AS t FROM e GROUP BY 1), b AS (SELECT a.sample AS i, b.sample AS j, sum(least(a.reads, b.reads)) AS m FROM e a JOIN e b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY 1, 2) SELECT i, j, round(1 - 2 * m / (x.t + y.t), 6) AS d FROM b JOIN x ON i = x.sample JOIN x y ON j = y.sample")
def bray_curtis_counts(s, d):
    return _rounded(v.bray_curtis(as_features(site_counts(s, d)), on_counts=True), "d")


@query("jaccard", BASE + """, s AS (SELECT sample, count(*) AS k FROM f WHERE reads > 0 GROUP BY 1),
b AS (SELECT a.sample AS i, b.sample AS j, count(*) AS m FROM f a JOIN f b ON a.feature_id = b.feature_id AND a.sample < b.sample GROUP BY 1, 2)
SELECT a.sample AS i, z.sample AS j, round(1 - coalesce(m, 0) / (a.k + z.k - coalesce(m, 0))::DOUBLE, 6) AS d FROM s a JOIN s z ON a.sample < z.sample LEFT JOIN b ON b.i = a.sample AND b.j = z.sample""")
def jaccard(s, d):
    return _rounded(v.jaccard(features(s, d)), "d")


@query("jaccard_quantitative", BASE + _BRAY + "SELECT i, j, round(2 * d / (1 + d), 6) AS d FROM d")
def jaccard_quantitative(s, d):
    return _rounded(v.quantitative_jaccard(v.bray_curtis(features(s, d))), "d")


#: A tree over parts: a branch to the type, to the brand within it and to the part.
_TREE = """, y AS (SELECT p_partkey AS feature_id, 't' || p_type AS node, 1.0::DOUBLE AS length FROM part UNION ALL SELECT p_partkey, 'b' || p_type || p_brand, 0.5 FROM part UNION ALL SELECT p_partkey, 'p' || CAST(p_partkey AS VARCHAR), 0.25 FROM part)"""


def _ancestry(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("feature_id"), F.explode(F.array(F.struct(F.concat(F.lit("t"), "p_type").alias("node"), F.lit(1.0).alias("length")), F.struct(F.concat(F.lit("b"), "p_type", "p_brand").alias("node"), F.lit(0.5).alias("length")), F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.lit(0.25).alias("length")))).alias("x")).select("feature_id", "x.node", "x.length")


@query("faith_pd", BASE + _TREE + " SELECT sample, round(sum(length), 6) AS pd FROM (SELECT DISTINCT sample, node, length FROM f JOIN y USING (feature_id) WHERE reads > 0) x GROUP BY 1")
def faith_pd(s, d):
    return _rounded(v.faith_pd(features(s, d), _ancestry(s, d)), "pd")


_UNI = _TREE + """, q AS (SELECT sample, feature_id, reads / sum(reads) OVER (PARTITION BY sample) AS p FROM f), o AS (SELECT sample, node, sum(p) AS p, any_value(length) AS l FROM q JOIN y USING (feature_id) GROUP BY 1, 2),
r AS (SELECT sample, sum(l) AS u, sum(l * p) AS w FROM o GROUP BY 1), b AS (SELECT a.sample AS i, b.sample AS j, sum(a.l) AS bo, sum(a.l * least(a.p, b.p)) AS lo FROM o a JOIN o b ON a.node = b.node AND a.sample < b.sample GROUP BY 1, 2)
"""


def _few(s, d):
    """Features with nations as samples."""
    return features(s, d).join(metadata(s, d).select("sample", "site"), "sample").groupBy(F.col("site").alias("sample"), "feature_id").agg(F.sum("reads").alias("reads"))


_FEW = BASE.replace("f AS (", "f0 AS (", 1).replace("FROM lineitem GROUP BY 1, 2),", "FROM lineitem GROUP BY 1, 2), m0 AS (SELECT s_suppkey AS sample, n_name AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey), f AS (SELECT site AS sample, feature_id, sum(reads) AS reads FROM f0 JOIN m0 USING (sample) GROUP BY 1, 2),", 1).split(",\nm AS")[0]


@query("unifrac", _FEW + _UNI + "SELECT i, j, round((x.u + z.u - 2 * bo) / (x.u + z.u - bo), 6) AS d FROM b JOIN r x ON i = x.sample JOIN r z ON j = z.sample")
def unifrac(s, d):
    return _rounded(v.unifrac(_few(s, d), _ancestry(s, d)), "d")


@query("unifrac_weighted", _FEW + _UNI + "SELECT i, j, round((x.w + z.w - 2 * lo) / (x.w + z.w), 6) AS d FROM b JOIN r x ON i = x.sample JOIN r z ON j = z.sample")
def unifrac_weighted(s, d):
    return _rounded(v.unifrac(_few(s, d), _ancestry(s, d), weighted=True), "d")


@query("within_between", BASE + _BRAY + "SELECT least(a.grp, b.grp) AS grp_i, greatest(a.grp, b.grp) AS grp_j, count(*) AS n, round(avg(d), 6) AS mean_d, CASE WHEN a.grp = b.grp THEN 'within' ELSE 'between' END AS kind FROM d JOIN m a ON i = a.sample JOIN m b ON j = b.sample GROUP BY 1, 2, 5")
def within_between(s, d):
    return _rounded(v.within_between(v.bray_curtis(features(s, d)), metadata(s, d).select("sample", "grp")), "mean_d")


@query("clr", BASE + ", k AS (SELECT count(DISTINCT taxon) AS n FROM c) SELECT sample, taxon, round(ln(reads + 1) - sum(ln(reads + 1)) OVER (PARTITION BY sample) / n, 6) AS clr, round(0 - sum(ln(reads + 1)) OVER (PARTITION BY sample) / n, 6) AS base FROM c, k")
def clr(s, d):
    return _rounded(v.clr(genus_counts(s, d)), "clr", "base")


@query("z_scores", BASE + ", k AS (SELECT count(DISTINCT sample) AS n FROM p), t3 AS (SELECT taxon, n, sum(pct) / n AS mu, sum(pct * pct) AS ss FROM p, k GROUP BY 1, 2), x AS (SELECT s.sample, t3.taxon, coalesce(pct, 0) AS pct, mu, sqrt(greatest((ss - n * mu * mu) / (n - 1), 0)) AS sd FROM t3 CROSS JOIN (SELECT DISTINCT sample FROM p) s LEFT JOIN p ON p.sample = s.sample AND p.taxon = t3.taxon) SELECT sample, taxon, round(CASE WHEN sd > 1e-12 THEN greatest(-3, least(3, (pct - mu) / sd)) ELSE 0 END, 5) AS z FROM x")
def z_scores(s, d):
    return v.z_scores(genus_counts(s, d)).withColumn("z", F.round("z", 5))


_GD = _BRAY.replace("FROM f)", "FROM (SELECT sample, taxon AS feature_id, reads FROM e) f)").replace("SELECT DISTINCT sample FROM f)", "SELECT DISTINCT sample FROM e)")
_GRP = ", h AS (SELECT DISTINCT site AS sample, grp FROM m) "


def _site_distances(s, d):
    return v.bray_curtis(as_features(site_counts(s, d)))


@query("permanova_statistic", BASE + _GD + _GRP + """, z AS (SELECT grp, count(*) AS k FROM h GROUP BY 1), x AS (SELECT a.grp AS a, b.grp AS b, sum(d * d) AS s FROM d JOIN h a ON i = a.sample JOIN h b ON j = b.sample GROUP BY 1, 2),
y AS (SELECT sum(s) AS t, sum(CASE WHEN a = b THEN s / k ELSE 0 END) AS w FROM x JOIN z ON a = z.grp), q2 AS (SELECT sum(k) AS n, count(*) AS k FROM z)
SELECT n::BIGINT AS n, k, round((t / n - w) / (t / n), 6) AS r2, round(((t / n - w) / (k - 1)) / (w / (n - k)), 6) AS f FROM y, q2""")
def permanova_statistic(s, d):
    return _rounded(st.permanova_statistic(_site_distances(s, d), site_groups(s, d)), "r2", "f")


@query("anosim_statistic", BASE + _GD + _GRP + ", r AS (SELECT *, rank() OVER (ORDER BY round(d, 12)) + (count(*) OVER (PARTITION BY round(d, 12)) - 1) / 2.0 AS rk FROM d) SELECT round((avg(rk) FILTER (WHERE a.grp <> b.grp) - avg(rk) FILTER (WHERE a.grp = b.grp)) / (count(*) / 2.0), 6) AS r FROM r JOIN h a ON i = a.sample JOIN h b ON j = b.sample")
def anosim_statistic(s, d):
    return _rounded(st.anosim_statistic(_site_distances(s, d).withColumn("d", F.round("d", 12)), site_groups(s, d)), "r")


@query("permanova_test")
def permanova_test(s, d):
    return ordination.permanova(_site_distances(s, d), site_groups(s, d))


@query("pcoa")
def pcoa(s, d):
    return ordination.pcoa(_site_distances(s, d))


@query("upgma")
def upgma(s, d):
    return ordination.clusters(_site_distances(s, d))


@query("ward_clusters")
def ward_clusters(s, d):
    return ordination.clusters(_site_distances(s, d), "ward")


@query("neighbour_joining")
def neighbour_joining(s, d):
    return ordination.neighbour_joining(_site_distances(s, d))


@query("newick_tree")
def newick_tree(s, d):
    return ordination.newick(ordination.neighbour_joining(_site_distances(s, d)))


@query("confidence_ellipses", BASE + """, x AS (SELECT grp, acctbal AS x, sum(reads) / 1000 AS y FROM f JOIN m USING (sample) GROUP BY sample, grp, acctbal),
a AS (SELECT grp, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM x GROUP BY 1 HAVING count(*) > 1),
e2 AS (SELECT *, sqrt((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b)) AS l, sqrt(greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 0)) AS s, atan2(2 * b, a - c) / 2 AS w FROM a)
SELECT grp, k::INT AS k, round(mx + sqrt(-2 * ln(0.05)) * (l * cos(2 * pi() * k / 99) * cos(w) - s * sin(2 * pi() * k / 99) * sin(w)), 3) AS x,
 round(my + sqrt(-2 * ln(0.05)) * (l * cos(2 * pi() * k / 99) * sin(w) + s * sin(2 * pi() * k / 99) * cos(w)), 3) AS y FROM e2, range(0, 100) r(k)""")
def confidence_ellipses(s, d):
    pts = features(s, d).groupBy("sample").agg((F.sum("reads") / 1000).alias("y")).join(metadata(s, d), "sample").select("grp", F.col("acctbal").cast("double").alias("x"), "y")
    out = ordination.ellipses(pts)
    return out.select("grp", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


_CORR = BASE + """, s AS (SELECT DISTINCT sample FROM p), t2 AS (SELECT DISTINCT taxon FROM p), d AS (SELECT sample, taxon, round(coalesce(pct, 0), 9) AS v FROM s CROSS JOIN t2 LEFT JOIN p USING (sample, taxon)),
r AS (SELECT sample, taxon, v, rank() OVER (PARTITION BY taxon ORDER BY v) + (count(*) OVER (PARTITION BY taxon, v) - 1) / 2.0 AS rk FROM d)
SELECT a.taxon AS a, b.taxon AS b, count(*) FILTER (WHERE a.v > 0 AND b.v > 0) AS both, round(corr(a.rk, b.rk), 6) AS rho FROM r a JOIN r b ON a.sample = b.sample AND a.taxon < b.taxon GROUP BY 1, 2
HAVING abs(corr(a.rk, b.rk)) >= {least}"""


def _network(s, d, least, most_p=None):
    return network.correlations(genus_counts(s, d).select("sample", "taxon", F.round("pct", 9).alias("value")), least, most_p)


@query("cooccurrence", _CORR.format(least=0.05))
def cooccurrence(s, d):
    return _rounded(_network(s, d, 0.05).drop("p"), "rho")


_CORR_P = "SELECT a, b, \"both\", rho, p FROM (SELECT *, " + beta_sql("x", "h", "0.5::DOUBLE") + " AS p FROM (SELECT *, (n - 2) / (n - 2 + rho * rho * (n - 2) / (1 - rho * rho)) AS x, (n - 2) / 2.0::DOUBLE AS h FROM (" + _CORR.format(least=0.05).replace("round(corr(a.rk, b.rk), 6)", "corr(a.rk, b.rk)") + ") c, (SELECT count(DISTINCT l_suppkey)::DOUBLE AS n FROM lineitem) k) u) w WHERE p <= 0.3"


@query("cooccurrence_p", "SELECT a, b, \"both\", round(rho, 6) AS rho, round(p, 6) AS p FROM (" + _CORR_P + ") y")
def cooccurrence_p(s, d):
    return _rounded(_network(s, d, 0.05, 0.3), "rho", "p")


@query("network_degrees", "SELECT taxon, count(*) AS degree, count(*) FILTER (WHERE rho > 0) AS positive FROM (SELECT a AS taxon, rho FROM (" + _CORR.format(least=0.05) + ") x UNION ALL SELECT b, rho FROM (" + _CORR.format(least=0.05) + ") y) z GROUP BY 1")
def network_degrees(s, d):
    return network.degrees(_network(s, d, 0.05))


_ROLES = """WITH e AS (SELECT a, b FROM (""" + _CORR.format(least=0.05) + """) x), o AS (SELECT a AS taxon, b AS other FROM e UNION ALL SELECT b, a FROM e),
k AS (SELECT taxon, substr(other, 1, 7) AS om, count(*)::DOUBLE AS k FROM o GROUP BY 1, 2), s AS (SELECT taxon, substr(taxon, 1, 7) AS module, sum(k) AS k, sum(k * k) AS kk FROM k GROUP BY 1),
r AS (SELECT taxon, module, coalesce((k - avg(k) OVER (PARTITION BY module)) / nullif(stddev_samp(k) OVER (PARTITION BY module), 0), 0) AS zi, 1 - kk / (k * k) AS pi FROM s)
SELECT taxon, module, round(zi, 6) AS zi, round(pi, 6) AS pi, CASE WHEN zi >= 2.5 AND pi >= 0.62 THEN 'network hub' WHEN zi >= 2.5 THEN 'module hub' WHEN pi >= 0.62 THEN 'connector' ELSE 'peripheral' END AS role FROM r"""


@query("network_roles", _ROLES)
def network_roles(s, d):
    modules = genus_counts(s, d).select("taxon").distinct().select("taxon", F.substring("taxon", 1, 7).alias("module"))
    return _rounded(network.roles(_network(s, d, 0.05), modules), "zi", "pi")
