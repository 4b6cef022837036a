"""Queries on group comparisons."""

from pyspark.sql import functions as F

from quadrat.operators import stats as st
from quadrat.plans.analogue import BASE, ORACLES, genus_counts, metadata, mode, query, table

#: Per cent of each named genus in the samples that have it, by region; rounded so that ties are the same in both engines.
_VALUES = BASE + ", v AS (SELECT taxon, grp, round(pct, 6) AS value FROM p JOIN m USING (sample) WHERE taxon <> 'Unclassified') "
_RANKED = _VALUES + ", r AS (SELECT *, rank() OVER (PARTITION BY taxon ORDER BY value) + (count(*) OVER (PARTITION BY taxon, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY taxon, value) AS t FROM v) "


def _values(s, d):
    return genus_counts(s, d).where("taxon <> 'Unclassified'").join(metadata(s, d).select("sample", "grp"), "sample").select("taxon", "grp", F.round("pct", 6).alias("value"))


_KW = _RANKED + """, g1 AS (SELECT taxon, grp, count(*) AS m, sum(r) AS s, sum(t * t - 1) AS ties FROM r GROUP BY 1, 2), g2 AS (SELECT taxon, sum(m)::DOUBLE AS n, count(*) AS k, sum(s * s / m) AS ss, sum(ties)::DOUBLE AS ties FROM g1 GROUP BY 1)
"""
_H = "(12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n))"


@query("kruskal_wallis", _KW + f"SELECT taxon, n::BIGINT AS n, k, round({_H}, 5) AS h, k - 1 AS df FROM g2")
def kruskal_wallis(s, d):
    return st.kruskal(_values(s, d), ["taxon"]).withColumn("h", F.round("h", 5))


def chi2_sql(x: str, df: str) -> str:
    """Upper tail of the chi-square distribution in SQL, by the power series of the incomplete gamma function."""
    terms = f"list_sum(list_transform(range(0, 600), lambda i: exp(i * ln({x} / 2.0) - lgamma({df} / 2.0 + i + 1))))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1 ELSE greatest(1 - exp({df} / 2.0 * ln({x} / 2.0) - {x} / 2.0) * {terms}, 0) END"


def beta_sql(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta function in SQL, by its power series on the side that converges faster."""

    def own(x, a, b):
        terms = f"list_sum(list_transform(range(0, 1500), lambda i: exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x}))))"
        return f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a} * {terms}"

    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 1 WHEN {x} <= ({a} + 1) / ({a} + {b} + 2) THEN {own(x, a, b)} ELSE 1 - {own(f'(1 - {x})', b, a)} END"


def adjusted_sql(tests: str, columns: str, by: str = "") -> str:
    """Columns, p and q of tests with a column p, adjusted within by."""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}p"
    return f"""SELECT {columns}, round(p, 6) AS p, round(CASE WHEN p IS NULL THEN NULL ELSE least(1, min(p * n / r) OVER ({part} ORDER BY p DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END, 6) AS q
FROM (SELECT *, rank() OVER ({part} ORDER BY p NULLS LAST) + count(*) OVER ({tie}) - 1 AS r, count(p) OVER ({part}) AS n FROM ({tests}) a) b"""


@query("kruskal_p", _KW + f", h AS (SELECT taxon, k, {_H} AS h, k - 1 AS df FROM g2 WHERE k >= 2 AND n > k AND 1 - ties / (n * n * n - n) > 1e-15 UNION ALL SELECT taxon, k, NULL, k - 1 FROM g2 WHERE k >= 2 AND NOT (n > k AND 1 - ties / (n * n * n - n) > 1e-15)) SELECT taxon, k, round({chi2_sql('h', 'df')}, 6) AS p FROM h")
def kruskal_p(s, d):
    return st.kruskal(_values(s, d), ["taxon"]).where("k >= 2").select("taxon", "k", F.round(st.chi2_p(F.col("h"), F.col("df")), 6).alias("p"))


@query("anova", _VALUES + """, g1 AS (SELECT taxon, grp, count(*) AS m, sum(value) AS s, sum(value * value) AS q FROM v GROUP BY 1, 2), g2 AS (SELECT taxon, sum(m) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / m) AS b FROM g1 GROUP BY 1)
SELECT taxon, round(((b - s * s / n) / nullif(k - 1, 0)) / nullif(greatest(q - b, 0) / nullif(n - k, 0), 0), 4) AS f, (k - 1)::BIGINT AS df1, (n - k)::BIGINT AS df2 FROM g2""")
def anova(s, d):
    return st.anova(_values(s, d), ["taxon"]).withColumn("f", F.round("f", 4))


_WELCH = _VALUES + """, x AS (SELECT taxon, grp, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM v GROUP BY 1, 2)
SELECT a.taxon, a.grp AS grp_a, b.grp AS grp_b, round(a.mean - b.mean, 5) AS diff, CASE WHEN a.n > 1 AND b.n > 1 THEN round((a.mean - b.mean) / nullif(sqrt(a.var / a.n + b.var / b.n), 0), 4) END AS t,
CASE WHEN a.n > 1 AND b.n > 1 THEN round((a.var / a.n + b.var / b.n) ** 2 / nullif((a.var / a.n) ** 2 / (a.n - 1) + (b.var / b.n) ** 2 / (b.n - 1), 0), 4) END AS df FROM x a JOIN x b ON a.taxon = b.taxon AND a.grp < b.grp"""


@query("welch_t", _WELCH)
def welch_t(s, d):
    return st.welch(_values(s, d), ["taxon"]).select("taxon", "grp_a", "grp_b", F.round("diff", 5).alias("diff"), F.round("t", 4).alias("t"), F.round("df", 4).alias("df"))


@query("wilcoxon", _VALUES + """, y AS (SELECT DISTINCT taxon, grp FROM v), pr AS (SELECT a.taxon, a.grp AS grp_a, b.grp AS grp_b FROM y a JOIN y b ON a.taxon = b.taxon AND a.grp < b.grp),
z AS (SELECT pr.*, v.grp, value FROM pr JOIN v ON v.taxon = pr.taxon AND (v.grp = grp_a OR v.grp = grp_b)),
r AS (SELECT *, rank() OVER (PARTITION BY taxon, grp_a, grp_b ORDER BY value) + (count(*) OVER (PARTITION BY taxon, grp_a, grp_b, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY taxon, grp_a, grp_b, value) AS t FROM z),
q AS (SELECT taxon, grp_a, grp_b, sum(r) FILTER (WHERE grp = grp_a) AS s, count(*) FILTER (WHERE grp = grp_a)::DOUBLE AS na, count(*) FILTER (WHERE grp = grp_b)::DOUBLE AS nb, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1, 2, 3),
u AS (SELECT *, s - na * (na + 1) / 2 AS w FROM q)
SELECT taxon, grp_a, grp_b, w, round((w - na * nb / 2 - sign(w - na * nb / 2) * 0.5) / nullif(sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 0), 5) AS z FROM u""")
def wilcoxon(s, d):
    return st.wilcoxon(_values(s, d), ["taxon"]).withColumn("z", F.round("z", 5))


@query("benjamini_hochberg", """WITH x AS (SELECT o_orderkey AS id, (o_orderkey % 997 + 1) / 1000.0::DOUBLE AS p FROM orders),
r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS n FROM x)
SELECT id, round(least(1, min(p * n / r) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM r""")
def benjamini_hochberg(s, d):
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 997 + 1) / 1000).alias("p"))
    return st.benjamini_hochberg(x).select("id", F.round("q", 9).alias("q"))


@query("spearman", """WITH x AS (SELECT 'M' || l_linenumber AS grp, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y FROM lineitem), r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry FROM x)
SELECT grp, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def spearman(s, d):
    x = table(s, d, "lineitem").select(mode().alias("grp"), F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    return st.spearman(x, ["grp"]).withColumn("rho", F.round("rho", 6))


@query("effect_scores", _VALUES + """, w AS (SELECT taxon, grp, log10(value + 0.01) AS v FROM v), g1 AS (SELECT taxon, grp, count(*) AS m, sum(v) AS s, sum(v * v) AS q FROM w GROUP BY 1, 2), g2 AS (SELECT taxon, sum(m) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / m) AS b FROM g1 GROUP BY 1)
SELECT taxon, CASE WHEN q - b > 1e-12 THEN round(3 * log10(1 + greatest(b - s * s / n, 0) / (q - b)), 5) END AS score FROM g2""")
def effect_scores(s, d):
    return st.effect_score(_values(s, d), ["taxon"]).withColumn("score", F.round("score", 5))


_X = _WELCH.replace("round(a.mean - b.mean, 5) AS diff", "a.mean - b.mean AS diff").replace("round((a.mean - b.mean) / nullif(sqrt(a.var / a.n + b.var / b.n), 0), 4)", "(a.mean - b.mean) / nullif(sqrt(a.var / a.n + b.var / b.n), 0)").replace("round((a.var / a.n + b.var / b.n) ** 2 / nullif((a.var / a.n) ** 2 / (a.n - 1) + (b.var / b.n) ** 2 / (b.n - 1), 0), 4)", "(a.var / a.n + b.var / b.n) ** 2 / nullif((a.var / a.n) ** 2 / (a.n - 1) + (b.var / b.n) ** 2 / (b.n - 1), 0)")
_T = beta_sql("x", "a", "b")


@query("welch_p", adjusted_sql(f"SELECT taxon, grp_a, grp_b, {_T} AS p FROM (SELECT *, df / (df + t * t) AS x, df / 2 AS a, 0.5::DOUBLE AS b FROM ({_X}) u) v", "taxon, grp_a, grp_b"))
def welch_p(s, d):
    w = st.welch(_values(s, d), ["taxon"])
    out = st.benjamini_hochberg(w.withColumn("p", st.t_p(F.col("t"), F.col("df"))))
    return out.select("taxon", "grp_a", "grp_b", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


_F = _VALUES + """, g1 AS (SELECT taxon, grp, count(*) AS m, sum(value) AS s, sum(value * value) AS q FROM v GROUP BY 1, 2), g2 AS (SELECT taxon, sum(m)::DOUBLE AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / m) AS b FROM g1 GROUP BY 1)
SELECT taxon, ((b - s * s / n) / nullif(k - 1, 0)) / nullif(greatest(q - b, 0) / nullif(n - k, 0), 0) AS f, (k - 1)::DOUBLE AS df1, n - k AS df2 FROM g2"""


@query("anova_p", adjusted_sql(f"SELECT taxon, CASE WHEN f <= 0 THEN 1 ELSE {_T} END AS p FROM (SELECT *, df2 / (df2 + df1 * f) AS x, df2 / 2 AS a, df1 / 2 AS b FROM ({_F}) u) v", "taxon"))
def anova_p(s, d):
    a = st.anova(_values(s, d), ["taxon"])
    out = st.benjamini_hochberg(a.withColumn("p", st.f_p(F.col("f"), F.col("df1"), F.col("df2"))))
    return out.select("taxon", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


_Z = ORACLES["wilcoxon"].replace("w, round((w", "((w").replace(", 0), 5) AS z", ", 0)) AS z")


@query("wilcoxon_p", adjusted_sql(f"SELECT taxon, grp_a, grp_b, {chi2_sql('x', '1')} AS p FROM (SELECT *, z * z AS x FROM ({_Z}) u) v", "taxon, grp_a, grp_b", "grp_a, grp_b"))
def wilcoxon_p(s, d):
    w = st.wilcoxon(_values(s, d), ["taxon"])
    out = st.benjamini_hochberg(w.withColumn("p", st.normal_p(F.col("z"))), by=["grp_a", "grp_b"])
    return out.select("taxon", "grp_a", "grp_b", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))
