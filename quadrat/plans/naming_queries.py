"""Queries on names from hits. An order is a query, its line items are hits on suppliers."""

from pyspark.sql import functions as F

from quadrat.operators import naming
from quadrat.plans.analogue import query, table

RANKS = ["class", "genus", "species"]
LIMITS = {"species": 97.0, "genus": 94.0}
_H = """WITH l AS (SELECT s_suppkey AS subject, r_name AS class, CASE WHEN s_suppkey % 7 <> 0 THEN n_name END AS genus, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT l_orderkey AS query, l_suppkey AS subject, l_linenumber AS line, round(100 * (1 - l_discount::DOUBLE), 2) AS pident, l_extendedprice::DOUBLE AS bitscore FROM lineitem) """


def _hits(s, d, *more):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("line"), F.round(100 * (1 - F.col("l_discount").cast("double")), 2).alias("pident"), F.col("l_extendedprice").cast("double").alias("bitscore"), F.lit(100.0).alias("qcov"), *more)


def _lineages(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return x.select(F.col("s_suppkey").alias("subject"), F.col("r_name").alias("class"), F.when(F.col("s_suppkey") % 7 != 0, F.col("n_name")).alias("genus"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("species"), F.lit("table").alias("source"), F.expr("cast(null as array<string>)").alias("species_all"))


_ASSIGN = _H + """, j AS (SELECT * FROM h JOIN l USING (subject)),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bitscore DESC, pident DESC, subject) AS r FROM j), b AS (SELECT query, pident AS top, class AS tc, genus AS tg, species AS ts FROM o WHERE r = 1),
z AS (SELECT query, any_value(top) AS top, any_value(tc) AS tc, any_value(tg) AS tg, any_value(ts) AS ts, count(DISTINCT class) AS nc, count(DISTINCT genus) AS ng, count(DISTINCT species) AS ns, min(class) AS c, min(genus) AS g, min(species) AS s,
  bool_or(class IS NULL) AS xc, bool_or(genus IS NULL) AS xg, bool_or(species IS NULL) AS xs FROM j JOIN b USING (query) WHERE pident >= top - 0.5 GROUP BY query),
d AS (SELECT *, CASE WHEN nc > 1 THEN 0 WHEN ns = 1 AND NOT xs THEN 3 WHEN ng = 1 AND NOT xg THEN 2 WHEN nc = 1 AND NOT xc THEN 1 ELSE 0 END AS depth FROM z),
a AS (SELECT query, top, ns, CASE WHEN depth > 0 THEN CASE WHEN nc = 1 THEN c ELSE tc END WHEN nc <= 1 THEN c END AS class,
  CASE WHEN top < 94 THEN NULL WHEN depth = 0 THEN CASE WHEN nc <= 1 AND ng <= 1 THEN g END WHEN depth >= 2 THEN CASE WHEN ng = 1 THEN g ELSE tg END END AS genus,
  CASE WHEN top < 97 THEN NULL WHEN depth = 0 THEN CASE WHEN nc <= 1 AND ng <= 1 AND ns <= 1 THEN s END WHEN depth >= 3 THEN s END AS species FROM d)
SELECT query, class, genus, species, top AS pident, ns::INT AS n_ties, CASE WHEN species IS NOT NULL THEN 'species' WHEN genus IS NOT NULL THEN 'genus' WHEN class IS NOT NULL THEN 'class' ELSE 'none' END AS rank_reached FROM a"""


@query("tie_names", _ASSIGN)
def tie_names(s, d):
    out = naming.assign(_hits(s, d), _lineages(s, d), limits=LIMITS, ranks=RANKS)
    return out.select("query", *RANKS, "pident", "n_ties", "rank_reached")


@query("first_hit_names", _H + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY line) AS r FROM h) SELECT query, subject, pident, class, CASE WHEN pident >= 94 THEN genus END AS genus, CASE WHEN pident >= 97 THEN species END AS species FROM r LEFT JOIN l USING (subject) WHERE r = 1")
def first_hit_names(s, d):
    # an order's lines may have equal numbers: their place in the file decides
    hits = _hits(s, d, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return naming.first_hit(hits, _lineages(s, d), ["line", "file", "row"], LIMITS, RANKS)


def _pick(rank):
    return f"{rank[0]} AS (SELECT query, name, n / a >= 0.8 AS ok FROM (SELECT query, {rank} AS name, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY query) AS a, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, {rank}) AS r FROM k WHERE {rank} IS NOT NULL GROUP BY 1, 2) x WHERE r = 1)"


@query("consensus_names", _H + ", b AS (SELECT *, max(pident) OVER (PARTITION BY query) AS best FROM h), k AS (SELECT * FROM b JOIN l USING (subject) WHERE pident >= best - 1.0), u AS (SELECT DISTINCT query, best FROM k), " + ", ".join(_pick(r) for r in RANKS) + """
SELECT query, best AS pident, CASE WHEN coalesce(c.ok, true) THEN c.name END AS class, CASE WHEN coalesce(c.ok, true) AND coalesce(g.ok, true) AND best >= 94 THEN g.name END AS genus,
CASE WHEN coalesce(c.ok, true) AND coalesce(g.ok, true) AND coalesce(s.ok, true) AND best >= 97 THEN s.name END AS species FROM u LEFT JOIN c USING (query) LEFT JOIN g USING (query) LEFT JOIN s USING (query)""")
def consensus_names(s, d):
    return naming.consensus(_hits(s, d), _lineages(s, d), within=1.0, limits=LIMITS, ranks=RANKS)


@query("ani_verdicts", "SELECT c_custkey AS id, CASE WHEN c_acctbal / 100 >= 96 THEN 'known' WHEN c_acctbal / 100 >= 94 THEN 'borderline' WHEN c_acctbal IS NOT NULL THEN 'novel' END AS verdict FROM customer")
def ani_verdicts(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal").cast("double") / 100).alias("ani")).select("id", naming.verdict("ani").alias("verdict"))
