"""Queries on filters, splits and picks."""

from pyspark.sql import functions as F

from quadrat.functions import sequences
from quadrat.operators import community, selection, stats
from quadrat.plans.analogue import BASE, features, genus_counts, metadata, mode, query, site_counts, table, taxonomy
from quadrat.plans.reads_queries import _SEQ, _sequences


@query("feature_split", BASE + """, k AS (SELECT sample, CASE WHEN genus = 'Brand#11' THEN 'host' ELSE 'community' END AS kind, reads FROM n)
SELECT sample, kind, sum(reads) AS reads, round(100 * sum(reads) / sum(sum(reads)) OVER (PARTITION BY sample), 6) AS pct FROM k GROUP BY 1, 2""")
def feature_split(s, d):
    named = community.with_taxonomy(features(s, d), taxonomy(s, d))
    return selection.split_reads(named, selection.feature_class(["phylum", "genus", "species"], ["Brand#11"])).withColumn("pct", F.round("pct", 6))


@query("reagent_reads", BASE + "SELECT sample, coalesce(sum(reads) FILTER (WHERE genus IN ('Brand#11', 'Brand#22')), 0) AS reagent, coalesce(sum(reads) FILTER (WHERE genus IS NULL), 0) AS unnamed, coalesce(sum(reads) FILTER (WHERE genus IS NOT NULL AND genus NOT IN ('Brand#11', 'Brand#22')), 0) AS own FROM n GROUP BY 1")
def reagent_reads(s, d):
    return selection.reagent_reads(community.with_taxonomy(features(s, d), taxonomy(s, d)), ["Brand#11", "Brand#22"])


@query("kept_unless_all_fail", "SELECT doc_id FROM (SELECT doc_id, n_chars BETWEEN 900 AND 950 AS ok, bool_or(n_chars BETWEEN 900 AND 950) OVER (PARTITION BY source) AS anywhere FROM documents) x WHERE ok OR NOT anywhere")
def kept_unless_all_fail(s, d):
    return selection.kept_unless_all_fail(table(s, d, "documents"), F.col("n_chars").between(900, 950), ["source"]).select("doc_id")


@query("mostly_present", "SELECT taxon FROM (SELECT l_partkey AS taxon, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1) x, (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem) y WHERE 1 - k / n::DOUBLE <= 0.75")
def mostly_present(s, d):
    return selection.mostly_present(features(s, d).withColumnRenamed("feature_id", "taxon"), 0.75)


@query("abundant_in_a_group", BASE + "SELECT DISTINCT taxon FROM (SELECT taxon, grp, sum(pct) / any_value(k) AS v FROM p JOIN m USING (sample) JOIN (SELECT grp, count(*) AS k FROM m GROUP BY 1) z USING (grp) GROUP BY 1, 2) x WHERE v >= 4")
def abundant_in_a_group(s, d):
    return selection.abundant_in_a_group(genus_counts(s, d), metadata(s, d).select("sample", "grp"), 4.0)


@query("run_subset", BASE + ", o AS (SELECT f.* FROM f JOIN m USING (sample) WHERE grp = 'ASIA'), r AS (SELECT feature_id, row_number() OVER (ORDER BY sum(reads) DESC, feature_id) AS k FROM o GROUP BY 1) SELECT sample, feature_id, reads, 'SV' || lpad(CAST(k AS VARCHAR), 6, '0') AS name FROM o JOIN r USING (feature_id)")
def run_subset(s, d):
    return selection.subset(features(s, d), metadata(s, d).where("grp = 'ASIA'"))


@query("usable_variables", """WITH l AS (SELECT 'c_mktsegment' AS variable, c_mktsegment AS level FROM customer UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer),
p AS (SELECT variable, level, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT variable, count(*) AS levels, sum(n) AS r, count(*) FILTER (WHERE n >= 2) AS f, bool_and(try_cast(level AS DOUBLE) IS NOT NULL) AS num FROM p GROUP BY 1)
SELECT variable, CASE WHEN num THEN 'number' ELSE 'factor' END AS kind, levels, CASE WHEN num THEN levels > 2 ELSE f >= 2 AND levels < r END AS usable FROM s""")
def usable_variables(s, d):
    return selection.usable_variables(table(s, d, "customer"), ["c_mktsegment", "c_name", "c_nationkey"])


@query("best_record", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS r FROM orders) x WHERE r = 1")
def best_record(s, d):
    return selection.best_of(table(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("near_best_record", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) w WHERE o_totalprice >= m - 50000) x WHERE r = 1")
def near_best_record(s, d):
    return selection.near_best(table(s, d, "orders"), ["o_custkey"], "o_totalprice", 50000.0, ["o_orderpriority", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("tree_ancestors", """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_size > 40 AS ok FROM part),
w AS (SELECT id, id AS node, ok, parent, 0 AS k FROM n UNION ALL SELECT w.id, n.id, n.ok, n.parent, k + 1 FROM w JOIN n ON n.id = w.parent WHERE NOT w.ok AND k < 5)
SELECT id, max(CASE WHEN ok THEN node END) AS ancestor FROM w GROUP BY 1""")
def tree_ancestors(s, d):
    n = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey DIV 2 END").alias("parent"), (F.col("p_size") > 40).alias("ok"))
    return selection.tree_ancestor(n, F.col("ok"))


@query("shared_lineages", "SELECT s AS seq, n, CASE WHEN a THEN p END AS phylum, CASE WHEN a AND b THEN g END AS genus FROM (SELECT p_name AS s, count(*) AS n, count(DISTINCT p_type) <= 1 AS a, count(DISTINCT p_brand) <= 1 AS b, min(p_type) AS p, min(p_brand) AS g FROM part GROUP BY 1) x")
def shared_lineages(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("seq"), F.col("p_type").alias("phylum"), F.col("p_brand").alias("genus"))
    return selection.shared_lineage(p, ["seq"], ["phylum", "genus"])


@query("clipped_lengths", "SELECT lang, round(100.0 * sum(CASE WHEN n_chars >= 4998 THEN 1 ELSE 0 END) / count(*), 6) AS near_pct, max(n_chars) AS longest, 100.0 * sum(CASE WHEN n_chars >= 4998 THEN 1 ELSE 0 END) / count(*) > 2 OR max(n_chars) >= 4999 AS clipped FROM documents GROUP BY 1")
def clipped_lengths(s, d):
    x = table(s, d, "documents").select("lang", F.col("n_chars").alias("length"), F.lit(1.0).alias("reads"))
    return selection.clipped(x, ["lang"], 5000).withColumn("near_pct", F.round("near_pct", 6))


@query("weighted_lengths", "SELECT length(p_name) AS length, sum(l_quantity)::DOUBLE AS reads FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def weighted_lengths(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.length("p_name").alias("length")).agg(F.sum("l_quantity").cast("double").alias("reads"))


_TOOLS = """WITH t AS (SELECT l_suppkey % 10 AS sample, p_brand AS taxon, l_linenumber <= 3 AS a, count(*)::DOUBLE AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
q AS (SELECT *, round(100 * n / sum(n) OVER (PARTITION BY sample, a), 9) AS pct FROM t), b AS (SELECT sample, taxon, coalesce(max(pct) FILTER (WHERE a), 0) AS x, coalesce(max(pct) FILTER (WHERE NOT a), 0) AS y FROM q GROUP BY 1, 2) """


def _two_tools(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = li.groupBy((F.col("l_suppkey") % 10).alias("sample"), F.col("p_brand").alias("taxon"), (F.col("l_linenumber") <= 3).alias("a")).agg(F.count("*").cast("double").alias("n"))
    q = community.with_share(t, ["sample", "a"], "n").withColumn("pct", F.round("pct", 9))
    return selection.agreement(q.where("a"), q.where("NOT a"))


@query("profile_agreement", _TOOLS + "SELECT sample, taxon, x, y FROM b")
def profile_agreement(s, d):
    return _two_tools(s, d)


@query("profile_correlation", _TOOLS + ", r AS (SELECT sample, rank() OVER (PARTITION BY sample ORDER BY x) + (count(*) OVER (PARTITION BY sample, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY sample ORDER BY y) + (count(*) OVER (PARTITION BY sample, y) - 1) / 2.0 AS ry FROM b) SELECT sample, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1")
def profile_correlation(s, d):
    return stats.spearman(_two_tools(s, d), ["sample"]).withColumn("rho", F.round("rho", 6))


@query("key_findings", "SELECT l_returnflag AS panel, r::INT AS rank, gene, most, carrier FROM (SELECT l_returnflag, p_brand AS gene, max(l_extendedprice) AS most, max(struct_pack(a := l_extendedprice, b := l_suppkey)).b AS carrier, row_number() OVER (PARTITION BY l_returnflag ORDER BY max(l_extendedprice) DESC, p_brand) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) x WHERE r <= 3")
def key_findings(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return selection.key_findings(li.select(F.col("l_returnflag").alias("panel"), F.col("p_brand").alias("gene"), F.col("l_suppkey").alias("carrier"), F.col("l_extendedprice").alias("value")), "panel", "gene", "carrier", "value").withColumn("rank", F.col("rank").cast("int"))


@query("joined_names", "SELECT l_orderkey, count(DISTINCT l_returnflag || l_linestatus) AS n, string_agg(DISTINCT l_returnflag || l_linestatus, ';' ORDER BY l_returnflag || l_linestatus) AS names FROM lineitem GROUP BY 1")
def joined_names(s, d):
    return selection.joined_names(table(s, d, "lineitem").withColumn("x", F.concat("l_returnflag", "l_linestatus")), ["l_orderkey"], "x")


@query("open_frames", _SEQ + ", z AS (SELECT doc_id, seq AS q, unnest([0, 1, 2]) AS f FROM x), w AS (SELECT doc_id, f, greatest(length(q) - f, 0) // 3 AS n, q FROM z) SELECT doc_id, sum(CASE WHEN n * 3 >= 150 AND len(list_filter(range(0, n), lambda k: substr(q, (k * 3 + f + 1)::INT, 3) IN ('TAA', 'TAG', 'TGA'))) = 0 THEN 1 ELSE 0 END)::INT AS frames FROM w GROUP BY 1")
def open_frames(s, d):
    return _sequences(s, d).select("doc_id", sequences.open_frames("seq", ["TAA", "TAG", "TGA"]).alias("frames"))


_ACCUMULATION = """WITH f AS (SELECT DISTINCT n_name AS sample, l_partkey AS feature_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 0),
p AS (SELECT o, sample, row_number() OVER (PARTITION BY o ORDER BY md5(sample || '-' || o || '-1'), sample) AS k FROM (SELECT DISTINCT sample FROM f) s, range(1, 101) r(o)),
w AS (SELECT o, k, count(*) AS new FROM (SELECT o, feature_id, min(k) AS k FROM f JOIN p USING (sample) GROUP BY 1, 2) x GROUP BY 1, 2),
s AS (SELECT p.o, p.k, sum(coalesce(new, 0)) OVER (PARTITION BY p.o ORDER BY p.k) AS seen FROM p LEFT JOIN w ON p.o = w.o AND p.k = w.k)
SELECT k AS samples, round(avg(seen), 6) AS mean, round(coalesce(stddev_samp(seen), 0), 6) AS sd FROM s GROUP BY 1"""


@query("accumulation", _ACCUMULATION)
def accumulation(s, d):
    out = selection.accumulation(features(s, d).join(metadata(s, d), "sample").select(F.col("site").alias("sample"), "feature_id", "reads"))
    return out.select(F.col("samples").cast("long").alias("samples"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("otu_counts", "SELECT l_partkey AS feature_id, 'M' || l_linenumber AS sample, count(*) AS reads FROM lineitem GROUP BY 1, 2")
def otu_counts(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), mode().alias("sample")).agg(F.count("*").alias("reads"))


@query("ternary_shares", BASE + ", v AS (SELECT taxon, sample, pct FROM g WHERE sample IN ('NATION_0', 'NATION_1', 'NATION_2')), w AS (SELECT taxon, sum(pct) AS total FROM v GROUP BY 1) SELECT taxon, sample, round(pct / total, 6) AS share FROM v JOIN w USING (taxon)")
def ternary_shares(s, d):
    v = site_counts(s, d).where(F.col("sample").isin("NATION_0", "NATION_1", "NATION_2"))
    return community.with_share(v, "taxon", "pct", "share").select("taxon", "sample", F.round(F.col("share") / 100, 6).alias("share"))


@query("subset_hits", BASE + "SELECT l.a AS agreement, count(*) AS features, sum(reads) AS reads FROM (SELECT feature_id, sum(reads) AS reads FROM f JOIN m USING (sample) WHERE grp = 'ASIA' GROUP BY 1) x JOIN (SELECT p_partkey AS feature_id, p_type AS a FROM part WHERE p_size > 5) l USING (feature_id) GROUP BY 1")
def subset_hits(s, d):
    own = features(s, d).join(metadata(s, d).where("grp = 'ASIA'").select("sample"), "sample", "left_semi")
    return selection.subset_hits(table(s, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("agreement")), own)


@query("feature_split_bacterial", BASE + """, k AS (SELECT sample, CASE WHEN genus = 'Brand#11' THEN 'host' WHEN phylum = 'ECONOMY' THEN 'eukaryote' ELSE 'community' END AS kind, reads FROM n)
SELECT sample, kind, sum(reads) AS reads, round(100 * sum(reads) / sum(sum(reads)) OVER (PARTITION BY sample), 6) AS pct FROM k GROUP BY 1, 2""")
def feature_split_bacterial(s, d):
    named = community.with_taxonomy(features(s, d), taxonomy(s, d)).withColumn("domain", F.when(F.col("phylum") == "ECONOMY", "Eukaryota").otherwise("Bacteria"))
    return selection.split_reads(named, selection.feature_class(["phylum", "genus", "species"], ["Brand#11"], "domain")).withColumn("pct", F.round("pct", 6))
