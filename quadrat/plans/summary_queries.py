"""Queries on result tables: tests with marks, shares, profiles, depth and peaks."""

from pyspark.sql import functions as F

from quadrat.operators import community, network, summaries
from quadrat.operators import reads as rd
from quadrat.plans.analogue import BASE, ORACLES, features, mode, query, site_counts, site_groups, table, taxonomy
from quadrat.plans.diversity_queries import _network
from quadrat.plans.reads_queries import _P, _SEQ, _as_reads, _sequences
from quadrat.plans.stats_queries import _VALUES, _values

_TOP = ", top AS (SELECT taxon FROM v GROUP BY 1 ORDER BY sum(value) DESC, taxon LIMIT {n}) "


@query("kruskal_table", "SELECT (row_number() OVER (ORDER BY p NULLS LAST, taxon))::INT AS place, taxon, p, CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS sig FROM (" + ORACLES["kruskal_p"] + ") k JOIN (" + _VALUES + _TOP.format(n=10) + "SELECT taxon FROM top) t USING (taxon)")
def kruskal_table(s, d):
    return summaries.kruskal_table(_values(s, d), 10).withColumn("place", F.col("place").cast("int"))


_MOM = ", mo AS (SELECT taxon, grp, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value) / sqrt(count(*)), 0) AS se FROM v GROUP BY 1, 2), pr AS (SELECT a.taxon, a.grp AS grp_a, b.grp AS grp_b, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, a.se AS se_a, b.mean AS mean_b, b.se AS se_b FROM mo a JOIN mo b ON a.taxon = b.taxon AND a.grp < b.grp) "
_NUM = ["mean_a", "se_a", "mean_b", "se_b"]


def _rounded(df, *names):
    return df.select(*(F.round(c, 5).alias(c) if c in names else c for c in df.columns))


@query("wilcoxon_table", "SELECT taxon, grp_a, grp_b, " + ", ".join(f"round({c}, 5) AS {c}" for c in _NUM) + ", round(mean_a - mean_b, 5) AS diff, round(mean_a - mean_b - 1.96 * sqrt(se_a ** 2 + se_b ** 2), 5) AS low, round(mean_a - mean_b + 1.96 * sqrt(se_a ** 2 + se_b ** 2), 5) AS high FROM (" + _VALUES + _TOP.format(n=10) + _MOM + "SELECT pr.* FROM pr JOIN top USING (taxon)) x")
def wilcoxon_table(s, d):
    return _rounded(summaries.wilcoxon_table(_values(s, d), 10), *_NUM, "diff", "low", "high").drop("p", "q")


_WP = ORACLES["welch_p"]


@query("welch_table", "SELECT taxon, grp_a, grp_b, " + ", ".join(f"round({c}, 5) AS {c}" for c in _NUM) + ", p, place::INT AS place FROM (SELECT w.*, " + ", ".join(_NUM) + ", row_number() OVER (PARTITION BY w.grp_a, w.grp_b ORDER BY w.p NULLS LAST, w.taxon) AS place FROM (" + _WP + ") w JOIN (" + _VALUES + _MOM + "SELECT * FROM pr WHERE n_a >= 2 AND n_b >= 2) z ON z.taxon = w.taxon AND z.grp_a = w.grp_a AND z.grp_b = w.grp_b) y WHERE place <= 5")
def welch_table(s, d):
    t = summaries.welch_table(_values(s, d), 5).drop("q").withColumn("p", F.round("p", 6)).withColumn("place", F.col("place").cast("int"))
    return _rounded(t, *_NUM)


@query("discriminating_taxa", "SELECT taxon, grp, score, p FROM (" + ORACLES["effect_scores"] + ") e JOIN (" + ORACLES["kruskal_p"] + ") k USING (taxon) JOIN (SELECT taxon, max(struct_pack(m := m, grp := grp)).grp AS grp FROM (" + _VALUES + "SELECT taxon, grp, avg(value) AS m FROM v GROUP BY 1, 2) x GROUP BY 1) b USING (taxon) WHERE p < 0.7 AND score >= 0.01")
def discriminating_taxa(s, d):
    return summaries.discriminating(_values(s, d), 0.7, 0.01).withColumn("score", F.round("score", 5)).withColumn("p", F.round("p", 6))


@query("assigned_shares", BASE + ", l AS (SELECT 'phylum' AS rank, phylum AS name, reads FROM n UNION ALL SELECT 'genus', genus, reads FROM n UNION ALL SELECT 'species', species, reads FROM n) SELECT rank, name, round(100 * sum(reads) / sum(sum(reads)) OVER (PARTITION BY rank), 6) AS pct FROM l WHERE name IS NOT NULL GROUP BY 1, 2")
def assigned_shares(s, d):
    return summaries.assigned_shares(community.with_taxonomy(features(s, d), taxonomy(s, d)), ["phylum", "genus", "species"]).withColumn("pct", F.round("pct", 6))


@query("kingdom_check", BASE + ", k AS (SELECT reads, phylum AS kingdom, CASE WHEN feature_id % 11 = 0 THEN 'Chloroplast' END AS o, CASE WHEN feature_id % 13 = 0 THEN 'Mitochondria' END AS f FROM n), q AS (SELECT reads, coalesce(o = 'Chloroplast', false) OR coalesce(f = 'Mitochondria', false) AS org, kingdom FROM k) SELECT sum(reads) AS reads, round(100 * sum(reads) FILTER (WHERE org OR kingdom NOT IN ('PROMO', 'ECONOMY')) / sum(reads), 6) AS off_pct, round(100 * sum(reads) FILTER (WHERE org) / sum(reads), 6) AS organelle_pct, 0.0::DOUBLE AS unassigned_pct, 100 * sum(reads) FILTER (WHERE org OR kingdom NOT IN ('PROMO', 'ECONOMY')) / sum(reads) >= 10 AS warn FROM q")
def kingdom_check(s, d):
    n = community.with_taxonomy(features(s, d), taxonomy(s, d)).select("reads", F.col("phylum").alias("kingdom"), F.when(F.col("feature_id") % 11 == 0, "Chloroplast").alias("order"), F.when(F.col("feature_id") % 13 == 0, "Mitochondria").alias("family"))
    out = summaries.kingdom_check(n, ["PROMO", "ECONOMY"])
    return out.select("reads", *(F.round(c, 6).alias(c) for c in ("off_pct", "organelle_pct", "unassigned_pct")), "warn")


@query("agglomerated", BASE + ", k AS (SELECT feature_id FROM f GROUP BY 1 ORDER BY sum(reads) DESC, feature_id LIMIT 100) SELECT sample, phylum, genus, sum(reads) AS reads FROM n JOIN k USING (feature_id) GROUP BY 1, 2, 3")
def agglomerated(s, d):
    return summaries.agglomerated(community.with_taxonomy(features(s, d), taxonomy(s, d)), ["phylum", "genus"], most=100)


@query("ternary_groups", BASE + """, gr AS (SELECT DISTINCT site AS sample, grp FROM m), z AS (SELECT grp, count(*) AS n FROM gr GROUP BY 1), mn AS (SELECT taxon, z.grp, sum(pct) / any_value(n) AS mean FROM g JOIN gr USING (sample) JOIN z ON z.grp = gr.grp GROUP BY 1, 2), kp AS (SELECT taxon FROM mn GROUP BY 1 ORDER BY sum(mean) DESC, taxon LIMIT 20),
cb AS (SELECT a.grp || '|' || b.grp || '|' || c.grp AS combo, [a.grp, b.grp, c.grp] AS gs FROM z a, z b, z c WHERE a.grp < b.grp AND b.grp < c.grp ORDER BY a.grp, b.grp, c.grp LIMIT 3), x AS (SELECT combo, taxon, u.grp, coalesce(mean, 0) AS mean FROM (SELECT combo, unnest(gs) AS grp FROM cb) u CROSS JOIN kp LEFT JOIN mn USING (taxon, grp))
SELECT combo, taxon, grp, round(100 * mean / CASE WHEN sum(mean) OVER (PARTITION BY combo, taxon) = 0 THEN 1 ELSE sum(mean) OVER (PARTITION BY combo, taxon) END, 6) AS share FROM x""")
def ternary_groups(s, d):
    return summaries.ternary(site_counts(s, d), site_groups(s, d)).withColumn("share", F.round("share", 6))


@query("host_share", "SELECT round(100.0::DOUBLE * (sum(l_linenumber) + sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)) / sum(l_quantity), 6) AS pct FROM lineitem")
def host_share(s, d):
    t = table(s, d, "lineitem").select(F.col("l_quantity").alias("after_qc"), F.col("l_linenumber").alias("host_removed"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("host_classified"))
    return summaries.host_share(t).withColumn("pct", F.round("pct", 6))


@query("genes_by_bin", "SELECT CASE WHEN o_orderkey IS NULL THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS bin, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS genes FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 > 0) o ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' GROUP BY 1")
def genes_by_bin(s, d):
    g = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("contig"), F.col("p_brand").alias("gene"), F.col("l_returnflag").alias("type"))
    return summaries.genes_by_bin(g, table(s, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("contig"), F.col("o_custkey").alias("bin")), "A")


_CLS = "WITH c AS (SELECT o_custkey AS genome, o_orderkey AS contig, floor(o_totalprice * 5)::BIGINT AS length, o_orderkey % 3 = 0 AS circular, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice * 5) DESC, o_orderkey) AS r FROM orders), k AS (SELECT *, CASE WHEN r = 1 AND length >= 1000000 THEN 'chromosome' WHEN circular AND length < 1000000 THEN 'plasmid?' ELSE 'contig' END AS type FROM c) "


def _classes(s, d):
    c = table(s, d, "orders").select(F.col("o_custkey").alias("genome"), F.col("o_orderkey").alias("contig"), F.floor(F.col("o_totalprice") * 5).cast("long").alias("length"), (F.col("o_orderkey") % 3 == 0).alias("circular"))
    return summaries.contig_classes(c, ["genome"])


@query("contig_classes", _CLS + "SELECT genome, contig, length, circular, type FROM k")
def contig_classes(s, d):
    return _classes(s, d)


@query("closed_counts", _CLS + "SELECT genome, count(*) FILTER (WHERE circular) AS circular, bool_or(circular AND type = 'chromosome') AS chromosome_closed FROM k GROUP BY 1")
def closed_counts(s, d):
    return summaries.closed_counts(_classes(s, d), ["genome"])


@query("strain_verdicts", "SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'unknown' WHEN 91 + p_size / 8.0 >= 96 OR (91 + p_size / 8.0 >= 95 AND p_size % 2 = 0) THEN 'known' WHEN 91 + p_size / 8.0 >= 95 THEN 'borderline' ELSE 'novel' END AS verdict, CASE WHEN p_size * 2 >= 79 THEN 'belongs to known species' WHEN p_size * 2 >= 70 THEN 'belongs to known species, potential new subspecies' ELSE 'potential new species' END AS ddh, 97 + p_size / 25.0 < 98.65 AS new_by_rrna FROM part")
def strain_verdicts(s, d):
    n = F.col("p_size")
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(n % 10 > 0, 91 + n / 8).alias("ani"), F.when(n % 2 == 0, 0.995).otherwise(0.9).alias("tetra"), (n * 2).alias("d4"), (97 + n / 25).alias("rrna"))
    return p.select("id", summaries.strain_verdict("ani", "tetra").alias("verdict"), summaries.hybridisation_verdict("d4").alias("ddh"), summaries.rrna_novelty("rrna").alias("new_by_rrna"))


@query("base_quality_share", _P + "SELECT file, round(100.0::DOUBLE * sum(n) FILTER (WHERE q >= 30) / sum(n), 6) AS pct FROM c GROUP BY 1")
def base_quality_share(s, d):
    return summaries.base_quality_share(rd.position_quality(_as_reads(s, d))).withColumn("pct", F.round("pct", 6))


@query("weighted_gc", _SEQ + "SELECT lang AS file, round(100.0::DOUBLE * sum(length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / sum(length(seq)), 6) AS gc FROM x GROUP BY 1")
def weighted_gc(s, d):
    from quadrat.functions import sequences as sq

    t = _sequences(s, d).select(F.col("lang").alias("file"), F.length("seq").alias("length"), sq.gc_percent("seq").alias("gc"))
    return summaries.weighted_gc(t, ["file"]).withColumn("gc", F.round("gc", 6))


_CUT = "WITH q AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey % 40 AS median FROM orders), w AS (SELECT *, (median + lead(median, 1) OVER o + lead(median, 2) OVER o) AS three, list_sort([median, lead(median, 1) OVER o, lead(median, 2) OVER o])[2] AS mid FROM q WINDOW o AS (PARTITION BY file ORDER BY pos)), c AS (SELECT file, greatest(0, coalesce(min(pos) FILTER (WHERE three IS NOT NULL AND mid < 15), count(*)) - 1)::BIGINT AS cut FROM w GROUP BY 1) "


def _cuts(s, d):
    from pyspark.sql import Window

    q = table(s, d, "orders").select(F.col("o_custkey").alias("file"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pos"), (F.col("o_orderkey") % 40).alias("median"))
    return summaries.quality_cut(q, ["file"], 1, 15.0, 3)


@query("quality_cuts", _CUT + "SELECT file, cut FROM c")
def quality_cuts(s, d):
    return _cuts(s, d)


@query("truncations", _CUT + """, x AS (SELECT file, cut AS cf, file % 7 AS cr, cut + file % 9 AS lf, file % 7 + file % 5 AS lr, CASE WHEN file % 4 > 0 THEN 10 END AS ins FROM c), y AS (SELECT *, greatest(ins + 4 - cf - cr, 0) AS short FROM x), z AS (SELECT *, least(lf - cf, (short + 1) // 2) AS half FROM y), u AS (SELECT *, least(lr - cr, short - half) AS ar FROM z), t AS (SELECT *, least(lf - cf, short - ar) AS af FROM u)
SELECT file, CASE WHEN ins IS NULL THEN cf ELSE cf + af END AS forward, CASE WHEN ins IS NULL THEN cr ELSE cr + ar END AS reverse, coalesce(cf + af + cr + ar >= ins + 4, true) AS ok FROM t""")
def truncations(s, d):
    k, cut = F.col("file"), F.col("cut")
    return _cuts(s, d).select("file", summaries.truncation(cut, k % 7, cut + k % 9, k % 7 + k % 5, F.when(k % 4 > 0, 10), 4).alias("t")).select("file", "t.*")


@query("separated_peaks")
def separated_peaks(s, d):
    h = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.col("l_quantity").cast("int").alias("at")).agg(F.count("*").alias("count"))
    return summaries.separated_peaks(h, ["sample"], 0.01)


@query("until_total_without_outliers", """WITH v AS (SELECT o_custkey % 50 AS run, o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS value FROM orders), m AS (SELECT *, median(value) OVER (PARTITION BY run) AS md, count(*) OVER (PARTITION BY run) AS k FROM v), n AS (SELECT *, value <= 20 * md AS ok FROM m),
s AS (SELECT *, sum(value) FILTER (WHERE ok) OVER (PARTITION BY run) AS sm, bool_and(ok) OVER (PARTITION BY run) AS al FROM n), u AS (SELECT * FROM s WHERE ok OR NOT (k >= 3 AND NOT al AND coalesce(sm >= 0.1 * 1000000, false))), r AS (SELECT *, sum(value) OVER (PARTITION BY run ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM u)
SELECT run, o_orderkey, round(running, 2) AS running FROM r WHERE running - value < 1000000""")
def until_total_without_outliers(s, d):
    v = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("run"), "o_orderkey", F.when(F.col("o_orderkey") % 30 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice")).alias("value"))
    return summaries.until_total_without_outliers(v, ["run"], ["o_orderkey"], "value", 1e6).select("run", "o_orderkey", F.round("running", 2).alias("running"))


_DEPTH = "WITH x AS (SELECT c_nationkey AS ref, c_custkey AS pos, c_custkey % 17 AS depth, 2000 AS length FROM customer) "


def _depths(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(F.col("c_nationkey").alias("ref"), k.alias("pos"), (k % 17).alias("depth"), F.lit(2000).alias("length"))


@query("depth_bins", _DEPTH + ", y AS (SELECT *, (row_number() OVER (PARTITION BY ref ORDER BY pos) - 1) // 5 AS b FROM x) SELECT ref, min(pos) AS \"start\", round(avg(depth), 6) AS mean_depth FROM y GROUP BY ref, b")
def depth_bins(s, d):
    return summaries.depth_bins(_depths(s, d), ["ref"], 5).withColumn("mean_depth", F.round("mean_depth", 6))


@query("depth_summary", _DEPTH + """, r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pos) AS n FROM x), z AS (SELECT *, n - row_number() OVER (PARTITION BY ref ORDER BY pos) AS g FROM r WHERE depth <= 4), w AS (SELECT ref, g, max(pos) - min(pos) + 1 AS len FROM z GROUP BY 1, 2), a AS (SELECT ref, count(*) AS k, sum(len)::BIGINT AS bp FROM w WHERE len >= 5 GROUP BY 1)
SELECT ref, round(sum(depth) / 2000.0::DOUBLE, 1) AS mean_depth, round(100.0::DOUBLE * count(*) FILTER (WHERE depth >= 1) / 2000, 2) AS breadth_1x, round(100.0::DOUBLE * count(*) FILTER (WHERE depth >= 10) / 2000, 2) AS breadth_10x, coalesce(any_value(k), 0) AS absent_regions, coalesce(any_value(bp), 0) AS absent_bp FROM x LEFT JOIN a USING (ref) GROUP BY 1""")
def depth_summary(s, d):
    return summaries.depth_summary(_depths(s, d), ["ref"], "length", 4, 5)


@query("species_totals", BASE + ", k AS (SELECT species, sum(reads) AS reads FROM n WHERE species IS NOT NULL GROUP BY 1) SELECT species, reads, round(100 * reads / (SELECT sum(reads) FROM n), 6) AS pct FROM k")
def species_totals(s, d):
    n = community.with_taxonomy(features(s, d), taxonomy(s, d))
    return summaries.species_totals(n).withColumn("pct", F.round("pct", 6))


@query("catalogue_families", """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, CASE WHEN p_size % 3 = 0 THEN 's' || p_partkey || '_gen' ELSE '' END AS symbol, CASE WHEN p_size > 40 THEN p_type ELSE '' END AS type, p_size % 5 AS reportable FROM part),
w AS (SELECT id, type, parent, 0 AS k FROM n UNION ALL SELECT w.id, n.type, n.parent, k + 1 FROM w JOIN n ON n.id = w.parent WHERE w.type = '' AND k < 5), t AS (SELECT id, max(type) AS type FROM w GROUP BY 1)
SELECT DISTINCT l_partkey * 10 + l_linenumber AS tname, l_partkey AS family, CASE WHEN symbol = '' THEN CAST(n.id AS VARCHAR) ELSE regexp_replace(symbol, '_gen$', '') END AS symbol, t.type FROM lineitem JOIN n ON n.id = l_partkey JOIN t ON t.id = n.id WHERE reportable > 0""")
def catalogue_families(s, d):
    k = F.col("p_partkey")
    nodes = table(s, d, "part").select(k.alias("id"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey DIV 2 END").alias("parent"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("s"), k.cast("string"), F.lit("_gen"))).otherwise("").alias("symbol"), F.when(F.col("p_size") > 40, F.col("p_type")).otherwise("").alias("type"), (F.col("p_size") % 5).alias("reportable"))
    return summaries.catalogue_families(table(s, d, "lineitem").select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("tname"), F.col("l_partkey").alias("node")).distinct(), nodes)


@query("numbered_sequences", "WITH f AS (SELECT 'M' || l_linenumber AS sample, p_name AS seq, sum(l_quantity) AS reads FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT seq, 'ASV' || row_number() OVER (ORDER BY sum(reads) DESC, seq) AS feature_id FROM f GROUP BY 1) SELECT sample, feature_id, reads FROM f JOIN r USING (seq)")
def numbered_sequences(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return summaries.numbered_sequences(li.groupBy(mode().alias("sample"), F.col("p_name").alias("feature_id")).agg(F.sum("l_quantity").alias("reads")))[0]


@query("content_keys", "SELECT o_orderkey, md5('=' || o_custkey || chr(31) || '=' || o_orderstatus) AS key FROM orders")
def content_keys(s, d):
    return table(s, d, "orders").select("o_orderkey", summaries.content_key(["o_custkey", "o_orderstatus"]).alias("key"))


@query("network_modules")
def network_modules(s, d):
    return network.modules(_network(s, d, 0.05))
