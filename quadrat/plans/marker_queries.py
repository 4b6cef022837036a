"""Queries on controls, markers, groups and functions."""

from pyspark.sql import functions as F

from quadrat.operators import controls, markers
from quadrat.plans.analogue import BASE, features, genus_counts, metadata, mode, query, site_counts, site_groups, table, taxonomy
from quadrat.plans.stats_queries import chi2_sql

_ATTRS = """WITH a AS (SELECT s_suppkey AS sample, CASE s_suppkey % 5 WHEN 0 THEN 'blank' WHEN 1 THEN 'mock' WHEN 2 THEN '' ELSE 'soil' END AS word, CASE WHEN s_suppkey % 3 > 0 THEN n_name ELSE ' ' END AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey) """


def _attrs(s, d):
    k = F.col("sample")
    word = F.when(k % 5 == 0, " Blank").when(k % 5 == 1, "MOCK").when(k % 5 == 2, "").otherwise("soil")
    return metadata(s, d).select("sample", F.create_map(F.lit("Sample_Type"), word, F.lit("control"), F.lit(""), F.lit("Group"), F.when(k % 3 > 0, F.col("site")).otherwise(" ")).alias("attrs"))


@query("control_kinds", _ATTRS + "SELECT sample, CASE WHEN sample IN (7, 8) THEN 'negative' WHEN sample = 9 THEN 'mock' WHEN word = 'blank' THEN 'negative' ELSE 'mock' END AS kind FROM a WHERE sample IN (7, 8, 9) OR word IN ('blank', 'mock')")
def control_kinds(s, d):
    return controls.control_kinds(_attrs(s, d), [7, 8], [9])


@query("tested_groups", _ATTRS + "SELECT sample, grp FROM a WHERE word NOT IN ('blank', 'mock') AND trim(grp) <> ''")
def tested_groups(s, d):
    return controls.tested_groups(_attrs(s, d))


@query("drawn_samples", _ATTRS + "SELECT sample, grp FROM a WHERE word <> 'blank' AND trim(grp) <> ''")
def drawn_samples(s, d):
    a = _attrs(s, d)
    return controls.drawn_samples(a, controls.control_kinds(a).where("kind = 'negative'"), a.select("sample", F.col("attrs")["Group"].alias("grp")))


@query("comparable_groups", BASE + "SELECT sum(m)::BIGINT AS samples, count(*) AS groups, count(*) >= 2 AND sum(m) > count(*) AND max(m) >= 2 AS comparable FROM (SELECT grp, count(*) AS m FROM m GROUP BY 1) x")
def comparable_groups(s, d):
    return controls.comparable(metadata(s, d).select("sample", "grp"))


_CONTAM = BASE + f""", k AS (SELECT count(*) FILTER (WHERE sample % 4 = 0)::DOUBLE AS nc, count(*) FILTER (WHERE sample % 4 > 0)::DOUBLE AS ns FROM (SELECT DISTINCT sample FROM c) x),
a AS (SELECT taxon AS feature_id, count(*) FILTER (WHERE sample % 4 > 0) AS in_samples, count(*) FILTER (WHERE sample % 4 = 0) AS in_controls FROM c WHERE reads > 0 GROUP BY 1),
b AS (SELECT a.*, in_samples * (nc - in_controls) - in_controls * (ns - in_samples) AS x, (ns + nc) AS t, (in_samples + in_controls) * (ns - in_samples + nc - in_controls) * ns * nc AS w FROM a, k),
z AS (SELECT *, t * pow(greatest(abs(x) - t / 2, 0), 2) / nullif(w, 0) AS chi FROM b), h AS (SELECT *, ({chi2_sql("chi", "1")}) / 2 AS half FROM z)
SELECT feature_id, in_samples, in_controls, round(CASE WHEN chi IS NULL THEN NULL WHEN x < 0 THEN half ELSE 1 - half END, 6) AS p, coalesce(CASE WHEN x < 0 THEN half ELSE 1 - half END < 0.4, false) AS contaminant FROM h"""


@query("contaminants", _CONTAM)
def contaminants(s, d):
    c = genus_counts(s, d).select("sample", F.col("taxon").alias("feature_id"), "reads")
    return controls.contaminants(c, c.where("sample % 4 = 0").select("sample").distinct(), 0.4).withColumn("p", F.round("p", 6))


def _mock(s, d):
    expected = s.createDataFrame([("Brand#11", 6.0, "ECONOMY", ["Brand#12"]), ("Brand#21", 2.0, "PROMO", None), ("Brand#99", 2.0, "STANDARD", []), ("Brand#98", 90.0, "PROMO", None)], "taxon string, weight double, family string, names array<string>")
    fam = features(s, d).join(taxonomy(s, d), "feature_id").join(metadata(s, d).select("sample", "site"), "sample").groupBy(F.col("site").alias("sample"), F.col("phylum").alias("family")).agg(F.sum("reads").alias("reads"))
    from quadrat.operators import community

    return site_counts(s, d), expected, community.with_share(fam).select("sample", "family", "pct")


_MOCK = BASE + """, x AS (SELECT * FROM (VALUES ('Brand#11', 6.0::DOUBLE, 'ECONOMY', 'Brand#11'), ('Brand#11', 6.0, 'ECONOMY', 'Brand#12'), ('Brand#21', 2.0, 'PROMO', 'Brand#21'), ('Brand#99', 2.0, 'STANDARD', 'Brand#99'), ('Brand#98', 90.0, 'PROMO', 'Brand#98')) v(taxon, expected, family, name)),
f2 AS (SELECT site AS sample, phylum AS family, sum(reads) AS reads FROM n JOIN m USING (sample) GROUP BY 1, 2), f3 AS (SELECT sample, family, 100 * reads / sum(reads) OVER (PARTITION BY sample) AS pct FROM f2),
o AS (SELECT sample, x.taxon, sum(pct) AS observed FROM g JOIN x ON g.taxon = x.name GROUP BY 1, 2), y AS (SELECT s.sample, w.*, coalesce(observed, 0) AS observed, coalesce(f3.pct, 0) AS fp FROM (SELECT DISTINCT sample FROM g) s CROSS JOIN (SELECT DISTINCT taxon, expected, family FROM x) w
 LEFT JOIN o ON o.sample = s.sample AND o.taxon = w.taxon LEFT JOIN f3 ON f3.sample = s.sample AND f3.family = w.family),
mg AS (SELECT sample, taxon, expected, observed, observed < 0.25 * expected AND fp >= 0.25 * expected AS family_only, observed < 0.25 * expected AND NOT fp >= 0.25 * expected AS missing FROM y) """


@query("mock_genera", _MOCK + "SELECT sample, taxon, round(expected, 6) AS expected, round(observed, 6) AS observed, family_only, missing FROM mg")
def mock_genera(s, d):
    return controls.mock_genera(*_mock(s, d)).withColumn("expected", F.round("expected", 6)).withColumn("observed", F.round("observed", 6))


@query("mock_verdicts", _MOCK + ", nm AS (SELECT sample, sum(pct) AS named FROM g WHERE taxon <> 'Unclassified' GROUP BY 1) SELECT sample, round((sum(abs(expected - observed)) + any_value(named) - sum(observed)) / 200, 6) AS bray_curtis, round(any_value(named) - sum(observed), 6) AS other_pct, coalesce(string_agg(taxon, '|' ORDER BY taxon) FILTER (WHERE missing), '') AS missing FROM mg JOIN nm USING (sample) GROUP BY 1")
def mock_verdicts(s, d):
    return controls.mock_verdicts(*_mock(s, d)).withColumn("bray_curtis", F.round("bray_curtis", 6)).withColumn("other_pct", F.round("other_pct", 6))


@query("ordered_levels", BASE + "SELECT (row_number() OVER (ORDER BY x = 'Other', v DESC, x))::INT AS place, x AS taxon FROM (SELECT CASE WHEN taxon = 'Unclassified' THEN 'Other' ELSE taxon END AS x, sum(reads) AS v FROM c GROUP BY 1) y")
def ordered_levels(s, d):
    return controls.ordered_levels(genus_counts(s, d).select(F.when(F.col("taxon") == "Unclassified", "Other").otherwise(F.col("taxon")).alias("taxon"), F.col("reads").alias("value"))).withColumn("place", F.col("place").cast("int"))


@query("sample_keys", """WITH n AS (SELECT DISTINCT 'site ' || n_name || CASE s_suppkey % 5 WHEN 0 THEN '-CT' WHEN 1 THEN '_neg-2' WHEN 2 THEN '' ELSE '.R' || (s_suppkey % 7) END AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT key, regexp_extract(key, '(?i)^(.+?)[-_. ]+(CT|NC|NTC|NEG|NEGATIVE|BLANK|EB|CTRL|CONTROL)[-_. ]?\\d*$', 1) AS c1, regexp_extract(key, '(?i)^(.+?)[-_. ]+(CT|NC|NTC|NEG|NEGATIVE|BLANK|EB|CTRL|CONTROL)[-_. ]?\\d*$', 2) AS c2, regexp_extract(key, '(?i)^(.+?)[-_. ]+(?:R|REP)?(\\d{1,3})$', 1) AS r1, regexp_extract(key, '(?i)^(.+?)[-_. ]+(?:R|REP)?(\\d{1,3})$', 2) AS r2 FROM n)
SELECT key || '-COI' AS name, key, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS folded, CASE WHEN c1 <> '' THEN rtrim(c1, '-_. ') WHEN r1 <> '' THEN rtrim(r1, '-_. ') ELSE key END AS site, CASE WHEN c1 <> '' THEN upper(c2) ELSE r2 END AS replicate, c1 <> '' AS is_control FROM p""")
def sample_keys(s, d):
    k = F.col("sample")
    tail = F.when(k % 5 == 0, "-CT").when(k % 5 == 1, "_neg-2").when(k % 5 == 2, "").otherwise(F.concat(F.lit(".R"), (k % 7).cast("string")))
    return markers.sample_keys(metadata(s, d).select(F.concat(F.lit("site "), "site", tail, F.lit("-COI")).alias("name")))


@query("marker_samples", "SELECT 's' || (l_suppkey % 50) AS folded, 'S-' || (l_suppkey % 50) AS key, string_agg(DISTINCT 'M' || l_linenumber, ',' ORDER BY 'M' || l_linenumber) AS markers FROM lineitem GROUP BY 1, 2")
def marker_samples(s, d):
    k = (F.col("l_suppkey") % 50).cast("string")
    return markers.marker_samples(table(s, d, "lineitem").select(mode().alias("marker"), F.concat(F.lit("s"), k).alias("folded"), F.concat(F.lit("S-"), k).alias("key")))


@query("site_means", BASE + ", k AS (SELECT grp AS marker, site, count(*) AS samples FROM m GROUP BY 1, 2) SELECT grp AS marker, m.site, taxon, round(sum(pct) / any_value(samples), 6) AS mean_pct, count(*) FILTER (WHERE pct > 0) AS found, any_value(samples) AS samples FROM p JOIN m USING (sample) JOIN k ON k.marker = grp AND k.site = m.site GROUP BY 1, 2, 3")
def site_means(s, d):
    keys = metadata(s, d).select(F.col("grp").alias("marker"), "sample", "site")
    shares = genus_counts(s, d).join(keys.select("marker", "sample"), "sample").select("marker", "sample", "taxon", "pct")
    return markers.site_means(shares, keys).withColumn("mean_pct", F.round("mean_pct", 6))


def _named(s, d):
    t = taxonomy(s, d).select("feature_id", "phylum", *(F.lit(None).cast("string").alias(r) for r in ("class", "order", "family")), "genus", F.when(F.col("feature_id") % 3 > 0, F.regexp_replace("species", " ", "_")).alias("species"))
    names = markers.feature_name(["phylum"])
    return features(s, d).join(t, "feature_id").select("sample", "feature_id", "reads", *(c.alias(n) for n, c in names.items()))


_FN = BASE + """, v AS (SELECT feature_id, phylum, genus, CASE WHEN feature_id % 3 > 0 THEN species END AS species FROM t), w AS (SELECT feature_id, phylum AS grp, CASE WHEN species IS NOT NULL THEN 'species' WHEN genus IS NOT NULL THEN 'genus' ELSE 'phylum' END AS rank, coalesce(species, genus, phylum) AS name FROM v),
q AS (SELECT f.sample, f.feature_id, reads, grp, rank, name FROM f JOIN w USING (feature_id)) """


@query("feature_names", _FN + "SELECT DISTINCT feature_id, grp, rank, name FROM q")
def feature_names(s, d):
    return _named(s, d).select("feature_id", "grp", "rank", "name").distinct()


@query("marker_overview", _FN + "SELECT sum(reads) AS reads, count(DISTINCT feature_id) AS features, count(DISTINCT rank || name) AS taxa, count(DISTINCT name) FILTER (WHERE rank = 'species') AS species, count(DISTINCT rank || name) FILTER (WHERE rank <> 'phylum') AS genera, round(100 * sum(reads) FILTER (WHERE rank <> 'phylum') / sum(reads), 6) AS genus_pct FROM q")
def marker_overview(s, d):
    return markers.marker_overview(_named(s, d)).withColumn("genus_pct", F.round("genus_pct", 6))


@query("group_shares", _FN + ", z AS (SELECT sample, sum(reads) AS t FROM q GROUP BY 1) SELECT grp, round(sum(100 * reads / t) / (SELECT count(*) FROM z), 6) AS mean_pct, count(DISTINCT rank || name) AS taxa FROM q JOIN z USING (sample) GROUP BY 1")
def group_shares(s, d):
    return markers.group_shares(_named(s, d)).withColumn("mean_pct", F.round("mean_pct", 6))


@query("group_presence", BASE + """, u AS (SELECT sample, feature_id AS taxon FROM f WHERE reads > 40), z AS (SELECT site AS sample, grp FROM m GROUP BY 1, 2), x AS (SELECT DISTINCT m.site AS sample, taxon, m.grp FROM u JOIN m USING (sample)), n2 AS (SELECT grp, count(*) AS n FROM z GROUP BY 1),
k AS (SELECT taxon, x.grp, count(*) AS k, any_value(n) AS n FROM x JOIN n2 ON n2.grp = x.grp GROUP BY 1, 2) SELECT CAST(taxon AS VARCHAR) AS taxon, count(*) = (SELECT count(*) FROM n2) AS in_all, CASE WHEN count(*) = 1 AND 2 * max(k) >= max(n) THEN max(grp) END AS only FROM k GROUP BY 1""")
def group_presence(s, d):
    u = features(s, d).where("reads > 40").join(metadata(s, d).select("sample", "site"), "sample").select(F.col("site").alias("sample"), F.col("feature_id").cast("string").alias("taxon"), F.lit(1.0).alias("pct"))
    return markers.group_presence(u, site_groups(s, d))


@query("read_classes", BASE + """, h AS (SELECT p_partkey AS feature_id, CASE p_size % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' END AS target, 50.0::DOUBLE + p_size AS pident, p_size % 8 = 3 AS second FROM part WHERE p_size % 9 > 0),
w AS (SELECT sample, reads, CASE WHEN target IN ('yes', 'no') THEN target WHEN coalesce(second, false) THEN 'yes' ELSE 'none' END AS w, pident FROM f LEFT JOIN h USING (feature_id)), v AS (SELECT sample, reads, CASE WHEN w = 'yes' AND NOT coalesce(pident >= 80, false) THEN 'far' ELSE w END AS w FROM w)
SELECT sample, round(100 * coalesce(sum(reads) FILTER (WHERE w = 'yes'), 0) / sum(reads), 6) AS target, round(100 * coalesce(sum(reads) FILTER (WHERE w = 'far'), 0) / sum(reads), 6) AS far, round(100 * coalesce(sum(reads) FILTER (WHERE w = 'no'), 0) / sum(reads), 6) AS other, round(100 * coalesce(sum(reads) FILTER (WHERE w = 'none'), 0) / sum(reads), 6) AS "none" FROM v GROUP BY 1""")
def read_classes(s, d):
    n = F.col("p_size")
    h = table(s, d, "part").where("p_size % 9 > 0").select(F.col("p_partkey").alias("feature_id"), F.when(n % 4 == 1, "no").when(n % 4 != 3, "yes").alias("target"), (50.0 + n).alias("pident"), (n % 8 == 3).alias("named_second"))
    out = markers.read_classes(features(s, d), h)
    return out.select("sample", *(F.round(c, 6).alias(c) for c in ("target", "far", "other", "none")))


_ARCH = BASE + ", a AS (SELECT n.*, CASE WHEN p_size > 40 THEN 'Archaea' WHEN p_size > 10 THEN 'Bacteria' END AS domain FROM n JOIN part ON feature_id = p_partkey) "


def _domains(s, d):
    dom = table(s, d, "part").select(F.col("p_partkey").alias("feature_id"), F.when(F.col("p_size") > 40, "Archaea").when(F.col("p_size") > 10, "Bacteria").alias("domain"))
    return features(s, d).join(taxonomy(s, d), "feature_id").join(dom, "feature_id"), dom


@query("archaea", _ARCH + """, b AS (SELECT sample, coalesce(genus, phylum) AS taxon, sum(reads) AS v, row_number() OVER (PARTITION BY sample ORDER BY sum(reads) DESC, coalesce(genus, phylum)) AS r FROM a WHERE domain = 'Archaea' GROUP BY 1, 2)
SELECT a.sample, coalesce(sum(reads) FILTER (WHERE domain = 'Archaea'), 0) AS reads, round(100 * coalesce(sum(reads) FILTER (WHERE domain = 'Archaea'), 0) / sum(reads), 6) AS pct, coalesce(any_value(b.taxon), '—') AS dominant FROM a LEFT JOIN b ON b.sample = a.sample AND r = 1 GROUP BY 1""")
def archaea(s, d):
    return markers.archaea(_domains(s, d)[0]).withColumn("pct", F.round("pct", 6))


@query("domain_totals", _ARCH + "SELECT coalesce(domain, 'Unknown') AS domain, sum(reads) AS reads FROM a GROUP BY 1")
def domain_totals(s, d):
    return markers.domain_totals(features(s, d), _domains(s, d)[1])


@query("without_hosts", BASE + "SELECT sample, feature_id, reads FROM f WHERE feature_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def without_hosts(s, d):
    return markers.without_taxa(features(s, d), table(s, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("feature_id")))


@query("kept_reads", "SELECT l_orderkey AS read_id, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def kept_reads(s, d):
    return markers.kept_reads(table(s, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), "l_linenumber"), table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("read_id")))


@query("two_hop_taxonomy", "SELECT taxid, query, target, name FROM (SELECT l_orderkey AS query, l_partkey AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) x LEFT JOIN (SELECT p_partkey AS target, p_size AS taxid FROM part WHERE p_size % 4 > 0) i USING (target) LEFT JOIN (SELECT n_nationkey AS taxid, n_name AS name FROM nation) t USING (taxid) WHERE r = 1")
def two_hop_taxonomy(s, d):
    hits = table(s, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.struct("l_linenumber", "l_partkey").alias("place"), F.col("l_partkey").alias("target"))
    ids = table(s, d, "part").where("p_size % 4 > 0").select(F.col("p_partkey").alias("target"), F.col("p_size").alias("taxid"))
    return markers.two_hop_taxonomy(hits, ids, table(s, d, "nation").select(F.col("n_nationkey").alias("taxid"), F.col("n_name").alias("name")))


@query("checked_names", "SELECT p_partkey || ';size=' || p_size AS feature_id, l_returnflag AS agreement FROM part LEFT JOIN (SELECT l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem WHERE l_quantity > 30 GROUP BY 1) x ON l_partkey = p_partkey")
def checked_names(s, d):
    f = table(s, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(";size="), F.col("p_size").cast("string")).alias("feature_id"))
    checks = table(s, d, "lineitem").where("l_quantity > 30").groupBy(F.col("l_partkey").cast("string").alias("key")).agg(F.max("l_returnflag").alias("agreement"))
    return markers.checked_names(f, checks)


@query("combined_outputs", "SELECT 'M' || l_linenumber AS sample, CAST(l_partkey AS VARCHAR) AS feature_id, sum(CASE WHEN l_returnflag <> 'A' THEN round_even(l_quantity * 0.3, 0) ELSE round_even(l_discount * 1e6, 0) END) AS reads FROM lineitem GROUP BY 1, 2")
def combined_outputs(s, d):
    out = table(s, d, "lineitem").select(mode().alias("sample"), F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("tax_id"), F.when(F.col("l_returnflag") != "A", (F.col("l_quantity") * 0.3).cast("string")).alias("counts"), F.col("l_discount").cast("string").alias("abundance"))
    return markers.combined_outputs(out)


@query("taxa_at_rank", "SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 5")
def taxa_at_rank(s, d):
    return markers.taxa_at(taxonomy(s, d).select(F.concat(F.lit("g__"), "genus").alias("genus")), "genus")


@query("guild_counts", "SELECT p_type AS guild, count(*) AS features FROM part WHERE p_size % 3 > 0 GROUP BY 1")
def guild_counts(s, d):
    return markers.guild_counts(table(s, d, "part").select(F.col("p_partkey").alias("feature_id"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("guild")))


_FUNCTIONS = [("fixing", "brand#1"), ("fixing", "Brand#22"), ("eating", "rand#3"), ("eating", "a Brand#4 and more"), ("eating", "Brand#41"), ("none", "nothing")]
_POOLS = BASE + ", k(function, genus) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _FUNCTIONS) + """), mt AS (SELECT DISTINCT taxon, function FROM (SELECT DISTINCT taxon FROM c) x, k WHERE contains(lower(taxon), lower(genus)) OR contains(lower(genus), lower(taxon))),
y AS (SELECT sample, function, sum(reads) AS reads FROM c JOIN mt USING (taxon) GROUP BY 1, 2) """


@query("function_matches", _POOLS + "SELECT taxon, function FROM mt")
def function_matches(s, d):
    return markers.function_matches(genus_counts(s, d).select("taxon").distinct(), s.createDataFrame(_FUNCTIONS, "function string, genus string"))


@query("function_pools", _POOLS + "SELECT sample, function, round(100 * reads / sum(reads) OVER (PARTITION BY sample), 6) AS pct FROM y")
def function_pools(s, d):
    return markers.function_pools(genus_counts(s, d), s.createDataFrame(_FUNCTIONS, "function string, genus string")).withColumn("pct", F.round("pct", 6))


@query("function_diversity", BASE + ", v AS (SELECT sample, reads / sum(reads) OVER (PARTITION BY sample) AS p FROM c WHERE taxon <> 'Brand#11' AND reads > 0) SELECT sample, round(-sum(p * ln(p)), 6) AS shannon, count(*) AS functions FROM v GROUP BY 1")
def function_diversity(s, d):
    c = genus_counts(s, d).select("sample", F.when(F.col("taxon") == "Brand#11", "UNMAPPED: x").otherwise(F.concat("taxon", F.lit(": y"))).alias("feature"), F.col("reads").alias("value"))
    return markers.function_diversity(c).withColumn("shannon", F.round("shannon", 6))


@query("pooled_profiles", "WITH x AS (SELECT l_returnflag AS file, l_linenumber AS pos, count(*) AS reads, avg(l_quantity) AS mean_q FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber < 6 GROUP BY 1, 2), e AS (SELECT min(l) AS last FROM (SELECT file, max(pos) AS l FROM x GROUP BY 1) y) SELECT pos, round(sum(mean_q * reads) / sum(reads), 6) AS mean_q FROM x, e WHERE pos <= last GROUP BY 1")
def pooled_profiles(s, d):
    p = table(s, d, "lineitem").where("l_returnflag <> 'R' OR l_linenumber < 6").groupBy(F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("pos")).agg(F.count("*").alias("reads"), F.avg("l_quantity").alias("mean_q"))
    return markers.pooled_profiles(p).withColumn("mean_q", F.round("mean_q", 6))


@query("heatmap_rows", BASE + """, s AS (SELECT taxon, sum(pct) AS s, count(*) AS k, max(pct) AS hi, min(pct) AS lo, row_number() OVER (ORDER BY sum(pct) DESC, taxon) AS r FROM p GROUP BY 1), q AS (SELECT taxon, row_number() OVER (ORDER BY s DESC, taxon) AS place FROM s WHERE r <= 10 AND hi > CASE WHEN k < (SELECT count(DISTINCT sample) FROM p) THEN 0 ELSE lo END)
SELECT place::INT AS place, taxon, sample, round(pct, 6) AS pct FROM p JOIN q USING (taxon) WHERE pct > 0""")
def heatmap_rows(s, d):
    return markers.heatmap_rows(genus_counts(s, d), 10).withColumn("pct", F.round("pct", 6)).withColumn("place", F.col("place").cast("int"))


@query("top_genera_reads", BASE + ", s AS (SELECT taxon, sum(reads) AS reads FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6), r AS (SELECT *, row_number() OVER (ORDER BY reads DESC, taxon) AS place FROM s WHERE taxon <> 'Unclassified') SELECT place::INT AS place, taxon, reads, round(100 * reads / (SELECT sum(reads) FROM c), 1) AS pct FROM r WHERE place <= 5")
def top_genera_reads(s, d):
    return markers.top_genera(genus_counts(s, d), 5, "Unclassified").withColumn("place", F.col("place").cast("int"))


@query("resistance_table", "SELECT p_brand AS gene, " + ", ".join(f"round(coalesce(sum(l_discount) FILTER (WHERE l_linenumber = {i}), 0), 6) AS \"M{i}\"" for i in (1, 2, 3)) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def resistance_table(s, d):
    g = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(mode().alias("sample"), F.col("p_brand").alias("gene"), F.col("l_discount").alias("rpkm"))
    return markers.amr_tables(g, ["M1", "M2", "M3"]).select("gene", *(F.round(f"M{i}", 6).alias(f"M{i}") for i in (1, 2, 3)))
