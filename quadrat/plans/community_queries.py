"""Queries on counts by taxon and sample."""

from pyspark.sql import functions as F

from quadrat.functions import labels
from quadrat.operators import community as c
from quadrat.operators import selection
from quadrat.plans.analogue import BASE, features, genus_counts, metadata, mode, query, table, taxonomy
from quadrat.sources import sinks

RANKS = ["phylum", "genus", "species"]


def _named(s, d):
    return c.with_taxonomy(features(s, d), taxonomy(s, d))


@query("rank_counts", BASE + "SELECT * FROM c")
def rank_counts(s, d):
    return c.rank_counts(_named(s, d), labels.analysis_label("genus"))


@query("relative_abundance", BASE + "SELECT sample, taxon, round(pct, 6) AS pct FROM p")
def relative_abundance(s, d):
    return genus_counts(s, d).select("sample", "taxon", F.round("pct", 6).alias("pct"))


_TOP = """, r AS (SELECT taxon, row_number() OVER (ORDER BY sum(pct) DESC, taxon) AS k FROM p {only} GROUP BY taxon)
SELECT sample, {label} AS taxon, round(sum(pct), 6) AS value FROM p LEFT JOIN r USING (taxon) GROUP BY 1, 2"""
_APART = _TOP.format(only="WHERE taxon <> 'Unclassified'", label="CASE WHEN k <= 10 THEN taxon WHEN taxon = 'Unclassified' THEN taxon ELSE 'Other' END")


@query("top_taxa", BASE + _APART)
def top_taxa(s, d):
    return c.top_taxa(genus_counts(s, d), 10).withColumn("value", F.round("value", 6))


@query("top_taxa_competing", BASE + _TOP.format(only="", label="CASE WHEN k <= 10 THEN taxon ELSE 'Other' END"))
def top_taxa_competing(s, d):
    return c.top_taxa(genus_counts(s, d), 10, unclassified_competes=True).withColumn("value", F.round("value", 6))


@query("top_taxa_counted", BASE + _TOP.format(only="", label="CASE WHEN k <= 10 THEN taxon ELSE 'Others (' || CAST((SELECT count(*) - 10 FROM r) AS VARCHAR) || ' taxa)' END"))
def top_taxa_counted(s, d):
    return c.top_taxa(genus_counts(s, d), 10, unclassified_competes=True, counted_name=True).withColumn("value", F.round("value", 6))


@query("dominant_taxa", BASE + "SELECT sample, taxon, round(pct, 6) AS pct, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY pct DESC, taxon)::INT AS rank FROM p WHERE taxon <> 'Unclassified' AND pct > 0) x WHERE rank <= 3")
def dominant_taxa(s, d):
    return c.dominant(genus_counts(s, d)).select("sample", "taxon", F.round("pct", 6).alias("pct"), "rank")


_GROUP = """, z AS (SELECT grp, count(*) AS n FROM m GROUP BY 1),
a AS (SELECT grp, taxon, sum(pct) AS s, sum(pct * pct) AS ss, count(*) FILTER (WHERE pct > 0) AS k FROM p JOIN m USING (sample) GROUP BY 1, 2)
SELECT grp, taxon, round(s / n, 6) AS mean_pct, round(CASE WHEN n > 1 THEN sqrt(greatest(ss - s * s / n, 0) / (n - 1)) / sqrt(n) ELSE 0 END, 6) AS se, round(100.0 * k / n, 6) AS prevalence_pct FROM a JOIN z USING (grp)"""


@query("group_means", BASE + _GROUP)
def group_means(s, d):
    out = c.group_means(genus_counts(s, d), metadata(s, d).select("sample", "grp"))
    return out.select("grp", "taxon", *(F.round(x, 6).alias(x) for x in ("mean_pct", "se", "prevalence_pct")))


@query("prevalent_taxa", BASE + ", z AS (SELECT count(DISTINCT sample) AS n FROM p) SELECT taxon, round(100.0 * count(*) FILTER (WHERE pct > 0) / any_value(n), 6) AS prevalence_pct, round(sum(pct) / any_value(n), 6) AS mean_pct FROM p, z GROUP BY taxon HAVING 100.0 * count(*) FILTER (WHERE pct > 0) / any_value(n) >= 30 AND sum(pct) / any_value(n) >= 0.1")
def prevalent_taxa(s, d):
    return c.prevalent(genus_counts(s, d), 30, 0.1).select("taxon", F.round("prevalence_pct", 6).alias("prevalence_pct"), F.round("mean_pct", 6).alias("mean_pct"))


@query("abundant_anywhere", BASE + ", x AS (SELECT *, max(pct) OVER (PARTITION BY taxon) AS most FROM p) SELECT sample, sum(CASE WHEN most < 12 THEN reads ELSE 0 END) AS dropped FROM x GROUP BY 1")
def abundant_anywhere(s, d):
    return c.abundant_anywhere(genus_counts(s, d), 12)[1]


@query("abundant_anywhere_kept", BASE + ", x AS (SELECT *, max(pct) OVER (PARTITION BY taxon) AS most FROM p) SELECT sample, taxon, reads FROM x WHERE most >= 12")
def abundant_anywhere_kept(s, d):
    return c.abundant_anywhere(genus_counts(s, d), 12)[0].select("sample", "taxon", "reads")


@query("detected_lineages", BASE + """SELECT sample, 'phylum' AS rank, count(DISTINCT phylum) AS taxa FROM n WHERE phylum IS NOT NULL AND reads > 0 GROUP BY 1
UNION ALL SELECT sample, 'genus', count(DISTINCT coalesce(phylum, '') || ';' || genus) FROM n WHERE genus IS NOT NULL AND reads > 0 GROUP BY 1
UNION ALL SELECT sample, 'species', count(DISTINCT coalesce(phylum, '') || ';' || coalesce(genus, '') || ';' || species) FROM n WHERE species IS NOT NULL AND reads > 0 GROUP BY 1""")
def detected_lineages(s, d):
    return c.detected_lineages(_named(s, d), RANKS)


@query("assigned_share", BASE + "SELECT rank, round(pct, 6) AS pct FROM (SELECT 'phylum' AS rank, 100 * sum(reads) FILTER (WHERE phylum IS NOT NULL) / sum(reads) AS pct FROM n UNION ALL SELECT 'genus', 100 * sum(reads) FILTER (WHERE genus IS NOT NULL) / sum(reads) FROM n UNION ALL SELECT 'species', 100 * sum(reads) FILTER (WHERE species IS NOT NULL) / sum(reads) FROM n) x")
def assigned_share(s, d):
    return c.assigned_share(_named(s, d), RANKS).withColumn("pct", F.round("pct", 6))


@query("group_membership", BASE + "SELECT feature_id AS taxon, string_agg(grp, '|' ORDER BY grp) AS members, count(*) AS n_groups FROM (SELECT DISTINCT feature_id, grp FROM f JOIN m USING (sample) WHERE reads > 0) x GROUP BY 1")
def group_membership(s, d):
    return c.group_membership(features(s, d).withColumnRenamed("feature_id", "taxon"), metadata(s, d).select("sample", "grp"))


@query("venn_sets", BASE + "SELECT members, count(*) AS taxa FROM (SELECT feature_id, string_agg(grp, '|' ORDER BY grp) AS members FROM (SELECT DISTINCT feature_id, grp FROM f JOIN m USING (sample) WHERE reads > 0) x GROUP BY 1) y GROUP BY 1")
def venn_sets(s, d):
    return c.venn(features(s, d).withColumnRenamed("feature_id", "taxon"), metadata(s, d).select("sample", "grp"))


_NEG = """, q AS (SELECT p.*, acctbal < 0 AS neg FROM p JOIN m USING (sample)),
k AS (SELECT sum(reads) FILTER (WHERE neg) AS pooled, count(DISTINCT sample) FILTER (WHERE NOT neg) AS n_samples FROM q),
a AS (SELECT taxon, coalesce(sum(reads) FILTER (WHERE neg), 0) AS i, coalesce(sum(pct) FILTER (WHERE NOT neg), 0) AS s, count(*) FILTER (WHERE NOT neg AND pct >= 0.1) AS samples_present FROM q GROUP BY 1),
b AS (SELECT taxon, 100 * i / pooled AS x, s / n_samples AS y, samples_present, n_samples FROM a, k WHERE i > 0 ORDER BY i DESC, taxon LIMIT 12)
SELECT taxon, round(x, 6) AS pct_in_controls, round(y, 6) AS mean_pct_in_samples, samples_present, n_samples, taxon <> 'Unclassified' AND x >= 1 AND x >= 2 * y AS flag FROM b"""


@query("negative_controls", BASE + _NEG)
def negative_controls(s, d):
    out = c.negative_controls(genus_counts(s, d), metadata(s, d).where("acctbal < 0").select("sample"))
    return out.withColumn("pct_in_controls", F.round("pct_in_controls", 6)).withColumn("mean_pct_in_samples", F.round("mean_pct_in_samples", 6))


@query("upper_median_reads", BASE + ", x AS (SELECT grp, sum(reads) AS reads FROM f JOIN m USING (sample) GROUP BY grp, sample) SELECT grp, reads AS median FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY reads) AS r, count(*) OVER (PARTITION BY grp) AS n FROM x) y WHERE r = n // 2 + 1")
def upper_median_reads(s, d):
    totals = features(s, d).groupBy("sample").agg(F.sum("reads").alias("reads")).join(metadata(s, d).select("sample", "grp"), "sample")
    return c.upper_median(totals, "reads", "grp")


_MOCK = """, x AS (SELECT * FROM (VALUES ('Brand#11', 20.0), ('Brand#22', 30.0), ('Brand#33', 40.0), ('Brand#99', 10.0)) v(taxon, w)),
s AS (SELECT DISTINCT sample FROM m WHERE acctbal < 0), o AS (SELECT s.sample, x.taxon, w AS e, coalesce(pct, 0) AS o FROM s CROSS JOIN x LEFT JOIN p ON p.sample = s.sample AND p.taxon = x.taxon),
a AS (SELECT sample, sum(abs(e - o)) AS apart, sum(o) AS known, string_agg(CASE WHEN o < 0.25 * e THEN taxon END, '|' ORDER BY taxon) AS missing FROM o GROUP BY 1),
b AS (SELECT sample, sum(pct) AS named FROM p WHERE taxon <> 'Unclassified' GROUP BY 1)
SELECT sample, round((apart + named - known) / 200, 6) AS bray_curtis, round(named - known, 6) AS other_pct, coalesce(missing, '') AS missing FROM a JOIN b USING (sample)"""


@query("mock_comparison", BASE + _MOCK)
def mock_comparison(s, d):
    shares = genus_counts(s, d).join(metadata(s, d).where("acctbal < 0").select("sample"), "sample", "left_semi")
    expected = s.createDataFrame([("Brand#11", 20.0), ("Brand#22", 30.0), ("Brand#33", 40.0), ("Brand#99", 10.0)], "taxon string, weight double")
    out = c.mock_comparison(shares, expected)
    return out.select("sample", F.round("bray_curtis", 6).alias("bray_curtis"), F.round("other_pct", 6).alias("other_pct"), "missing")


@query("rescaled_reads", BASE + ", r AS (SELECT l_suppkey AS sample, count(*) AS final_reads FROM lineitem GROUP BY 1) SELECT sample, feature_id, round(reads / sum(reads) OVER (PARTITION BY sample) * final_reads, 6) AS reads FROM f JOIN r USING (sample)")
def rescaled_reads(s, d):
    final = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.count("*").alias("final_reads"))
    return c.rescaled(features(s, d), final).withColumn("reads", F.round("reads", 6))


@query("looks_like_ppm", BASE + "SELECT coalesce(bool_and(abs(t - 1e6) <= 1e4), false) AS ppm FROM (SELECT sum(reads) AS t FROM f GROUP BY sample) x WHERE t <> 0")
def looks_like_ppm(s, d):
    return c.looks_like_ppm(features(s, d))


@query("positional_ids", BASE + "SELECT feature_id, total, 'SV' || CASE WHEN length(CAST(r AS VARCHAR)) < 5 THEN lpad(CAST(r AS VARCHAR), 5, '0') ELSE CAST(r AS VARCHAR) END AS name FROM (SELECT feature_id, sum(reads) AS total, row_number() OVER (ORDER BY sum(reads) DESC, feature_id) AS r FROM f GROUP BY 1) x")
def positional_ids(s, d):
    return c.positional_ids(features(s, d), digits=5)


@query("rollup_ranks", BASE + "SELECT phylum, genus, species, CAST(3 - grouping(phylum) - grouping(genus) - grouping(species) AS INT) AS level, sum(reads) AS reads FROM n GROUP BY GROUPING SETS ((), (phylum), (phylum, genus), (phylum, genus, species))")
def rollup_ranks(s, d):
    return c.rollup_ranks(_named(s, d), RANKS)


@query("rank_labels", "SELECT p_partkey AS feature_id, CASE WHEN p_size > 5 THEN p_name WHEN p_size > 3 THEN p_brand || ' unidentified' WHEN p_size > 1 THEN p_type || ' unidentified' ELSE 'Unassigned' END AS label FROM part")
def rank_labels(s, d):
    t = table(s, d, "part").select(F.col("p_partkey").alias("feature_id"), F.when(F.col("p_size") > 1, F.col("p_type")).otherwise("NA").alias("phylum"), F.when(F.col("p_size") > 3, F.col("p_brand")).otherwise(" nan ").alias("genus"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("").alias("species"))
    return t.select("feature_id", labels.rank_label(RANKS, "species").alias("label"))


@query("deepest_rank", "SELECT p_partkey AS feature_id, CASE WHEN p_size > 5 THEN p_name WHEN p_size > 3 THEN p_brand WHEN p_size > 1 THEN p_type END AS name, CASE WHEN p_size > 5 THEN 'species' WHEN p_size > 3 THEN 'genus' WHEN p_size > 1 THEN 'phylum' ELSE 'none' END AS rank FROM part")
def deepest_rank(s, d):
    t = table(s, d, "part").select(F.col("p_partkey").alias("feature_id"), F.when(F.col("p_size") > 1, F.col("p_type")).alias("phylum"), F.when(F.col("p_size") > 3, F.col("p_brand")).alias("genus"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("species"))
    return t.select("feature_id", labels.deepest_name(RANKS).alias("name"), labels.deepest_rank(RANKS).alias("rank"))


@query("species_labels", "SELECT p_partkey AS feature_id, CASE WHEN p_size <= 5 THEN 'Unclassified' WHEN p_name LIKE '% %' THEN p_name ELSE p_brand || ' ' || p_name END AS label FROM part")
def species_labels(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("feature_id"), labels.species_label("p_brand", F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("unclassified")).alias("label"))


@query("clean_labels", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Unclassified' ELSE url END AS label FROM pages")
def clean_labels(s, d):
    return table(s, d, "pages").select("page_id", labels.clean_label(F.when(F.col("page_id") % 3 == 0, "g__Unassigned").otherwise(F.concat(F.lit("g__"), "url"))).alias("label"))


@query("folded_keys", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key FROM supplier")
def folded_keys(s, d):
    return table(s, d, "supplier").select("s_suppkey", labels.folded_key("s_name").alias("key"))


@query("unnamed_features_dropped", BASE + "SELECT feature_id, sum(reads) AS reads FROM f JOIN (SELECT * FROM t WHERE genus IS NOT NULL) USING (feature_id) GROUP BY 1")
def unnamed_features_dropped(s, d):
    named = c.with_taxonomy(features(s, d), taxonomy(s, d).where("genus IS NOT NULL"), keep_unnamed=False)
    return named.groupBy("feature_id").agg(F.sum("reads").alias("reads"))


@query("dropped_samples", "SELECT doc_id AS sample FROM documents EXCEPT SELECT doc_id FROM labels")
def dropped_samples(s, d):
    return selection.dropped(table(s, d, "documents").select(F.col("doc_id").alias("sample")), table(s, d, "labels").select(F.col("doc_id").alias("sample")))


@query("wide_features", BASE + "SELECT taxon AS feature_id, " + ", ".join(f"coalesce(sum(reads) FILTER (WHERE grp = '{g}'), 0) AS \"{g}\"" for g in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM c JOIN m USING (sample) GROUP BY 1")
def wide_features(s, d):
    per = genus_counts(s, d).join(metadata(s, d).select("sample", "grp"), "sample").groupBy(F.col("taxon").alias("feature_id"), F.col("grp").alias("sample")).agg(F.sum("reads").alias("reads"))
    return sinks.wide_features(per, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@query("wide_tracking", "WITH x AS (SELECT o_orderpriority AS sample, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, nullif(count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority > '3'), 0) AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1) SELECT sample, F, coalesce(O, F) AS O, P FROM x")
def wide_tracking(s, d):
    t = table(s, d, "orders").where("o_orderstatus <> 'O' OR o_orderpriority > '3'").groupBy(F.col("o_orderpriority").alias("sample"), F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("reads"))
    return sinks.wide_tracking(t, ["F", "O", "P"])


_TOOLS = [f"M{i}" for i in range(1, 8)]


@query("merged_species", "SELECT species, " + ", ".join(f"round(coalesce(sum(share) FILTER (WHERE tool = '{t}'), 0), 6) AS \"{t}\"" for t in _TOOLS) + " FROM (SELECT 'M' || l_linenumber AS tool, p_name AS species, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linenumber) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_linenumber, p_name) x GROUP BY 1")
def merged_species(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = li.groupBy(mode().alias("tool"), F.col("p_name").alias("species")).agg(F.count("*").alias("reads"))
    out = sinks.merged_species(c.with_share(counts, "tool", name="share"), _TOOLS)
    return out.select("species", *(F.round(x, 6).alias(x) for x in _TOOLS))


@query("krona_lines", BASE + "SELECT sample, concat_ws(chr(9), CAST(CAST(sum(reads) AS BIGINT) AS VARCHAR), phylum, genus) AS line FROM n GROUP BY sample, phylum, genus")
def krona_lines(s, d):
    return sinks.krona(features(s, d), taxonomy(s, d), ["phylum", "genus"])


@query("markup_stripped", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def markup_stripped(s, d):
    return table(s, d, "pages").select("page_id", labels.strip_markup("html").alias("text"))


@query("json_cells", BASE + """, r AS (SELECT sample, taxon, pct, row_number() OVER (PARTITION BY sample ORDER BY pct DESC, taxon) AS k FROM p WHERE taxon <> 'Unclassified' AND pct > 0)
SELECT sample, '[' || string_agg('{"taxon":"' || taxon || '","rank":' || CAST(k AS VARCHAR) || '}', ',' ORDER BY k) || ']' AS top_json FROM r WHERE k <= 3 GROUP BY 1""")
def json_cells(s, d):
    top = c.dominant(genus_counts(s, d))
    return top.groupBy("sample").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", "taxon"))), lambda x: F.struct(x["taxon"].alias("taxon"), x["rank"].alias("rank")))).alias("top_json"))
