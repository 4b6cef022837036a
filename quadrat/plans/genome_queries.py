"""Queries on bins and isolates. A customer is a bin, its orders are contigs; a line item's order is a genome with line items as hits."""

from pyspark.sql import functions as F

from quadrat.operators import bins
from quadrat.plans.analogue import query, table

_K = """WITH k AS (SELECT 'S' || (o_custkey % 4) AS sample, o_custkey AS bin, o_orderkey AS contig, floor(o_totalprice)::BIGINT AS length, 1 + o_orderkey % 7 AS depth, CASE WHEN o_orderkey % 6 < 5 THEN 'G' || (o_orderkey % 6) END AS genus,
 CASE WHEN o_orderkey % 6 < 5 AND o_orderkey % 4 > 0 THEN 'G' || (o_orderkey % 6) || ' s' || (o_orderkey % 3) END AS species FROM orders),
q AS (SELECT DISTINCT bin, ((bin * 37) % 101)::DOUBLE AS completeness, ((bin * 13) % 23)::DOUBLE AS contamination FROM k) """


def _contigs(s, d):
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 6
    genus = F.concat(F.lit("G"), n.cast("string"))
    return table(s, d, "orders").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 4).cast("string")).alias("sample"), F.col("o_custkey").alias("bin"), k.alias("contig"), F.floor("o_totalprice").cast("long").alias("length"), (1 + k % 7).alias("depth"),
        F.when(n < 5, genus).alias("genus"), F.when((n < 5) & (k % 4 > 0), F.concat(genus, F.lit(" s"), (k % 3).cast("string"))).alias("species"),
    )


def _quality(s, d):
    return _contigs(s, d).select("bin").distinct().select("bin", (F.col("bin") * 37 % 101).cast("double").alias("completeness"), (F.col("bin") * 13 % 23).cast("double").alias("contamination"))


_NAMES = """, t AS (SELECT bin, sum(length) AS t FROM k GROUP BY 1), g AS (SELECT bin, genus, sum(length) AS g, row_number() OVER (PARTITION BY bin ORDER BY sum(length) DESC, genus) AS r FROM k WHERE genus IS NOT NULL GROUP BY 1, 2),
v AS (SELECT bin, split_part(species, ' ', 1) AS genus, species, sum(length) AS v, row_number() OVER (PARTITION BY bin, split_part(species, ' ', 1) ORDER BY sum(length) DESC, species) AS r FROM k WHERE species IS NOT NULL GROUP BY 1, 2, 3),
names AS (SELECT g.bin, CASE WHEN v.v >= 0.6 * g.g THEN v.species ELSE g.genus END AS name, round_even(100.0::DOUBLE * g.g / greatest(t.t, 1), 1) AS share FROM g JOIN t USING (bin) LEFT JOIN v ON v.bin = g.bin AND v.genus = g.genus AND v.r = 1 WHERE g.r = 1) """


@query("bin_names", _K + _NAMES + "SELECT bin, name, share FROM names")
def bin_names(s, d):
    return bins.bin_names(_contigs(s, d))


_JOINS = _NAMES + """, z AS (SELECT bin, sum(length) AS length, sum(depth * length) / greatest(sum(length), 1)::DOUBLE AS depth FROM k GROUP BY 1),
b AS (SELECT z.*, name AS species FROM z JOIN names USING (bin)), f AS (SELECT *, first_value(depth) OVER (PARTITION BY species ORDER BY length DESC, bin) AS ref FROM b),
w AS (SELECT *, count(*) OVER (PARTITION BY species) AS n FROM f WHERE depth > 0 AND greatest(depth, ref) <= 1.5 * least(depth, ref)),
cand AS (SELECT species, bin, first_value(bin) OVER (PARTITION BY species ORDER BY length DESC, bin) AS joined FROM w WHERE n >= 2) """


def _candidates(s, d):
    named = bins.sizes_and_depths(_contigs(s, d)).join(bins.bin_names(_contigs(s, d)).select("bin", F.col("name").alias("species")), "bin")
    return bins.join_candidates(named)


@query("join_candidates", _K + _JOINS + "SELECT species, joined, bin FROM cand")
def join_candidates(s, d):
    return _candidates(s, d)


@query("accepted_joins", _K + _JOINS + """, p AS (SELECT joined, max(completeness) AS comp, max(contamination) AS cont, string_agg(CAST(cand.bin AS VARCHAR), ' + ' ORDER BY CAST(cand.bin AS VARCHAR)) AS parts FROM cand JOIN (SELECT bin, completeness / 2 AS completeness, contamination / 3 AS contamination FROM q) q USING (bin) GROUP BY 1),
nq AS (SELECT DISTINCT joined, (joined * 7 % 50 + 50)::DOUBLE AS completeness, (joined % 12)::DOUBLE AS contamination FROM cand)
SELECT joined, completeness, contamination, parts FROM p JOIN nq USING (joined) WHERE completeness >= comp + 10 AND contamination < 10 AND contamination <= cont + 5""")
def accepted_joins(s, d):
    c = _candidates(s, d)
    q = _quality(s, d).select("bin", (F.col("completeness") / 2).alias("completeness"), (F.col("contamination") / 3).alias("contamination"))
    new = c.select("joined").distinct().select("joined", (F.col("joined") * 7 % 50 + 50).cast("double").alias("completeness"), (F.col("joined") % 12).cast("double").alias("contamination"))
    return bins.accepted_joins(c, q, new)


@query("chosen_splits", _K + """, p AS (SELECT bin, v AS variant, genus AS part, (contig % 89)::DOUBLE AS completeness, CASE WHEN contig % 50 > 0 THEN ((contig + v) % 9)::DOUBLE END AS contamination FROM (SELECT bin, genus, max(contig) AS contig FROM k WHERE genus IS NOT NULL GROUP BY 1, 2) x, (VALUES (0), (1)) y(v)),
w AS (SELECT bin, variant, sum(greatest(0, completeness - 5 * contamination)) AS score FROM p GROUP BY 1, 2 HAVING count(*) >= 2 AND count(contamination) = count(*)),
b AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY score DESC, variant) AS r FROM w)
SELECT bin, variant, score FROM b JOIN q USING (bin) WHERE r = 1 AND contamination > 10 AND score > greatest(0, completeness - 5 * contamination)""")
def chosen_splits(s, d):
    x = _contigs(s, d).where("genus IS NOT NULL").groupBy("bin", "genus").agg(F.max("contig").alias("contig")).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    parts = x.select("bin", "variant", F.col("genus").alias("part"), (F.col("contig") % 89).cast("double").alias("completeness"), F.when(F.col("contig") % 50 > 0, ((F.col("contig") + F.col("variant")) % 9).cast("double")).alias("contamination"))
    return bins.chosen_splits(parts, _quality(s, d))


_BEST = """WITH m AS (SELECT l_orderkey AS query, CASE WHEN l_linenumber % 2 = 0 THEN 'RS_' ELSE '' END || 'A' || l_partkey || '.' || l_linenumber || '.' || CAST(l_extendedprice * 100 AS BIGINT) AS accession, l_quantity::DOUBLE AS share, CASE WHEN l_linenumber % 3 = 0 THEN 0.9::DOUBLE + l_discount::DOUBLE ELSE 0 END AS ani, l_discount::DOUBLE * 5 AS found FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY share DESC, accession) AS r FROM m), c AS (SELECT query, regexp_replace(accession, '^(RS_|GB_)', '') AS accession, coalesce(nullif(ani, 0), pow(found, 1 / 31.0::DOUBLE)) AS a FROM b WHERE r = 1),
e AS (SELECT query, accession, round_even(CASE WHEN a <= 1 THEN 100 * a ELSE a END, 2) AS ani FROM c) """


@query("best_genome_match", _BEST + "SELECT query, accession, ani, CASE WHEN ani >= 95 THEN 'species' WHEN ani >= 90 THEN 'genus' ELSE 'unresolved' END AS call FROM e")
def best_genome_match(s, d):
    li = table(s, d, "lineitem")
    m = li.select(F.col("l_orderkey").alias("query"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "RS_").otherwise(""), F.lit("A"), F.concat_ws(".", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))).alias("accession"), F.col("l_quantity").cast("double").alias("share"), F.when(F.col("l_linenumber") % 3 == 0, 0.9 + F.col("l_discount").cast("double")).otherwise(0.0).alias("ani"), (F.col("l_discount").cast("double") * 5).alias("found"))
    return bins.best_match(m)


_TABLE = """, r AS (SELECT *, sum(length) OVER (PARTITION BY sample, bin ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER (PARTITION BY sample, bin) AS t FROM k WHERE bin % 5 > 0),
a AS (SELECT sample, sum(depth * length)::DOUBLE AS al FROM k WHERE length >= 1000 GROUP BY 1),
b AS (SELECT sample, bin, max(t) AS size, count(*) AS contigs, max(CASE WHEN run >= t / 2.0 THEN length END) AS n50, sum(depth * length)::DOUBLE AS cov FROM r GROUP BY 1, 2),
c AS (SELECT b.*, al, completeness, contamination, CASE WHEN completeness > 90 AND contamination < 5 THEN 'High' WHEN completeness >= 50 AND contamination < 10 THEN 'Medium' ELSE 'Low' END AS tier FROM b JOIN a USING (sample) JOIN q USING (bin)),
tab AS (SELECT sample, bin, size::BIGINT AS size, contigs, n50, round_even(cov / greatest(size, 1), 1) AS depth, round_even(100 * cov / al, 1) AS coverage_share, completeness, contamination, tier,
 (row_number() OVER (PARTITION BY sample ORDER BY CASE tier WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, completeness DESC, bin))::INT AS place FROM c) """


def _table(s, d):
    c = _contigs(s, d).withColumn("bin", F.when(F.col("bin") % 5 > 0, F.col("bin")))
    return bins.bin_table(c, _quality(s, d), 1000)


@query("bin_table", _K + _TABLE + "SELECT * FROM tab")
def bin_table(s, d):
    return _table(s, d).withColumn("place", F.col("place").cast("int"))


@query("bin_counts", _K + _TABLE + "SELECT count(*) AS bins, count(*) FILTER (WHERE tier = 'High') AS high, count(*) FILTER (WHERE tier = 'Medium') AS medium, count(DISTINCT CASE WHEN bin % 3 = 0 THEN bin // 10 END) AS split, count(*) FILTER (WHERE bin % 7 = 0) AS joined FROM tab")
def bin_counts(s, d):
    t = _table(s, d).select("tier", F.when(F.col("bin") % 3 == 0, F.expr("bin DIV 10")).alias("split_from"), F.when(F.col("bin") % 7 == 0, F.col("bin")).alias("joined_from"))
    return bins.bin_counts(t)


@query("contig_types", """WITH c AS (SELECT p_partkey AS contig, CASE p_size % 3 WHEN 0 THEN 'chromosome' WHEN 1 THEN 'plasmid?' ELSE 'contig' END AS type FROM part),
p AS (SELECT p_partkey AS contig, CASE WHEN p_partkey % 2 = 0 THEN 'plasmid' ELSE 'chromosome' END AS molecule, 'c' || (p_partkey % 9) AS cluster FROM part WHERE p_partkey % 5 = 0),
r AS (SELECT l_partkey AS contig, string_agg(DISTINCT l_returnflag || l_linestatus, ', ' ORDER BY l_returnflag || l_linestatus) AS replicons FROM lineitem WHERE l_quantity > 48 GROUP BY 1),
j AS (SELECT contig, CASE WHEN molecule = 'plasmid' THEN 'plasmid' ELSE type END AS t, cluster, replicons FROM c LEFT JOIN p USING (contig) LEFT JOIN r USING (contig))
SELECT contig, CASE WHEN t = 'plasmid?' AND replicons IS NOT NULL THEN 'plasmid' WHEN t = 'plasmid?' THEN 'plasmid (putative)' ELSE t END AS type, cluster, coalesce(replicons, '') AS replicons FROM j""")
def contig_types(s, d):
    k = F.col("p_partkey")
    part = table(s, d, "part")
    c = part.select(k.alias("contig"), F.when(F.col("p_size") % 3 == 0, "chromosome").when(F.col("p_size") % 3 == 1, "plasmid?").otherwise("contig").alias("type"))
    p = part.where(k % 5 == 0).select(k.alias("contig"), F.when(k % 2 == 0, "plasmid").otherwise("chromosome").alias("molecule"), F.concat(F.lit("c"), (k % 9).cast("string")).alias("cluster"))
    r = table(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("contig"), F.concat("l_returnflag", "l_linestatus").alias("gene"))
    return bins.contig_types(c, p, r)


@query("purity_flags", _K + "SELECT bin, 'contaminated' AS flag FROM q WHERE contamination > 5 UNION ALL SELECT bin, 'incomplete' FROM q WHERE completeness < 90")
def purity_flags(s, d):
    return bins.purity_flags(_quality(s, d))


@query("mixed_cultures", """WITH h AS (SELECT l_orderkey AS sample, l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT AS place, p_brand AS genus, p_name AS species, l_quantity::DOUBLE AS pct FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT *, first_value(genus) OVER (PARTITION BY sample ORDER BY place) AS top, min(place) OVER (PARTITION BY sample) AS f FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY place, species) AS r FROM t WHERE place > f AND genus <> top AND pct >= 25)
SELECT sample, count(*) AS others, string_agg(species, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS names FROM o GROUP BY 1""")
def mixed_cultures(s, d):
    h = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("sample"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("place"), F.col("p_brand").alias("genus"), F.col("p_name").alias("species"), F.col("l_quantity").cast("double").alias("pct"))
    return bins.mixed_culture(h, 25.0)


_STRAINS = """WITH s AS (SELECT p_name || CASE WHEN p_size % 4 = 0 THEN ' x' ELSE '' END AS organism, p_partkey AS accession, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS base FROM part WHERE p_name LIKE '% %'),
nb AS (SELECT DISTINCT array_to_string(string_split(p_name, ' ')[1:2], ' ') AS base FROM part WHERE p_size > 45 AND p_name LIKE '% %'), r AS (SELECT p_name AS species, max(90 + p_size / 10.0)::DOUBLE AS identity FROM part WHERE p_size < 30 GROUP BY 1),
j AS (SELECT organism, accession, nb.base IS NOT NULL AS near, coalesce(a.identity, b.identity) AS identity FROM s LEFT JOIN nb USING (base) LEFT JOIN r a ON a.species = organism LEFT JOIN r b ON b.species = s.base) """


@query("ranked_strains", _STRAINS + "SELECT * FROM (SELECT (row_number() OVER (ORDER BY CASE WHEN near THEN 0 ELSE 1 END, coalesce(identity, 0) DESC, organism, accession))::INT AS place, organism, accession, identity FROM j) x WHERE place <= 20")
def ranked_strains(s, d):
    part = table(s, d, "part")
    named = part.where("p_name LIKE '% %'")
    strains = named.select(F.concat("p_name", F.when(F.col("p_size") % 4 == 0, " x").otherwise("")).alias("organism"), F.col("p_partkey").alias("accession"))
    rrna = part.where("p_size < 30").select(F.col("p_name").alias("species"), (90 + F.col("p_size") / 10).cast("double").alias("identity"))
    return bins.ranked_strains(strains, named.where("p_size > 45").select(F.col("p_name").alias("name")), rrna)


@query("candidate_genera", "SELECT min(p_partkey) AS place, split_part(p_name, ' ', 1) AS genus FROM part WHERE split_part(p_name, ' ', 1) <> '' GROUP BY 2 ORDER BY 1 LIMIT 2")
def candidate_genera(s, d):
    return bins.candidate_genera(table(s, d, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name")))


_HITS = """h AS (SELECT l_orderkey AS query, p_name AS organism, l_partkey AS accession, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::DOUBLE + 40 END AS anib, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity::DOUBLE + 41 END AS skani FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity) AS u FROM lineitem) l JOIN part ON l_partkey = p_partkey WHERE u = 1),
r AS (SELECT query, organism, max(80 + skani / 10) AS identity FROM h WHERE skani > 60 GROUP BY 1, 2),
c AS (SELECT h.query, (row_number() OVER (PARTITION BY h.query ORDER BY coalesce(anib, skani, 0) DESC, accession))::INT AS place, accession, anib, skani, identity FROM h LEFT JOIN r ON r.query = h.query AND r.organism = h.organism) """


def _strain_hits(s, d):
    li = bins._first(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_quantity"]).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity").cast("double")
    return li.select(F.col("l_orderkey").alias("query"), F.col("p_name").alias("organism"), F.col("l_partkey").alias("accession"), F.when(F.col("l_linenumber") % 2 == 0, q + 40).alias("anib"), F.when(F.col("l_linenumber") % 3 > 0, q + 41).alias("skani"))


def _compared(s, d):
    h = _strain_hits(s, d)
    rrna = h.where("skani > 60").groupBy("query", F.col("organism").alias("species")).agg(F.max(80 + F.col("skani") / 10).alias("identity"))
    return bins.comparison(h.drop("anib"), h.select("query", "accession", "anib"), rrna)


@query("strain_comparison", "WITH " + _HITS + "SELECT query, place, accession, anib, skani, round(identity, 6) AS identity FROM c")
def strain_comparison(s, d):
    return _compared(s, d).select("query", F.col("place").cast("int").alias("place"), "accession", "anib", "skani", F.round("identity", 6).alias("identity"))


@query("identified_genomes", """WITH g AS (SELECT p_partkey AS genome, CASE WHEN p_size % 5 > 0 THEN p_name END AS ss, CASE WHEN p_size % 5 > 0 THEN p_brand END AS sg, CASE WHEN p_size % 5 > 0 THEN 85 + p_size / 4.0::DOUBLE END AS sa, CASE WHEN p_size % 3 = 0 THEN 84 + p_size / 4.0::DOUBLE END AS ca,
 CASE WHEN p_size % 2 = 0 THEN p_type END AS rs, CASE WHEN p_size % 2 = 0 THEN p_brand END AS rg, CASE p_size % 7 WHEN 0 THEN 'known' WHEN 1 THEN 'borderline' WHEN 2 THEN 'novel' END AS sl, p_type AS ts, 90 + p_size / 7.0::DOUBLE AS ta FROM part),
x AS (SELECT *, CASE WHEN ss IS NOT NULL THEN coalesce(ca, sa) END AS a, sl IS NOT NULL AS st FROM g)
SELECT genome, CASE WHEN st THEN 'type strain' WHEN ss IS NOT NULL AND ca IS NOT NULL THEN 'ANI' WHEN ss IS NOT NULL THEN 'sketch' WHEN rs IS NOT NULL THEN '16S' END AS method, CASE WHEN st THEN ts ELSE coalesce(ss, rs) END AS species,
 CASE WHEN sl IN ('known', 'borderline') THEN split_part(ts, ' ', 1) WHEN ss IS NOT NULL THEN sg ELSE rg END AS genus, CASE WHEN st THEN round_even(ta, 2) ELSE a END AS ani,
 CASE WHEN sl = 'known' THEN 'species' WHEN sl = 'borderline' THEN 'species (borderline)' WHEN sl = 'novel' THEN 'potential novel species' WHEN ss IS NULL AND rs IS NOT NULL THEN '16S only' WHEN a IS NULL THEN 'unresolved' WHEN a >= 95 THEN 'species' WHEN a >= 90 THEN 'genus' ELSE 'unresolved' END AS call FROM x""")
def identified_genomes(s, d):
    n = F.col("p_size")
    g = table(s, d, "part").select(
        F.col("p_partkey").alias("genome"), F.when(n % 5 > 0, F.col("p_name")).alias("sketch_species"), F.when(n % 5 > 0, F.col("p_brand")).alias("sketch_genus"), F.when(n % 5 > 0, 85 + n / 4).alias("sketch_ani"), F.when(n % 3 == 0, 84 + n / 4).alias("checked_ani"),
        F.when(n % 2 == 0, F.col("p_type")).alias("rrna_species"), F.when(n % 2 == 0, F.col("p_brand")).alias("rrna_genus"), F.when(n % 7 == 0, "known").when(n % 7 == 1, "borderline").when(n % 7 == 2, "novel").alias("strain_level"), F.col("p_type").alias("strain_species"), (90 + n / 7).alias("strain_ani"),
    )
    return bins.identified(g)


@query("contig_taxa", "SELECT l_orderkey * 10 + l_linenumber AS contig, p_brand AS genus, CASE WHEN p_size > 20 THEN p_name END AS species FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'A' AND p_size > 5")
def contig_taxa(s, d):
    calls = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("contig"), (F.col("l_returnflag") != "A").alias("classified"), F.col("l_partkey").alias("taxid"))
    tree = table(s, d, "part").select(F.col("p_partkey").alias("taxid"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("genus"), F.when(F.col("p_size") > 20, F.col("p_name")).alias("species"))
    return bins.contig_taxa(calls, tree)


@query("partial_pathways", "SELECT p_brand AS feature, max(l_discount)::DOUBLE < 0.1 AS partial FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def partial_pathways(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return bins.partial_pathways(li.select(F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("feature"), F.col("l_discount").cast("double").alias("value")), 0.1)
