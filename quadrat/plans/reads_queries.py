"""Queries on reads, sequences and genomes. A document's text stands for the qualities of a read, its letters for bases."""

from pyspark.sql import functions as F

from quadrat.functions import sequences as sq
from quadrat.operators import genomes, reads
from quadrat.plans.analogue import mode, query, table

#: Texts as sequences: everything but a, c, g and t goes.
_SEQ = "WITH x AS (SELECT doc_id, lang, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS seq, text FROM documents) "


def _sequences(s, d):
    return table(s, d, "documents").select("doc_id", "lang", F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("seq"), "text")


@query("gc_content", _SEQ + "SELECT doc_id, round(100.0 * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / nullif(length(seq), 0), 6) AS gc FROM x")
def gc_content(s, d):
    return _sequences(s, d).select("doc_id", F.round(sq.gc_percent("seq"), 6).alias("gc"))


@query("reverse_complement", _SEQ + "SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc FROM x")
def reverse_complement(s, d):
    return _sequences(s, d).select("doc_id", F.md5(sq.reverse_complement("seq")).alias("rc"))


@query("dereplicated", _SEQ + "SELECT md5(seq) AS seq, size FROM (SELECT least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS seq, count(*) AS size FROM x WHERE seq IS NOT NULL GROUP BY 1) y")
def dereplicated(s, d):
    return reads.dereplicate(_sequences(s, d).select("seq")).select(F.md5("seq").alias("seq"), "size")


@query("kmer_counts", _SEQ + "SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(seq) - 2), lambda p: substr(seq, p, 4))) AS kmer FROM x WHERE length(seq) >= 4) y WHERE length(kmer) = 4 GROUP BY 1")
def kmer_counts(s, d):
    return reads.kmer_table(_sequences(s, d), 4)


@query("gc_windows", _SEQ + """, w AS (SELECT doc_id, k * 500 AS st, substr(seq, k * 500 + 1, 500) AS w FROM (SELECT doc_id, seq, unnest(range(0, (length(seq) + 499) // 500)) AS k FROM x) y), c AS (SELECT doc_id, st, length(w) AS n, length(w) - length(replace(w, 'G', '')) AS g, length(w) - length(replace(w, 'C', '')) AS c FROM w)
SELECT doc_id AS name, st AS "start", round(100.0 * (g + c) / n, 6) AS gc, round((g - c) / nullif(g + c, 0)::DOUBLE, 6) AS skew FROM c""")
def gc_windows(s, d):
    out = genomes.gc_windows(_sequences(s, d).select(F.col("doc_id").alias("name"), "seq"), 500)
    return out.select("name", F.col("start").cast("long").alias("start"), F.round("gc", 6).alias("gc"), F.round("skew", 6).alias("skew"))


_Q = "WITH x AS (SELECT doc_id, lang, length(text) AS length, list_transform(string_split(regexp_replace(text, '[^!-~]', '', 'g'), ''), lambda c: CASE WHEN c = '' THEN NULL ELSE ascii(c) - 33 END) AS q FROM documents) "


def _as_reads(s, d):
    return table(s, d, "documents").select("doc_id", F.col("lang").alias("file"), F.col("text").alias("seq"), F.regexp_replace("text", "[^!-~]", "").alias("qual"))


_MQ = "SELECT doc_id, lang AS file, length, -10 * log10(greatest(list_avg(list_transform(list_filter(q, lambda v: v IS NOT NULL), lambda v: pow(10, -v / 10.0))), 1e-10)) AS mean_q FROM x"


@query("read_quality", _Q + f"SELECT doc_id, round(mean_q, 5) AS mean_q FROM ({_MQ}) y")
def read_quality(s, d):
    return reads.read_table(_as_reads(s, d)).select("doc_id", F.round("mean_q", 5).alias("mean_q"))


@query("read_statistics", _Q + f""", y AS ({_MQ}), o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY length DESC) AS r, count(*) OVER (PARTITION BY file) AS n, sum(length) OVER (PARTITION BY file ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER (PARTITION BY file) AS t FROM y)
SELECT file, count(*) AS reads, sum(length)::BIGINT AS bases, round(avg(length), 5) AS mean_length, round(avg(mean_q), 4) AS mean_q, max(CASE WHEN r = n // 2 + 1 THEN length END) AS median_length, max(CASE WHEN run >= t / 2.0 THEN length END) AS n50, round(100.0 * avg((mean_q >= 30)::INT), 4) AS q30_pct FROM o GROUP BY 1""")
def read_statistics(s, d):
    out = reads.read_statistics(_as_reads(s, d))
    return out.select("file", "reads", "bases", F.round("mean_length", 5).alias("mean_length"), F.round("mean_q", 4).alias("mean_q"), "median_length", "n50", F.round("q30_pct", 4).alias("q30_pct"))


@query("length_histogram", "SELECT lang AS file, length(text) // 500 * 500 AS bin, count(*) AS reads, sum(length(text))::BIGINT AS bases FROM documents GROUP BY 1, 2")
def length_histogram(s, d):
    return reads.histogram(table(s, d, "documents").select(F.col("lang").alias("file"), F.length("text").alias("length")), ["file"], "length", 500)


_P = _Q + ", z AS (SELECT lang AS file, unnest(range(0, len(q))) AS pos, unnest(q) AS q FROM x), c AS (SELECT file, pos, q, count(*) AS n FROM z WHERE q IS NOT NULL GROUP BY 1, 2, 3) "


@query("position_quality", _P + "SELECT file, pos, q, n FROM c")
def position_quality(s, d):
    return reads.position_quality(_as_reads(s, d))


@query("position_quantiles", _P + """, r AS (SELECT *, sum(n) OVER (PARTITION BY file, pos ORDER BY q ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY file, pos) AS a FROM c)
SELECT file, pos, round(sum(q * n) / sum(n), 5) AS mean_q, min(CASE WHEN run >= 0.25 * a THEN q END) AS q25, min(CASE WHEN run >= 0.5 * a THEN q END) AS q50, min(CASE WHEN run >= 0.75 * a THEN q END) AS q75 FROM r GROUP BY 1, 2""")
def position_quantiles(s, d):
    out = reads.position_quantiles(reads.position_quality(_as_reads(s, d)))
    return out.withColumn("mean_q", F.round("mean_q", 5))


@query("assembly_summary", """WITH x AS (SELECT o_custkey AS bin, o_totalprice AS length, o_orderkey % 100 AS gc, 1 + o_orderkey % 7 AS depth FROM orders), r AS (SELECT *, sum(length) OVER (PARTITION BY bin ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER (PARTITION BY bin) AS t FROM x)
SELECT bin, count(*) AS contigs, round(max(t), 2) AS total, max(CASE WHEN run >= t / 2 THEN length END) AS n50, round(sum(gc * length) / sum(length), 5) AS gc, round(sum(depth * length) / sum(length), 5) AS depth FROM r GROUP BY 1""")
def assembly_summary(s, d):
    c = table(s, d, "orders").select(F.col("o_custkey").alias("bin"), F.col("o_totalprice").cast("double").alias("length"), (F.col("o_orderkey") % 100).alias("gc"), (1 + F.col("o_orderkey") % 7).alias("depth"))
    out = genomes.assembly_summary(c, ["bin"])
    return out.select("bin", "contigs", F.round("total", 2).alias("total"), "n50", F.round("gc", 5).alias("gc"), F.round("depth", 5).alias("depth"))


_BIN = "WITH x AS (SELECT l_orderkey AS bin, l_linenumber AS contig, l_quantity::BIGINT AS length, CASE WHEN ('M' || l_linenumber) <> 'M7' THEN ('M' || l_linenumber) END AS genus, l_returnflag AS species FROM lineitem) "


def _contigs(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("bin"), F.col("l_linenumber").alias("contig"), F.col("l_quantity").cast("long").alias("length"), F.when(mode() != "M7", mode()).alias("genus"), F.col("l_returnflag").alias("species"))


@query("bin_species", _BIN + ", t AS (SELECT bin, sum(length) AS t FROM x WHERE genus IS NOT NULL GROUP BY 1), v AS (SELECT bin, species, sum(length) AS v, row_number() OVER (PARTITION BY bin ORDER BY sum(length) DESC, species) AS r FROM x WHERE genus IS NOT NULL GROUP BY 1, 2) SELECT b.bin, CASE WHEN v >= 0.5 * t THEN species END AS species FROM (SELECT DISTINCT bin FROM x) b LEFT JOIN t USING (bin) LEFT JOIN (SELECT * FROM v WHERE r = 1) w USING (bin)")
def bin_species(s, d):
    return genomes.bin_species(_contigs(s, d).withColumn("classified", F.col("genus").isNotNull()))


@query("split_bins", _BIN + """, t AS (SELECT bin, sum(length) AS t FROM x GROUP BY 1), g AS (SELECT bin, genus, sum(length) AS g FROM x WHERE genus IS NOT NULL GROUP BY 1, 2), k AS (SELECT g.*, count(*) OVER (PARTITION BY bin) AS n, row_number() OVER (PARTITION BY bin ORDER BY g DESC, genus) AS r FROM g JOIN t USING (bin) WHERE g >= 30 AND g >= 0.15 * t)
SELECT x.bin, x.contig, coalesce(k.genus, f.genus) AS part FROM x JOIN (SELECT * FROM k WHERE r = 1 AND n > 1) f ON x.bin = f.bin LEFT JOIN k ON x.bin = k.bin AND x.genus = k.genus""")
def split_bins(s, d):
    return genomes.split_bins(_contigs(s, d), least_length=30)


@query("quality_tiers", "SELECT p_partkey AS id, CASE WHEN p_size * 2 > 90 AND p_partkey % 20 < 5 THEN 'High' WHEN p_size * 2 >= 50 AND p_partkey % 20 < 10 THEN 'Medium' ELSE 'Low' END AS tier FROM part")
def quality_tiers(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), genomes.tier(F.col("p_size") * 2, F.col("p_partkey") % 20).alias("tier"))


_HOSTS = """WITH x AS (SELECT l_partkey AS gene, l_returnflag <> 'A' AS classified, CASE WHEN ('M' || l_linenumber) <> 'M7' THEN l_linestatus END AS genus, CASE WHEN ('M' || l_linenumber) NOT IN ('M7', 'M1') THEN l_linestatus || ' ' || CASE WHEN l_quantity > 10 THEN 'maior' ELSE 'minor' END END AS species FROM lineitem), o AS (SELECT * FROM x WHERE classified),
t AS (SELECT gene, count(*) AS n FROM o GROUP BY 1), g AS (SELECT gene, genus, count(*) AS gc, row_number() OVER (PARTITION BY gene ORDER BY count(*) DESC, genus) AS r FROM o WHERE genus IS NOT NULL GROUP BY 1, 2),
s AS (SELECT gene, genus, species, count(*) AS sc, row_number() OVER (PARTITION BY gene, genus ORDER BY count(*) DESC, species) AS r FROM o WHERE genus IS NOT NULL AND species IS NOT NULL GROUP BY 1, 2, 3)
SELECT t.gene, CASE WHEN sc >= 0.7 * gc THEN species ELSE g.genus END AS host_taxon, round_even(100.0 * gc / n, 1) AS host_share, CASE WHEN gc >= 0.6 * n THEN 'clear' WHEN gc IS NOT NULL THEN 'mixed' END AS host_status, n AS host_reads
FROM t LEFT JOIN (SELECT * FROM g WHERE r = 1) g ON t.gene = g.gene LEFT JOIN (SELECT * FROM s WHERE r = 1) s ON s.gene = g.gene AND s.genus = g.genus"""


@query("gene_hosts", _HOSTS)
def gene_hosts(s, d):
    r = table(s, d, "lineitem").select(
        F.col("l_partkey").alias("gene"), (F.col("l_returnflag") != "A").alias("classified"), F.when(mode() != "M7", F.col("l_linestatus")).alias("genus"),
        F.when(~mode().isin("M7", "M1"), F.concat_ws(" ", "l_linestatus", F.when(F.col("l_quantity") > 10, "maior").otherwise("minor"))).alias("species"),
    )
    return genomes.gene_hosts(r)


@query("panel_values", """WITH w AS (SELECT ('M' || l_linenumber) AS sample, p_brand || ': ' || p_name AS feature, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
p AS (SELECT * FROM (VALUES ('a', 'g1'), ('a', 'g2'), ('b', 'g3'), ('b', 'g4')) v(panel, gene)), f AS (SELECT sample, 'a' AS panel, 'g1' AS gene, value FROM w WHERE split_part(feature, ':', 1) IN ('Brand#11', 'Brand#12')
UNION ALL SELECT sample, 'a', 'g2', value FROM w WHERE split_part(feature, ':', 1) = 'Brand#23' UNION ALL SELECT sample, 'b', 'g3', value FROM w WHERE regexp_matches(lower(feature), '#5[1-3]:'))
SELECT s.sample, p.panel, p.gene, round(coalesce(sum(value), 0), 6) AS cpm FROM (SELECT DISTINCT sample FROM w) s CROSS JOIN p LEFT JOIN f ON f.sample = s.sample AND f.panel = p.panel AND f.gene = p.gene GROUP BY 1, 2, 3""")
def panel_values(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w = li.groupBy(mode().alias("sample"), F.concat_ws(": ", "p_brand", "p_name").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("value")).withColumn("taxon", F.lit(None).cast("string"))
    panels = s.createDataFrame([("a", "g1", ["Brand#11", "Brand#12"], None), ("a", "g2", ["Brand#23"], None), ("b", "g3", [], "#5[1-3]:"), ("b", "g4", [], "nothing like this")], "panel string, gene string, ko array<string>, pattern string")
    return genomes.panel_values(w, panels, w)


_TETRA = _SEQ + """, y AS (SELECT lang, seq, length(seq) AS n FROM x WHERE length(seq) >= 4),
k0 AS (SELECT lang, unnest(list_transform(range(1, n - 2), lambda p: substr(seq, p, 4))) AS kmer FROM y UNION ALL SELECT lang, unnest(list_transform(range(1, n - 1), lambda p: substr(seq, p, 3))) FROM y UNION ALL SELECT lang, unnest(list_transform(range(1, n), lambda p: substr(seq, p, 2))) FROM y),
k1 AS (SELECT lang, kmer, count(*) AS c FROM k0 GROUP BY 1, 2), k AS (SELECT lang, kmer, sum(c)::DOUBLE AS c FROM (SELECT lang, kmer, c FROM k1 UNION ALL SELECT lang, reverse(translate(kmer, 'ACGT', 'TGCA')), c FROM k1) u GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS a), t AS (SELECT p.a || q.a || r.a || s.a AS kmer FROM l p, l q, l r, l s),
g AS (SELECT name, t.kmer, coalesce(k4.c, 0) AS n4, coalesce(ka.c, 0) AS a, coalesce(kb.c, 0) AS b, coalesce(km.c, 0) AS m FROM (SELECT DISTINCT lang AS name FROM documents WHERE lang IS NOT NULL) n CROSS JOIN t
 LEFT JOIN k k4 ON k4.lang = name AND k4.kmer = t.kmer LEFT JOIN k ka ON ka.lang = name AND ka.kmer = substr(t.kmer, 1, 3) LEFT JOIN k kb ON kb.lang = name AND kb.kmer = substr(t.kmer, 2, 3) LEFT JOIN k km ON km.lang = name AND km.kmer = substr(t.kmer, 2, 2)),
v AS (SELECT *, a * b / nullif(m, 0) AS e, a * b / nullif(m, 0) * (m - a) * (m - b) / (nullif(m, 0) * m) AS var FROM g)
SELECT name, kmer, round(CASE WHEN var > 0 THEN (n4 - e) / sqrt(var) ELSE 0 END, 6) AS z FROM v"""


@query("tetramer_profile", _TETRA)
def tetramer_profile(s, d):
    return genomes.tetramer_profile(_sequences(s, d).select(F.col("lang").alias("name"), "seq")).withColumn("z", F.round("z", 6))


_PRIMER = _SEQ + """, o AS (SELECT doc_id, seq, unnest(range(0, greatest(least(length(seq), 30) - 5, 1))) AS start FROM x),
m AS (SELECT doc_id, start, (substr(seq, start + 1, 1) <> 'A')::INT + (substr(seq, start + 2, 1) <> 'C')::INT + (substr(seq, start + 3, 1) NOT IN ('A', 'C', 'G', 'T'))::INT + (substr(seq, start + 4, 1) <> 'T')::INT + (substr(seq, start + 5, 1) NOT IN ('A', 'G'))::INT + (substr(seq, start + 6, 1) <> 'G')::INT AS mismatches FROM o),
b AS (SELECT doc_id, mismatches, start, row_number() OVER (PARTITION BY doc_id ORDER BY mismatches, start) AS r FROM m)
SELECT x.doc_id, b.mismatches::INT AS mismatches, b.start::INT AS start FROM x LEFT JOIN b ON b.doc_id = x.doc_id AND r = 1"""


@query("primer_matches", _PRIMER)
def primer_matches(s, d):
    m = sq.best_primer_match("seq", "ACNTRG")
    return _sequences(s, d).select("doc_id", m.alias("m")).select("doc_id", F.col("m.mismatches").cast("int").alias("mismatches"), F.col("m.start").cast("int").alias("start"))


_FAMILIES = """WITH c AS (SELECT p_partkey AS tname, CAST(p_partkey AS VARCHAR) AS allele, p_brand AS symbol, p_type AS class FROM part),
h AS (SELECT c.*, l_orderkey || '-' || l_linenumber AS qname, (l_quantity::BIGINT - 1) * 18 AS ts, least(1000, (l_quantity::BIGINT - 1) * 18 + 150) AS te, 1 - l_discount::DOUBLE AS identity FROM lineitem JOIN c ON l_partkey = tname),
k AS (SELECT * FROM h WHERE identity >= 0.9 AND te - ts >= 50),
n AS (SELECT symbol, tname, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, tname) AS r FROM k GROUP BY 1, 2),
rep AS (SELECT n.symbol, c.allele, c.class FROM n JOIN c USING (tname) WHERE r = 1),
s AS (SELECT symbol, count(DISTINCT qname) AS reads, sum(te - ts) AS bases, avg(identity) AS identity FROM k GROUP BY 1),
i AS (SELECT symbol, ts AS a, te AS b, max(te) OVER (PARTITION BY symbol ORDER BY ts, te ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
u AS (SELECT symbol, sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) AS covered FROM i GROUP BY 1)
SELECT symbol AS gene, allele, 'AMR' AS type, class, 1000 AS length, reads, round_even(100 * covered / 1000.0, 1)::DOUBLE AS breadth, round_even(bases / 1000.0, 2)::DOUBLE AS depth, round_even(reads / 1.0, 2)::DOUBLE AS rpkm, round_even(100 * identity, 2)::DOUBLE AS identity
FROM rep JOIN s USING (symbol) JOIN u USING (symbol) WHERE 100 * covered / 1000.0 >= 60"""


@query("gene_families", _FAMILIES)
def gene_families(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("tname"), F.col("p_partkey").cast("string").alias("allele"), F.col("p_brand").alias("symbol"), F.lit(1000).alias("length"), F.lit("AMR").alias("type"), F.col("p_type").alias("class"))
    li = table(s, d, "lineitem")
    ts = (F.col("l_quantity").cast("long") - 1) * 18
    paf = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("qname"), F.lit(150).alias("qlen"), F.lit(0).alias("qs"), F.lit(150).alias("qe"), F.col("l_partkey").alias("tname"), F.lit(1000).alias("tlen"), ts.alias("ts"), F.least(F.lit(1000), ts + 150).alias("te"), F.lit(148).alias("nmatch"), F.lit(150).alias("alen"), F.col("l_discount").cast("double").alias("de"))
    return genomes.gene_families(paf, part, 1e6)
