"""Queries on 16S genes, reference collections and whole-genome alignments."""

from pyspark.sql import functions as F

from quadrat.operators import diversity, ordination, rrna
from quadrat.plans.analogue import BASE, as_features, genus_counts, query, site_counts, site_groups, table
from quadrat.plans.diversity_queries import _EXPECTED, _site_distances
from quadrat.plans.reads_queries import _SEQ, _sequences
from quadrat.sources import alignments, references

_F16 = _SEQ + """, f AS (SELECT source AS sample, d.doc_id, CAST(d.doc_id AS VARCHAR) AS contig, 1 + d.doc_id % 50 AS "start", 300 + d.doc_id % 90 AS "end", CASE WHEN d.doc_id % 2 = 0 THEN '-' ELSE '+' END AS strand, d.doc_id % 7 = 0 AS partial FROM documents d WHERE d.doc_id % 3 > 0),
c AS (SELECT f.*, substr(coalesce(seq, ''), "start", "end" - "start" + 1) AS part FROM f JOIN x USING (doc_id)), e AS (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(part, 'ACGT', 'TGCA')) ELSE part END AS seq2 FROM c), w AS (SELECT *, length(seq2) >= 280 AND NOT partial AS whole FROM e)
SELECT sample, CASE WHEN whole THEN (sum(whole::INT) OVER (PARTITION BY sample ORDER BY doc_id, "start" ROWS UNBOUNDED PRECEDING))::BIGINT END AS copy, contig, "start", "end", strand, md5(seq2) AS seq, whole FROM w"""


@query("gene_copies", _F16)
def gene_copies(s, d):
    docs = _sequences(s, d).join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    k = F.col("doc_id")
    seqs = docs.select(F.col("source").alias("sample"), k.cast("string").alias("contig"), "seq")
    f = docs.select(F.col("source").alias("sample"), k.cast("string").alias("contig"), (1 + k % 50).alias("start"), (300 + k % 90).alias("end"), F.when(k % 2 == 0, "-").otherwise("+").alias("strand"), F.when(k % 3 > 0, "16S_rRNA").otherwise("23S_rRNA").alias("name"), (k % 7 == 0).alias("partial"))
    return rrna.gene_copies(f, seqs, least=280).withColumn("seq", F.md5("seq"))


_COPY = """WITH h AS (SELECT l_orderkey AS copy, l_partkey AS target, 90 + floor(l_quantity) / 10.0::DOUBLE AS pident, CASE WHEN p_size % 9 > 0 THEN CASE WHEN p_size % 13 = 0 THEN '[' || p_name || ']' ELSE p_name END END AS species, CASE WHEN p_size % 9 > 0 THEN split_part(CASE WHEN p_size % 13 = 0 THEN '[' || p_name || ']' ELSE p_name END, ' ', 1) ELSE p_brand END AS g FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT * FROM (SELECT *, max(pident) OVER (PARTITION BY copy) AS best FROM h) x WHERE pident >= best - 1.0),
f AS (SELECT copy, g AS fg FROM (SELECT *, row_number() OVER (PARTITION BY copy ORDER BY pident DESC, target DESC) AS r FROM t) x WHERE r = 1),
sp AS (SELECT copy, species, g, max(pident) AS p FROM t WHERE species IS NOT NULL GROUP BY 1, 2, 3), v AS (SELECT copy, g, count(*) AS v FROM sp WHERE species NOT LIKE '[%' GROUP BY 1, 2),
vr AS (SELECT v.*, fg, row_number() OVER (PARTITION BY v.copy ORDER BY v DESC, (g = fg)::INT DESC, g) AS r, v = max(v) OVER (PARTITION BY v.copy) AS m FROM v JOIN f USING (copy)), w AS (SELECT copy, CASE WHEN count(*) FILTER (WHERE m) > 1 THEN any_value(fg) ELSE max(g) FILTER (WHERE r = 1) END AS voted FROM vr GROUP BY 1),
b AS (SELECT t.copy, max(best) AS identity, coalesce(any_value(voted), any_value(fg)) AS genus FROM t JOIN f USING (copy) LEFT JOIN w ON w.copy = t.copy GROUP BY 1),
l AS (SELECT b.copy, any_value(identity) AS identity, any_value(b.genus) AS genus, list(species ORDER BY p DESC, species) FILTER (WHERE split_part(species, ' ', 1) = b.genus) AS main, list(species ORDER BY p DESC, species) FILTER (WHERE species IS NOT NULL) AS al, list(species ORDER BY p DESC, species) FILTER (WHERE split_part(species, ' ', 1) <> b.genus AND species NOT LIKE '[%') AS odd FROM b LEFT JOIN sp USING (copy) GROUP BY 1),
copies AS (SELECT copy, round(identity, 2) AS identity, genus, coalesce(main, al, []) AS tied, coalesce(odd, []) AS odd FROM l) """


def _copies(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("p_size")
    name = F.when(n % 13 == 0, F.concat(F.lit("["), "p_name", F.lit("]"))).otherwise(F.col("p_name"))
    return rrna.named_copies(li.select(F.col("l_orderkey").alias("copy"), F.col("l_partkey").alias("target"), (90 + F.floor("l_quantity") / 10).alias("pident"), F.when(n % 9 > 0, name).alias("species"), F.col("p_brand").alias("genus")), tie=1.0)


@query("named_copies", _COPY + "SELECT copy, identity, genus, tied[1] AS species, array_to_string(tied, '; ') AS tied, len(tied)::INT AS n_tied, array_to_string(odd, '; ') AS off_genus FROM copies")
def named_copies(s, d):
    return _copies(s, d).withColumn("tied", F.array_join("tied", "; ")).withColumn("off_genus", F.array_join("off_genus", "; "))


@query("agreed_names", _COPY + """, c AS (SELECT copy % 200 AS sample, copy, genus, tied FROM copies), g AS (SELECT sample, genus AS g FROM (SELECT sample, genus, row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, min(copy)) AS r FROM c GROUP BY 1, 2) x WHERE r = 1),
e AS (SELECT c.*, g, list_filter(tied, lambda x: split_part(x, ' ', 1) = g) AS ties FROM c LEFT JOIN g USING (sample)), n AS (SELECT sample, count(*) FILTER (WHERE len(ties) > 0) AS sets, max(len(tied)) AS max_tied, any_value(g) AS genus FROM e GROUP BY 1),
u AS (SELECT sample, name, count(*) AS k FROM (SELECT sample, copy, unnest(list_distinct(ties)) AS name FROM e) x GROUP BY 1, 2), l2 AS (SELECT n.sample, list(name ORDER BY name) FILTER (WHERE k = sets) AS common, list(name ORDER BY name) FILTER (WHERE name IS NOT NULL) AS un FROM n LEFT JOIN u USING (sample) GROUP BY 1)
SELECT n.sample, genus, CASE WHEN len(common) = 1 THEN common[1] ELSE coalesce(genus || ' sp.', '') || CASE WHEN len(coalesce(common, un, [])) > 0 THEN ' (16S ties: ' || array_to_string(coalesce(common, un)[1:4], ', ') || ')' ELSE '' END END AS species, coalesce(len(common) = 1, false) AS resolved, max_tied::INT AS max_tied FROM n JOIN l2 USING (sample)""")
def agreed_names(s, d):
    return rrna.agreed_names(_copies(s, d).select((F.col("copy") % 200).alias("sample"), "copy", "genus", "tied"))


@query("grouped_names", """WITH h AS (SELECT l_orderkey AS query, l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT AS place, l_partkey AS taxid, 50 + l_quantity AS pident, CASE WHEN l_linenumber % 5 = 0 THEN 70.0 ELSE 90.0 END AS qcov, 1000.0 - floor(l_quantity / 20) AS bits FROM lineitem),
ln AS (SELECT p_partkey AS taxid, CASE p_size % 5 WHEN 0 THEN 'Bacteria' WHEN 1 THEN 'Eukaryota' WHEN 2 THEN 'Viruses' WHEN 3 THEN 'Eukaryota' ELSE '' END AS sk, CASE p_size % 5 WHEN 1 THEN 'Fungi' ELSE 'Protista' END AS k, p_type AS phylum, p_brand AS family, CASE WHEN p_size % 4 > 0 THEN p_name ELSE '' END AS genus FROM part WHERE p_size % 11 > 0),
t AS (SELECT h.*, first_value(bits) OVER w AS tb, first_value(pident) OVER w AS tp, first_value(qcov) OVER w AS tc FROM h WINDOW w AS (PARTITION BY query ORDER BY place)), u AS (SELECT * FROM t WHERE bits >= 0.995 * tb),
j AS (SELECT u.*, CASE WHEN sk = 'Bacteria' THEN sk WHEN sk = 'Viruses' THEN 'Viruses' WHEN sk = 'Eukaryota' THEN CASE WHEN k = 'Fungi' THEN 'Fungi' ELSE 'Other eukaryotes' END ELSE 'Unclassified record' END AS grp, coalesce(phylum, '') AS phylum, coalesce(family, '') AS family, coalesce(genus, '') AS genus FROM u LEFT JOIN ln USING (taxid)),
a AS (SELECT query, count(*) AS ties, CASE WHEN count(DISTINCT grp) = 1 THEN max(grp) ELSE 'Unclassified record' END AS grp, any_value(tp) AS tp, any_value(tc) AS tc, CASE WHEN count(DISTINCT genus) = 1 THEN nullif(max(genus), '') END AS g, CASE WHEN count(DISTINCT family) = 1 THEN nullif(max(family), '') END AS f, CASE WHEN count(DISTINCT phylum) = 1 THEN nullif(max(phylum), '') END AS p FROM j GROUP BY 1),
r AS (SELECT *, CASE WHEN tc >= 80 AND tp >= 95 AND g IS NOT NULL THEN 'genus' WHEN tc >= 80 AND tp >= 90 AND f IS NOT NULL THEN 'family' WHEN tc >= 80 AND tp >= 80 AND p IS NOT NULL THEN 'phylum' ELSE 'group' END AS rank FROM a)
SELECT o_orderkey AS query, coalesce(grp, 'No match') AS grp, coalesce(CASE rank WHEN 'genus' THEN g WHEN 'family' THEN f WHEN 'phylum' THEN p ELSE grp END, 'No match') AS named_as, coalesce(rank, '') AS rank, coalesce(ties, 0) AS ties FROM orders LEFT JOIN r ON query = o_orderkey""")
def grouped_names(s, d):
    n = F.col("p_size")
    hits = table(s, d, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("place"), F.col("l_partkey").alias("taxid"), (50 + F.col("l_quantity")).alias("pident"), F.when(F.col("l_linenumber") % 5 == 0, 70.0).otherwise(90.0).alias("qcov"), (1000.0 - F.floor(F.col("l_quantity") / 20)).alias("bits"))
    lin = table(s, d, "part").where("p_size % 11 > 0").select(F.col("p_partkey").alias("taxid"), F.when(n % 5 == 0, "Bacteria").when(n % 5 == 2, "Viruses").when(n % 5 == 4, "").otherwise("Eukaryota").alias("superkingdom"), F.when(n % 5 == 1, "Fungi").otherwise("Protista").alias("kingdom"), F.col("p_type").alias("phylum"), F.col("p_brand").alias("family"), F.when(n % 4 > 0, F.col("p_name")).otherwise("").alias("genus"), F.col("p_name").alias("name"))
    return rrna.grouped_names(table(s, d, "orders").select(F.col("o_orderkey").alias("query")), hits, lin)


_NM = "WITH x AS (SELECT p_partkey AS id, p_name || CASE p_size % 3 WHEN 0 THEN ' subsp. minor' ELSE ' strain' END || ' ATCC ' || p_size || CASE WHEN p_size % 2 = 0 THEN 'T' ELSE ' (T)' END AS h FROM part) "


@query("strain_names", _NM + "SELECT id, CASE WHEN contains(h, 'subsp.') THEN array_to_string(string_split(h, ' ')[1:4], ' ') ELSE array_to_string(string_split(h, ' ')[1:2], ' ') END AS key, regexp_replace(regexp_replace(h, ' [(]T[)]$', ''), '([0-9])T$', '\\1') AS strain FROM x")
def strain_names(s, d):
    n = F.col("p_size")
    x = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(n % 3 == 0, " subsp. minor").otherwise(" strain"), F.lit(" ATCC "), n.cast("string"), F.when(n % 2 == 0, "T").otherwise(" (T)")).alias("h"))
    return x.select("id", rrna.species_key("h").alias("key"), rrna.clean_strain("h").alias("strain"))


@query("rrna_headers", "SELECT p_partkey AS id, 'NR_' || p_partkey || '.1' AS accession, p_name AS species, 'ATCC ' || p_size AS strain FROM part WHERE len(string_split(p_name, ' ')) = 2")
def rrna_headers(s, d):
    h = F.concat(F.lit("NR_"), F.col("p_partkey").cast("string"), F.lit(".1 "), "p_name", F.lit(" strain ATCC "), F.col("p_size").cast("string"), F.lit("T 16S ribosomal RNA, partial sequence"))
    return table(s, d, "part").where("size(split(p_name, ' ')) = 2").select(F.col("p_partkey").alias("id"), rrna.rrna_header(h).alias("x")).select("id", "x.*")


@query("read_orientation", "SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity > 25)::INT + (l_discount > 0.05)::INT > (l_tax > 0.04)::INT + (l_linenumber > 3)::INT THEN 'forward' WHEN (l_quantity > 25)::INT + (l_discount > 0.05)::INT < (l_tax > 0.04)::INT + (l_linenumber > 3)::INT THEN 'flipped' ELSE 'ambiguous' END AS way FROM lineitem")
def read_orientation(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("f1"), (F.col("l_discount") > 0.05).alias("r2"), (F.col("l_tax") > 0.04).alias("r1"), (F.col("l_linenumber") > 3).alias("f2"))
    return li.select("l_orderkey", "l_linenumber", rrna.orientation("f1", "r2", "r1", "f2").alias("way"))


_AMP = _SEQ + """, y AS (SELECT doc_id, seq AS a, reverse(translate(seq, 'ACGT', 'TGCA')) AS b FROM x),
z AS (SELECT doc_id, a, b, instr(a, regexp_extract(a, 'AC.TG')) * (regexp_extract(a, 'AC.TG') <> '')::INT AS a1, instr(a, regexp_extract(a, 'GG.AA')) * (regexp_extract(a, 'GG.AA') <> '')::INT AS a2, instr(b, regexp_extract(b, 'AC.TG')) * (regexp_extract(b, 'AC.TG') <> '')::INT AS b1, instr(b, regexp_extract(b, 'GG.AA')) * (regexp_extract(b, 'GG.AA') <> '')::INT AS b2 FROM y),
p AS (SELECT doc_id, CASE WHEN a1 > 0 AND a2 > a1 + 5 THEN substr(a, a1 + 5, a2 - a1 - 5) END AS pa, CASE WHEN b1 > 0 AND b2 > b1 + 5 THEN substr(b, b1 + 5, b2 - b1 - 5) END AS pb FROM z)
SELECT doc_id, coalesce(CASE WHEN length(pa) BETWEEN 3 AND 400 THEN pa END, CASE WHEN length(pb) BETWEEN 3 AND 400 THEN pb END) AS amplicon FROM p"""


@query("amplicons", _AMP)
def amplicons(s, d):
    return _sequences(s, d).select("doc_id", rrna.amplicon("seq", "AC.TG", "GG.AA", 3, 400).alias("amplicon"))


def _lineages(s, d):
    n = F.col("p_size")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(n % 3 > 0, F.col("p_type")).alias("phylum"), F.when(n % 4 > 0, F.concat(F.lit("c "), "p_type")).otherwise("").alias("class"), F.lit("").alias("order"), F.when(n % 7 > 0, F.concat(F.lit("f "), "p_brand")).alias("family"), F.when(n % 5 > 0, F.col("p_brand")).otherwise("").alias("genus"), F.concat("p_brand", F.lit(" x")).alias("species"))


@query("filled_lineages", """WITH l AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_type END AS phylum, CASE WHEN p_size % 4 > 0 THEN 'c ' || p_type ELSE '' END AS class, '' AS "order", CASE WHEN p_size % 7 > 0 THEN 'f ' || p_brand END AS family, CASE WHEN p_size % 5 > 0 THEN p_brand ELSE '' END AS genus, p_brand || ' x' AS species FROM part),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY id) AS r FROM l WHERE coalesce(phylum, '') <> '' AND coalesce(class, '') <> '' AND genus <> '') x WHERE r = 1)
SELECT l.id, CASE WHEN ok THEN l.phylum ELSE coalesce(nullif(l.phylum, ''), u.phylum, l.phylum) END AS phylum, CASE WHEN ok THEN l.class ELSE coalesce(nullif(l.class, ''), u.class, l.class) END AS class, '' AS "order", CASE WHEN ok THEN l.family ELSE coalesce(nullif(l.family, ''), u.family, l.family) END AS family, CASE WHEN ok THEN l.genus ELSE coalesce(nullif(l.genus, ''), u.genus, l.genus) END AS genus, l.species
FROM (SELECT *, coalesce(phylum, '') <> '' AND coalesce(class, '') <> '' AS ok FROM l) l LEFT JOIN u ON u.genus = coalesce(nullif(l.genus, ''), split_part(l.species, ' ', 1))""")
def filled_lineages(s, d):
    return references.filled_lineages(_lineages(s, d))


@query("gene_regions", "SELECT accession, a AS \"start\", a + 100 AS \"end\", 1 AS strand, p_brand AS family FROM (SELECT l_partkey AS accession, min(l_linenumber) AS a FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) x JOIN part ON p_partkey = accession WHERE accession NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 49)")
def gene_regions(s, d):
    li = table(s, d, "lineitem")
    ann = li.select(F.col("l_partkey").alias("accession"), F.col("l_returnflag").alias("gene"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 100).alias("end"), F.lit(1).alias("strand"))
    judged = li.select(F.col("l_partkey").alias("accession"), F.col("l_returnflag").alias("gene"), F.when(F.col("l_quantity") > 49, "Heterospecific").otherwise("Conspecific").alias("judge"))
    part = table(s, d, "part")
    return references.gene_regions(ann, judged, part.select(F.col("p_partkey").alias("accession"), F.col("p_partkey").alias("species_id")), part.select(F.col("p_partkey").alias("species_id"), F.col("p_brand").alias("family")), "N")


_HEAD = "SELECT '>Bacteria;' || p_type || 'ati;' || p_brand || ';c;o;f' || CASE WHEN p_size % 6 > 0 THEN ';' || p_brand || CASE WHEN p_size % 5 > 0 THEN ';' || p_brand || ' x' ELSE ';y1' END ELSE '' END AS header FROM part"


def _headers(s, d):
    n = F.col("p_size")
    tail = F.when(n % 6 > 0, F.concat(F.lit(";"), "p_brand", F.when(n % 5 > 0, F.concat(F.lit(";"), "p_brand", F.lit(" x"))).otherwise(";y1"))).otherwise("")
    return table(s, d, "part").select(F.concat(F.lit(">Bacteria;"), "p_type", F.lit("ati;"), "p_brand", F.lit(";c;o;f"), tail).alias("header"))


@query("inspected_reference", f"WITH h AS ({_HEAD}), p AS (SELECT string_split(substr(header, 2), ';') AS p FROM h), f AS (SELECT p, len(p) AS d FROM p) SELECT count(*) AS n, max(d)::INT AS depth, 'trainset' AS kind, avg(CASE WHEN d = 8 THEN (starts_with(p[8], p[7] || ' '))::INT END) > 0.5 AS has_species, avg((p[2] LIKE '%ati')::INT) > 0.5 AS has_kingdom, false AS numbered FROM f")
def inspected_reference(s, d):
    return references.inspected(_headers(s, d))


@query("lineage_count", f"SELECT count(DISTINCT header) AS lineages, count(DISTINCT header) * 65536 * 4 / 1e9::DOUBLE AS gigabytes FROM ({_HEAD}) x")
def lineage_count(s, d):
    return references.lineage_count(_headers(s, d))


@query("exact_species", """WITH q AS (SELECT p_partkey AS feature_id, p_name AS seq, p_brand AS genus FROM part), r AS (SELECT p_name AS seq, p_brand AS genus, p_type AS species FROM part WHERE p_size % 2 = 0),
s AS (SELECT feature_id, count(DISTINCT species) AS n, max(species) AS species FROM q JOIN r ON upper(q.seq) = upper(r.seq) AND q.genus = r.genus GROUP BY 1) SELECT q.feature_id, CASE WHEN n = 1 THEN species END AS species FROM q LEFT JOIN s USING (feature_id)""")
def exact_species(s, d):
    part = table(s, d, "part")
    q = part.select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("seq"), F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, "--other").otherwise("")).alias("genus"))
    return references.exact_species(q, part.where("p_size % 2 = 0").select(F.lower("p_name").alias("seq"), F.col("p_brand").alias("genus"), F.col("p_type").alias("species")))


_ALN = "WITH a AS (SELECT l_returnflag AS pair, 'r' || (l_partkey % 5) AS ref, 'q' || (l_suppkey % 5) AS query, l_orderkey % 5000 AS rs, l_orderkey % 5000 + 99 AS re, l_orderkey % 3000 AS qs, l_orderkey % 3000 + 89 AS qe, l_linenumber AS errors FROM lineitem)"


def _alignments(s, d):
    k = F.col("l_orderkey")
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("pair"), F.concat(F.lit("r"), (F.col("l_partkey") % 5).cast("string")).alias("ref"), F.concat(F.lit("q"), (F.col("l_suppkey") % 5).cast("string")).alias("query"), (k % 5000).alias("rs"), (k % 5000 + 99).alias("re"), (k % 3000).alias("qs"), (k % 3000 + 89).alias("qe"), F.col("l_linenumber").cast("long").alias("errors"))


def _covered(name, a, b, out):
    return f", i_{out} AS (SELECT pair, {name} AS seq, {a} AS a, {b} AS b, max({b}) OVER (PARTITION BY pair, {name} ORDER BY {a}, {b} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a), u_{out} AS (SELECT pair, sum(greatest(b - greatest(a, coalesce(reach + 1, a)) + 1, 0))::BIGINT AS {out} FROM i_{out} GROUP BY 1)"


@query("alignment_identity", _ALN + _covered("ref", "rs", "re", "ref_aligned") + _covered("query", "qs", "qe", "query_aligned") + " SELECT pair, round(ani, 6) AS ani, ref_aligned, query_aligned FROM (SELECT pair, 100.0::DOUBLE * sum(190 - 2 * errors) / sum(190) AS ani FROM a GROUP BY 1) x JOIN u_ref_aligned USING (pair) JOIN u_query_aligned USING (pair)")
def alignment_identity(s, d):
    return alignments.alignment_identity(_alignments(s, d)).withColumn("ani", F.round("ani", 6))


_FRAG = "WITH f AS (SELECT l_returnflag AS pair, l_orderkey AS fragment, l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT AS place, 80 + l_quantity / 5 AS pident, 700 + l_partkey % 400 AS length, l_linenumber * 20 AS mism, l_linenumber AS gaps FROM lineitem), g AS (SELECT *, row_number() OVER (PARTITION BY pair, fragment ORDER BY place) AS r FROM f WHERE (length - gaps) / 1020.0 > 0.7 AND (length - gaps - mism) / 1020.0 > 0.3), o AS (SELECT pair, avg(pident) AS ani, sum(length - gaps)::BIGINT AS aligned, count(*) AS fragments FROM g WHERE r = 1 GROUP BY 1) "


def _fragments(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("pair"), F.col("l_orderkey").alias("fragment"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("place"), (80 + F.col("l_quantity") / 5).alias("pident"), (700 + F.col("l_partkey") % 400).alias("length"), (F.col("l_linenumber") * 20).alias("mismatches"), F.lit(1020).alias("qlen"), F.col("l_linenumber").alias("gaps"))


@query("fragment_identity", _FRAG + "SELECT pair, round(ani, 6) AS ani, aligned, fragments FROM o")
def fragment_identity(s, d):
    return alignments.fragment_identity(_fragments(s, d)).withColumn("ani", F.round("ani", 6))


@query("both_directions", _FRAG + "SELECT pair, round((ani + 90) / 2, 6) AS ani FROM o WHERE pair <> 'R' UNION ALL SELECT pair, round(ani, 6) FROM o WHERE pair = 'R'")
def both_directions(s, d):
    f = alignments.fragment_identity(_fragments(s, d))
    return alignments.both_directions(f, f.where("pair <> 'R'").select("pair", F.lit(90.0).alias("ani"))).withColumn("ani", F.round("ani", 6))


@query("differences", "SELECT p_partkey AS id, (p_size % 4)::INT AS substitutions, (p_size % 3)::INT AS indels, (2 * (p_size % 3))::INT AS indel_bases FROM part")
def differences(s, d):
    n = F.col("p_size")
    cs = F.concat(F.lit(":10"), F.expr("repeat('*ag:5', p_size % 4)"), F.expr("repeat('-tt:3', p_size % 3)"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), alignments.differences(cs).alias("x"), n.alias("n")).select("id", "x.*")


@query("rarefaction_steps", BASE + f", x AS (SELECT sample, sum(reads) AS big FROM e GROUP BY 1), k AS (SELECT least(max(big), 50000)::BIGINT AS top FROM x), st AS (SELECT unnest(range(100, top + 1, greatest(100, top // 50))) AS n FROM k UNION SELECT top FROM k), z AS (SELECT sample, big, n FROM x, st WHERE n <= big) SELECT sample, n AS depth, round({_EXPECTED}, 4) AS expected FROM z JOIN e USING (sample) GROUP BY sample, big, n")
def rarefaction_steps(s, d):
    return diversity.rarefaction_steps(as_features(site_counts(s, d))).withColumn("expected", F.round("expected", 4))


@query("rarefaction_common")
def rarefaction_common(s, d):
    return diversity.rarefaction_common(as_features(site_counts(s, d)))


@query("shannon_rarefaction")
def shannon_rarefaction(s, d):
    return diversity.shannon_rarefaction(as_features(site_counts(s, d)))


@query("pairwise_permanova")
def pairwise_permanova(s, d):
    return ordination.pairwise_permanova(_site_distances(s, d), site_groups(s, d))


@query("anosim_test")
def anosim_test(s, d):
    return ordination.anosim(_site_distances(s, d), site_groups(s, d))


@query("anosim_pairs")
def anosim_pairs(s, d):
    return ordination.anosim(_site_distances(s, d), site_groups(s, d), pairs=True)


@query("dispersion_test")
def dispersion_test(s, d):
    return ordination.dispersion(_site_distances(s, d), site_groups(s, d))


@query("centred_pca")
def centred_pca(s, d):
    return ordination.centred_pca(diversity.clr(genus_counts(s, d)))[0]


@query("centred_scree")
def centred_scree(s, d):
    return ordination.centred_pca(diversity.clr(genus_counts(s, d)))[1]


@query("dendrogram")
def dendrogram(s, d):
    return ordination.dendrogram(ordination.clusters(_site_distances(s, d)))


@query("ordered_stacks")
def ordered_stacks(s, d):
    from quadrat.operators import community

    return ordination.ordered_stacks(ordination.clusters(_site_distances(s, d)), community.top_taxa(site_counts(s, d), 10))


@query("rooted_tree")
def rooted_tree(s, d):
    return ordination.midpoint_rooted(ordination.neighbour_joining(_site_distances(s, d)))


@query("tree_layout")
def tree_layout(s, d):
    return ordination.tree_layout(rooted_tree(s, d))
