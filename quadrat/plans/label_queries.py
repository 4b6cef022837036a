"""Queries on names, keys and cells."""

from pyspark.sql import functions as F

from quadrat.functions import labels
from quadrat.functions.sequences import iupac_pattern
from quadrat.operators import naming, selection
from quadrat.plans.analogue import query, table
from quadrat.plans.reads_queries import _SEQ, _sequences
from quadrat.sources import classifiers, sinks

_NAMES = "WITH x AS (SELECT p_partkey AS id, p_name || CASE p_size % 5 WHEN 0 THEN '_' || p_partkey WHEN 1 THEN '_X' WHEN 2 THEN '_XXX' WHEN 3 THEN '_sp.' ELSE '' END AS n FROM part) "


def _names(s, d):
    n = F.col("p_size") % 5
    tail = F.when(n == 0, F.concat(F.lit("_"), F.col("p_partkey").cast("string"))).when(n == 1, "_X").when(n == 2, "_XXX").when(n == 3, "_sp.").otherwise("")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", tail).alias("n"))


@query("numbered_names", _NAMES + "SELECT id, regexp_replace(n, '_[0-9]+$', '') AS name FROM x")
def numbered_names(s, d):
    return _names(s, d).select("id", labels.clean_midori("n").alias("name"))


@query("undefined_names", _NAMES + "SELECT id, CASE WHEN NOT regexp_matches(n, '_X+$') AND NOT regexp_matches(n, '_sp[.]?$') THEN n END AS name, CASE WHEN NOT regexp_matches(n, '_X+$') AND NOT regexp_matches(n, '_sp[.]?$') THEN replace(n, '_', ' ') END AS species FROM x")
def undefined_names(s, d):
    return _names(s, d).select("id", labels.clean_pr2("n").alias("name"), labels.clean_pr2("n", species=True).alias("species"))


_BINOMIAL = "WITH x AS (SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name[1]) || substr(p_name, 2) WHEN 2 THEN upper(p_name[1]) || 'us sp. ' || p_size WHEN 3 THEN 'Uncultured bacterium' WHEN 4 THEN upper(p_name[1]) || 'a cf. minor' ELSE upper(p_name[1]) || substr(p_name, 2) || ' strain 7' END AS n FROM part) "


@query("valid_names", _BINOMIAL + "SELECT id, regexp_matches(n, '^[A-Z][a-z]+ [a-z][a-z-]+') AND NOT regexp_matches(n, '(?i)(^| )(sp|cf|aff|nr|gen|uncultured|environmental|unidentified|hybrid|x)\\.?( |$)') AS ok FROM x")
def valid_names(s, d):
    n, name = F.col("p_size") % 6, F.col("p_name")
    first, rest = F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000)
    x = F.when(n == 0, name).when(n == 1, F.concat(first, rest)).when(n == 2, F.concat(first, F.lit("us sp. "), F.col("p_size").cast("string"))).when(n == 3, "Uncultured bacterium").when(n == 4, F.concat(first, F.lit("a cf. minor"))).otherwise(F.concat(first, rest, F.lit(" strain 7")))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), labels.valid_binomial(x).alias("ok"))


@query("dna_texts", _SEQ + "SELECT doc_id, length(seq) >= 20 AND regexp_matches(seq, '^[ACGT]+$') AS of_seq, regexp_matches(text, '(?i)^[ACGTUNRYSWKMBDHV]{20,}$') AS of_text FROM x")
def dna_texts(s, d):
    return _sequences(s, d).select("doc_id", labels.is_dna("seq").alias("of_seq"), labels.is_dna("text").alias("of_text"))


@query("natural_keys", "SELECT p_partkey AS id, array_to_string(list_transform(regexp_extract_all(lower(n), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS key FROM (SELECT p_partkey, p_size || p_brand || '-' || p_partkey || 'b' AS n FROM part) x")
def natural_keys(s, d):
    n = F.concat(F.col("p_size").cast("string"), F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit("b"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), labels.natural_key(n).alias("key"))


@query("safe_names", "SELECT p_partkey AS id, regexp_replace(trim(' ' || p_name || ' (' || p_brand || ') '), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM part")
def safe_names(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), labels.safe_name(F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(") "))).alias("name"))


@query("numbers_in_cells", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_custkey * 1000 + 234 WHEN 1 THEN o_custkey END::DOUBLE AS number, CASE o_orderkey % 3 WHEN 0 THEN o_custkey * 1000 + 234 WHEN 1 THEN o_custkey * 1000000.0 END::DOUBLE AS bases FROM orders")
def numbers_in_cells(s, d):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    cell = F.when(k == 0, F.concat(F.lit(" "), c, F.lit(",234 "))).when(k == 1, c).otherwise("n/a")
    size = F.when(k == 0, F.concat(c, F.lit(",234 bp"))).when(k == 1, F.concat(c, F.lit(" Mb"))).otherwise("large")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), labels.number_or_null(cell).alias("number"), labels.base_pairs(size).alias("bases"))


@query("primer_places", _SEQ + "SELECT doc_id, regexp_extract(seq, 'AC[ACGT][CT]G[AG]') AS found FROM x")
def primer_places(s, d):
    return _sequences(s, d).select("doc_id", F.regexp_extract("seq", iupac_pattern("ACNYGR"), 0).alias("found"))


@query("target_limits", """WITH x AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'Actinopteri' WHEN 1 THEN 'Mammalia' WHEN 2 THEN 'Ascidiacea' END AS class, CASE WHEN p_size % 3 > 0 THEN 'Chordata' ELSE 'Mollusca' END AS phylum, CASE WHEN p_size % 5 > 0 THEN 'MitoFish' ELSE 'NCBI;MitoFish' END AS source FROM part), y AS (SELECT *, class IS NULL AND source = 'MitoFish' AS alone FROM x)
SELECT id, alone OR coalesce(class = 'Actinopteri', false) AS fish, alone OR (phylum = 'Chordata' AND NOT coalesce(class = 'Ascidiacea', false)) AS vertebrates FROM y""")
def target_limits(s, d):
    n = F.col("p_size")
    x = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(n % 4 == 0, "Actinopteri").when(n % 4 == 1, "Mammalia").when(n % 4 == 2, "Ascidiacea").alias("class"), F.when(n % 3 > 0, "Chordata").otherwise("Mollusca").alias("phylum"), F.when(n % 5 > 0, "MitoFish").otherwise("NCBI;MitoFish").alias("source"))
    return x.select("id", naming.in_limit("fish").alias("fish"), naming.in_limit("vertebrates").alias("vertebrates"))


@query("unique_names", "SELECT position, name, CASE WHEN r = 1 THEN name ELSE name || '_' || r END AS unique FROM (SELECT p_partkey AS position, p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) x".replace(" AS unique ", ' AS "unique" '))
def unique_names(s, d):
    return sinks.unique_names(table(s, d, "part").select(F.col("p_partkey").alias("position"), F.col("p_name").alias("name")))


@query("union_columns", "SELECT n_name AS name, n_regionkey AS a, NULL::VARCHAR AS b FROM nation UNION ALL SELECT r_name, NULL, 'r' FROM region")
def union_columns(s, d):
    return sinks.union_columns([table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("a")), table(s, d, "region").select(F.col("r_name").alias("name"), F.lit("r").alias("b"))])


@query("job_order", "SELECT n_name AS sample, n_nationkey AS position, c AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1) x ON c_nationkey = n_nationkey")
def job_order(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("sample"), F.col("n_nationkey").alias("position"))
    m = table(s, d, "customer").where("c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("position")).agg(F.count("*").alias("customers")).join(n, "position").select("sample", "customers")
    return sinks.in_job_order(m, n)


@query("common_samples", "SELECT DISTINCT doc_id AS sample FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def common_samples(s, d):
    return selection.common(table(s, d, "documents").select(F.col("doc_id").alias("sample")), table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("sample")))


@query("stratified_genera", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN 'Unclassified' WHEN 2 THEN '' ELSE p_brand END AS genus FROM part")
def stratified_genera(s, d):
    n = F.col("p_size") % 4
    t = F.when(n == 0, F.concat(F.lit("g__"), "p_type", F.lit(".s__"), "p_brand")).when(n == 1, "unclassified").when(n == 3, F.col("p_brand"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), classifiers.genus_of(t).alias("genus"))


@query("placed_genera", """WITH l AS (SELECT p_partkey AS subject, p_brand AS genus, p_type AS phylum, 'c' || p_size AS class, 'o' || p_partkey AS "order", CASE WHEN p_size % 3 > 0 THEN 'f' || p_partkey END AS family FROM part), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY subject) AS r FROM l WHERE family IS NOT NULL) x WHERE r = 1)
SELECT o_orderkey AS query, 'Brand#' || (o_orderkey % 30) AS genus, phylum, class, "order", family FROM orders LEFT JOIN u ON u.genus = 'Brand#' || (o_orderkey % 30)""")
def placed_genera(s, d):
    k = F.col("p_partkey").cast("string")
    lin = table(s, d, "part").select(F.col("p_partkey").alias("subject"), F.col("p_brand").alias("genus"), F.col("p_type").alias("phylum"), F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("class"), F.concat(F.lit("o"), k).alias("order"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("f"), k)).alias("family"))
    names = table(s, d, "orders").select(F.col("o_orderkey").alias("query"), F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 30).cast("string")).alias("genus"))
    return naming.placed(names, lin)
