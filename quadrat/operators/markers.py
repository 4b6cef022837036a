"""Several markers and groups side by side: names and sites of samples, what groups share, where reads belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.labels import clean_genus, folded_key, missing_to_null
from quadrat.operators.community import UNCLASSIFIED

# Separators within sample names, and how controls and replicates are named after them.
SEPARATORS = "-_. "
CONTROL = r"(?i)^(.+?)[-_. ]+(CT|NC|NTC|NEG|NEGATIVE|BLANK|EB|CTRL|CONTROL)[-_. ]?\d*$"
REPLICATE = r"(?i)^(.+?)[-_. ]+(?:R|REP)?(\d{1,3})$"
#: Ranks by which a feature is named, from the deepest.
NAMED_RANKS = ["species", "genus", "family", "order", "class", "phylum"]


def common_suffix(names: DataFrame) -> DataFrame:
    """One row (suffix): what all names end in, from its first separator on; empty unless it holds a letter and every name is longer.

    The suffix of all names is that of the smallest and the largest of the reversed ones.
    """
    s = names.agg(F.min(F.reverse("name")).alias("a"), F.max(F.reverse("name")).alias("b"), F.min(F.length("name")).alias("short"), F.count_distinct("name").alias("n"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("a"), F.length("b"))), lambda i: F.left("a", i) == F.left("b", i)))
    raw = F.when((F.col("n") < 2) | (F.length("a") == 0) | (F.length("b") == 0), "").otherwise(F.reverse(F.left("a", same)))
    cut = F.regexp_extract(F.col("raw"), r"[-_. ].*$", 0)
    suffix = F.when(F.col("raw").rlike(r"^[-_. ]"), F.col("raw")).when(cut != "", cut).otherwise(F.col("raw"))
    good = (F.length("suffix") >= 2) & F.col("suffix").rlike("[A-Za-z]") & (F.col("short") > F.length("suffix"))
    return s.withColumn("raw", raw).withColumn("suffix", suffix).select(F.when(good, F.col("suffix")).otherwise("").alias("suffix"))


def sample_keys(names: DataFrame) -> DataFrame:
    """(name, key, folded, site, replicate, is_control): names without what they all end in, and what is told by the rest."""
    out = names.select("name").distinct().join(common_suffix(names))
    key = F.rtrim(F.left("name", F.length("name") - F.length("suffix")), F.lit(SEPARATORS))
    out = out.select("name", F.when(key == "", F.col("name")).otherwise(key).alias("key"))
    control, rep = F.col("key").rlike(CONTROL), F.col("key").rlike(REPLICATE)
    pick = lambda n: F.when(control, F.regexp_extract("key", CONTROL, n)).when(rep, F.regexp_extract("key", REPLICATE, n))
    return out.select("name", "key", folded_key("key").alias("folded"), F.coalesce(F.rtrim(pick(1), F.lit(SEPARATORS)), F.col("key")).alias("site"), F.when(control, F.upper(pick(2))).otherwise(F.coalesce(pick(2), F.lit(""))).alias("replicate"), control.alias("is_control"))


def marker_samples(keys: DataFrame) -> DataFrame:
    """(folded, key, markers): samples of all markers by their folded key. keys: (marker, folded, key)."""
    return keys.groupBy("folded").agg(F.min("key").alias("key"), F.array_join(F.sort_array(F.collect_set("marker")), ",").alias("markers"))


def site_means(shares: DataFrame, keys: DataFrame) -> DataFrame:
    """(marker, site, taxon, mean_pct, found, samples): means over all samples of a site, absent taxa counting as 0. shares: (marker, sample, taxon, pct); keys: (marker, sample, site)."""
    sizes = keys.groupBy("marker", "site").agg(F.count("*").alias("samples"))
    s = shares.join(keys, ["marker", "sample"]).groupBy("marker", "site", "taxon").agg(F.sum("pct").alias("sum"), F.count(F.when(F.col("pct") > 0, 1)).alias("found"))
    return s.join(sizes, ["marker", "site"]).select("marker", "site", "taxon", (F.col("sum") / F.col("samples")).alias("mean_pct"), "found", "samples")


def feature_name(group_ranks: list[str]) -> dict[str, Column]:
    """Columns grp, rank and name of a feature: its broad group, and the deepest name it has."""
    spaced = lambda c: F.translate(missing_to_null(c), "_", " ")
    genus, s = F.translate(clean_genus("genus"), "_", " "), spaced("species")
    species = F.when(s != F.coalesce(genus, F.lit("")), F.when(s.contains(" ") | genus.isNull(), s).otherwise(F.concat_ws(" ", genus, s)))
    options = {"species": species, "genus": F.coalesce(genus, spaced("genus"))} | {r: spaced(r) for r in NAMED_RANKS[2:]}
    rank = F.coalesce(*(F.when(v.isNotNull(), F.lit(r)) for r, v in options.items()), F.lit(""))
    group = F.coalesce(*(spaced(r) for r in group_ranks), F.lit("Unassigned"))
    return {"grp": F.when(rank == "", "Unassigned").otherwise(group), "rank": rank, "name": F.coalesce(*options.values(), F.lit("Not named"))}


def marker_overview(named: DataFrame) -> DataFrame:
    """One row (reads, features, taxa, species, genera, genus_pct) of (feature_id, sample, reads, rank, name)."""
    to_genus, has = F.col("rank").isin("species", "genus"), F.col("rank") != ""
    taxon = F.struct("rank", "name")
    return named.agg(
        F.sum("reads").alias("reads"), F.count_distinct("feature_id").alias("features"), F.count_distinct(F.when(has, taxon)).alias("taxa"), F.count_distinct(F.when(F.col("rank") == "species", taxon)).alias("species"),
        F.count_distinct(F.when(to_genus, taxon)).alias("genera"), F.try_divide(100 * F.sum(F.when(to_genus, F.col("reads")).otherwise(0.0)), F.sum("reads")).alias("genus_pct"),
    )


def group_shares(named: DataFrame) -> DataFrame:
    """(grp, mean_pct, taxa): mean per cent of a broad group over the samples that have reads, and its named taxa. named: (sample, reads, grp, rank, name)."""
    total = named.groupBy("sample").agg(F.sum("reads").alias("t")).where("t > 0")
    n = total.agg(F.count("*").alias("n"))
    s = named.join(total, "sample").groupBy("grp").agg(F.sum(100 * F.col("reads") / F.col("t")).alias("s"), F.count_distinct(F.when(F.col("rank") != "", F.struct("rank", "name"))).alias("taxa"))
    return s.join(n).select("grp", (F.col("s") / F.col("n")).alias("mean_pct"), "taxa")


def group_presence(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(taxon, in_all, only): whether all groups have a named taxon, and the one group that alone has it, in half of its samples or more."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    all_ = sizes.agg(F.count("*").alias("groups"))
    own = counts.where((F.col("pct") > 0) & ~F.col("taxon").isin(UNCLASSIFIED, "Other")).join(groups, "sample").groupBy("taxon", "grp").agg(F.count_distinct("sample").alias("k")).join(sizes, "grp")
    s = own.groupBy("taxon").agg(F.count("*").alias("has"), F.max(F.struct("grp", "k", "n")).alias("g"))
    return s.join(all_).select("taxon", (F.col("has") == F.col("groups")).alias("in_all"), F.when((F.col("has") == 1) & (2 * F.col("g.k") >= F.col("g.n")), F.col("g.grp")).alias("only"))


def read_classes(features: DataFrame, hits: DataFrame, limit: float = 80.0) -> DataFrame:
    """(sample, target, far, other, none): per cent of reads within the target, within it but further than the limit, outside it, and without a hit.

    hits: (feature_id, target yes or no, pident, named_second); a feature that only the second database named counts as target.
    """
    j = features.join(hits, "feature_id", "left")
    word = F.when(F.col("target").isin("yes", "no"), F.col("target")).when(F.coalesce("named_second", F.lit(False)), "yes").otherwise("none")
    word = F.when((word == "yes") & ~F.coalesce(F.col("pident") >= limit, F.lit(False)), "far").otherwise(word)
    s = j.withColumn("word", word).groupBy("sample").agg(F.sum("reads").alias("t"), *(F.sum(F.when(F.col("word") == w, F.col("reads")).otherwise(0.0)).alias(w) for w in ("yes", "far", "no", "none")))
    pct = lambda c: F.coalesce(F.try_divide(100 * F.col(c), F.col("t")), F.lit(0.0))
    return s.select("sample", pct("yes").alias("target"), pct("far").alias("far"), pct("no").alias("other"), pct("none").alias("none"))


def archaea(named: DataFrame) -> DataFrame:
    """(sample, reads, pct, dominant): archaeal reads of each sample, their share of all, and the taxon of most of them. named: (sample, reads, domain, genus, phylum)."""
    is_archaeal = F.coalesce(F.col("domain") == "Archaea", F.lit(False))
    s = named.groupBy("sample").agg(F.sum("reads").alias("t"), F.sum(F.when(is_archaeal, F.col("reads")).otherwise(0.0)).alias("reads"))
    own = named.where(is_archaeal & (F.col("reads") > 0)).groupBy("sample", F.coalesce("genus", "phylum", F.lit(UNCLASSIFIED)).alias("taxon")).agg(F.sum("reads").alias("v"))
    best = own.withColumn("r", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("v"), "taxon"))).where("r = 1").select("sample", F.col("taxon").alias("dominant"))
    return s.join(best, "sample", "left").select("sample", "reads", F.coalesce(F.try_divide(100 * F.col("reads"), F.col("t")), F.lit(0.0)).alias("pct"), F.coalesce("dominant", F.lit("—")).alias("dominant"))


def domain_totals(features: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, reads); features without one count as Unknown. domains: (feature_id, domain)."""
    return features.join(domains, "feature_id", "left").groupBy(F.coalesce("domain", F.lit("Unknown")).alias("domain")).agg(F.sum("reads").alias("reads"))


def without_taxa(features: DataFrame, unwanted: DataFrame) -> DataFrame:
    """The features of all other taxa: of a host, or of accessions that belong to another species. unwanted: (feature_id)."""
    return features.join(unwanted.select("feature_id").distinct(), "feature_id", "left_anti")


def kept_reads(reads: DataFrame, wanted: DataFrame, key: str = "read_id") -> DataFrame:
    """The reads on a list of ids. Works on streams too, with the list as a table."""
    return reads.join(wanted.select(key).distinct(), key, "left_semi")


def two_hop_taxonomy(hits: DataFrame, ids: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Taxonomy of each query by its first hit: target to taxon number, number to names. hits: (query, place, target); ids: (target, taxid)."""
    first = hits.withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where("__r = 1").select("query", "target")
    return first.join(ids, "target", "left").join(taxonomy, "taxid", "left")


def checked_names(features: DataFrame, checks: DataFrame) -> DataFrame:
    """Features with the columns of a check, which knows them by the part of the id before its first semicolon. checks: (key, ...)."""
    return features.withColumn("key", F.split("feature_id", ";")[0]).join(checks, "key", "left").drop("key")


def combined_outputs(outputs: DataFrame) -> DataFrame:
    """(sample, feature_id, reads): outputs of a classifier, one row for each taxon of a sample: rounded counts, or parts per million of the abundance where there are none. outputs: (sample, tax_id, counts, abundance)."""
    reads = F.coalesce(F.bround(F.col("counts").cast("double")), F.bround(F.coalesce(F.col("abundance").cast("double"), F.lit(0.0)) * 1e6))
    own = outputs.where("trim(tax_id) <> ''")
    return own.groupBy("sample", F.trim("tax_id").alias("feature_id")).agg(F.sum(reads).alias("reads"))


def taxa_at(taxonomy: DataFrame, rank: str) -> DataFrame:
    """(name): the different names of a rank, without rank prefixes."""
    name = F.regexp_replace(F.trim(rank), "^[dkpcofgs]__", "")
    return taxonomy.select(name.alias("name")).where("name <> ''").distinct()


def guild_counts(features: DataFrame) -> DataFrame:
    """(guild, features) of (feature_id, guild), from the largest."""
    return features.where("guild IS NOT NULL").groupBy("guild").agg(F.count("*").alias("features"))


def function_matches(taxa: DataFrame, functions: DataFrame) -> DataFrame:
    """(taxon, function): names meet if either holds the other, letter case apart. functions: (function, genus).

    Both ways are equi-joins: each different name is cut into all its substrings, some hundreds for a name of a genus, so no pair of names is compared without need.
    """
    within_ = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(c, i, n)))))
    t = taxa.select("taxon", F.lower(F.trim("taxon")).alias("whole")).where("whole <> ''").distinct()
    f = functions.select("function", F.lower(F.trim("genus")).alias("name")).where("name <> ''").distinct()
    within = t.select("taxon", F.explode(within_(F.col("whole"))).alias("name")).join(f, "name").select("taxon", "function")
    around = t.join(f.select("function", F.explode(within_(F.col("name"))).alias("whole")), "whole").select("taxon", "function")
    return within.union(around).distinct()


def function_pools(counts: DataFrame, functions: DataFrame) -> DataFrame:
    """(sample, function, pct): reads of the taxa of each function as per cent of the sample's pool of functions. counts: (sample, taxon, reads)."""
    pool = counts.join(function_matches(counts.select("taxon").distinct(), functions), "taxon").groupBy("sample", "function").agg(F.sum("reads").alias("reads"))
    return pool.select("sample", "function", (100 * F.col("reads") / F.greatest(F.sum("reads").over(Window.partitionBy("sample")), F.lit(1e-12))).alias("pct"))


def function_diversity(values: DataFrame) -> DataFrame:
    """(sample, shannon, functions) of (sample, feature, value), rows of unmapped reads left out."""
    real = values.where(~F.trim(F.split("feature", ":")[0]).isin("UNMAPPED", "UNINTEGRATED", "UNGROUPED") & (F.col("value") > 0))
    p = real.withColumn("p", F.col("value") / F.sum("value").over(Window.partitionBy("sample")))
    return p.groupBy("sample").agg((-F.sum(F.col("p") * F.ln("p"))).alias("shannon"), F.count("*").alias("functions"))


def pooled_profiles(profiles: DataFrame) -> DataFrame:
    """(pos, mean_q, ...): averages over files weighted by their reads, down to the shortest profile. profiles: (file, pos, reads, and the values)."""
    values = [c for c in profiles.columns if c not in ("file", "pos", "reads")]
    ends = profiles.groupBy("file").agg(F.max("pos").alias("last")).agg(F.min("last").alias("last"))
    own = profiles.join(ends).where(F.col("pos") <= F.col("last"))
    return own.groupBy("pos").agg(*((F.sum(F.col(c) * F.col("reads")) / F.sum("reads")).alias(c) for c in values))


def heatmap_rows(shares: DataFrame, top: int = 30) -> DataFrame:
    """(place, taxon, sample, pct): the taxa with the largest means, without those equal in all samples; absent ones are 0 and have no row."""
    n = shares.agg(F.count_distinct("sample").alias("n"))
    s = shares.groupBy("taxon").agg(F.sum("pct").alias("s"), F.count("*").alias("k"), F.max("pct").alias("hi"), F.min("pct").alias("lo")).orderBy(F.desc("s"), "taxon").limit(top)
    kept = s.join(n).where((F.col("hi") > F.when(F.col("k") < F.col("n"), 0.0).otherwise(F.col("lo"))))
    ranked = kept.select(F.row_number().over(Window.orderBy(F.desc("s"), "taxon")).alias("place"), "taxon")
    return shares.join(ranked, "taxon").where("pct > 0").select("place", "taxon", "sample", "pct")


def top_genera(counts: DataFrame, n: int = 10, unassigned: str = "(unassigned)") -> DataFrame:
    """(place, taxon, reads, pct): the largest taxa of all samples together, of the n + 1 largest those with a name, at most n; per cent of all reads."""
    total = counts.agg(F.sum("reads").alias("t"))
    s = counts.groupBy("taxon").agg(F.sum("reads").alias("reads")).orderBy(F.desc("reads"), "taxon").limit(n + 1).where(F.col("taxon") != unassigned)
    return s.join(total).select(F.row_number().over(Window.orderBy(F.desc("reads"), "taxon")).alias("place"), "taxon", "reads", F.round(100 * F.col("reads") / F.col("t"), 1).alias("pct")).where(F.col("place") <= n)


def amr_tables(genes: DataFrame, samples: list[str]) -> DataFrame:
    """One row per gene, a column of RPKM for each sample, 0 where absent. genes: (sample, gene, rpkm)."""
    return genes.groupBy("gene").pivot("sample", samples).agg(F.sum("rpkm")).na.fill(0.0, subset=samples)
