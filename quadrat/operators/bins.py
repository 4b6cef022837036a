"""Genome bins and isolates: names, splits, joins, matches, tables, purity and the precedence of identifications.

Bins are rows of contigs (bin, contig, length, ...); quality estimates come from outside as (bin, completeness, contamination).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.genomes import tier
from quadrat.operators.intervals import n50

# Least identities for a species and a genus by average nucleotide identity.
SPECIES_ANI, GENUS_ANI = 95.0, 90.0


def species_call(ani: str | Column) -> Column:
    a = F.col(ani) if isinstance(ani, str) else ani
    return F.when(a.isNull(), "unresolved").when(a >= SPECIES_ANI, "species").when(a >= GENUS_ANI, "genus").otherwise("unresolved")


def contig_taxa(calls: DataFrame, tree: DataFrame) -> DataFrame:
    """(contig, genus, species) of the contigs that a classifier placed within a genus. calls: (contig, classified, taxid); tree: (taxid, genus, species)."""
    return calls.where("classified").join(tree.select("taxid", "genus", "species"), "taxid").where("genus IS NOT NULL").select("contig", "genus", "species")


def _first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def bin_names(contigs: DataFrame, least: float = 0.6) -> DataFrame:
    """(bin, name, share): the genus of most of a bin's length, or its species if that has the share of the genus; share: per cent of the whole bin's length. Bins without a genus are left out."""
    total = contigs.groupBy("bin").agg(F.sum("length").alias("t"))
    genus = _first(contigs.where("genus IS NOT NULL").groupBy("bin", "genus").agg(F.sum("length").alias("g")), ["bin"], [F.desc("g"), "genus"])
    named = contigs.where("genus IS NOT NULL AND species IS NOT NULL").groupBy("bin", F.split("species", " ")[0].alias("genus"), "species").agg(F.sum("length").alias("v"))
    species = _first(named, ["bin", "genus"], [F.desc("v"), "species"])
    j = genus.join(total, "bin").join(species, ["bin", "genus"], "left")
    return j.select("bin", F.when(F.col("v") >= least * F.col("g"), F.col("species")).otherwise(F.col("genus")).alias("name"), F.bround(100 * F.col("g") / F.greatest("t", F.lit(1)), 1).alias("share"))


def sizes_and_depths(contigs: DataFrame) -> DataFrame:
    """(bin, length, depth): depth weighted by length."""
    return contigs.groupBy("bin").agg(F.sum("length").alias("length"), (F.sum(F.col("depth") * F.col("length")) / F.greatest(F.sum("length"), F.lit(1))).alias("depth"))


def join_candidates(bins: DataFrame, within: float = 1.5) -> DataFrame:
    """(species, joined, bin): bins of one species whose depth is within that factor of the largest one's, where there are two or more; joined is the largest. bins: (bin, species, length, depth)."""
    own = Window.partitionBy("species")
    b = bins.where("species IS NOT NULL").withColumn("ref", F.first(F.struct("depth", "bin")).over(own.orderBy(F.desc("length"), "bin")))
    ref = F.when(F.col("ref.depth") > 0, F.col("ref.depth")).otherwise(1e-9)
    near = b.where((F.col("depth") > 0) & (F.greatest("depth", ref) <= within * F.least("depth", ref)))
    near = near.withColumn("n", F.count("*").over(own)).where("n >= 2").withColumn("joined", F.first("bin").over(own.orderBy(F.desc("length"), "bin")))
    return near.select("species", "joined", "bin")


def accepted_joins(candidates: DataFrame, quality: DataFrame, joined_quality: DataFrame) -> DataFrame:
    """(joined, completeness, contamination, parts): joins at least 10 points more complete than their best part, under 10 % contaminated and at most 5 points more than their worst part. Joins with an unknown quality are left out."""
    parts = candidates.join(quality, "bin", "left").groupBy("joined").agg(
        F.max("completeness").alias("comp"), F.max("contamination").alias("cont"), F.bool_and(F.col("completeness").isNotNull() & F.col("contamination").isNotNull()).alias("known"), F.array_join(F.sort_array(F.collect_list(F.col("bin").cast("string"))), " + ").alias("parts")
    )
    j = parts.where("known").join(joined_quality, "joined")
    good = (F.col("completeness") >= F.col("comp") + 10) & (F.col("contamination") < 10) & (F.col("contamination") <= F.col("cont") + 5)
    return j.where(good).select("joined", "completeness", "contamination", "parts")


def quality_score(completeness: str, contamination: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(completeness) - 5 * F.col(contamination))


def chosen_splits(parts: DataFrame, quality: DataFrame, mixed: float = 10.0) -> DataFrame:
    """(bin, variant, score): for bins over that contamination, the way of splitting with the largest sum of scores, if that beats the bin's own.

    parts: (bin, variant, part, completeness, contamination); variants with a part of unknown quality, or of one part, don't count; ties go to the first variant by name.
    """
    known = F.col("completeness").isNotNull() & F.col("contamination").isNotNull()
    ways = parts.groupBy("bin", "variant").agg(F.count("*").alias("n"), F.bool_and(known).alias("known"), F.sum(quality_score("completeness", "contamination")).alias("score")).where("known AND n >= 2")
    best = _first(ways, ["bin"], [F.desc("score"), "variant"])
    whole = quality.where(F.col("contamination") > mixed).select("bin", F.coalesce(quality_score("completeness", "contamination"), F.lit(0.0)).alias("own"))
    return best.join(whole, "bin").where("score > own").select("bin", "variant", "score")


def best_match(matches: DataFrame, k: int = 31) -> DataFrame:
    """(query, accession, ani, call): the match that explains most of a bin; its ANI, if it has none, from the share of k-mers found, in per cent. matches: (query, accession, share, ani, found)."""
    best = _first(matches, ["query"], [F.desc(F.coalesce("share", F.lit(0.0))), "accession"])
    ani = F.coalesce(F.when(F.col("ani") != 0, F.col("ani")), F.pow(F.coalesce("found", F.lit(0.0)), F.lit(1 / k)))
    ani = F.when(ani <= 1, 100 * ani).otherwise(ani)
    return best.select("query", F.regexp_replace("accession", "^(RS_|GB_)", "").alias("accession"), F.bround(ani, 2).alias("ani"), species_call(F.bround(ani, 2)).alias("call"))


def bin_table(contigs: DataFrame, quality: DataFrame, least_contig: int = 0) -> DataFrame:
    """(sample, bin, size, contigs, n50, depth, coverage_share, completeness, contamination, tier, place): bins of each sample from the best.

    contigs: (sample, bin, contig, length, depth), bin null for contigs outside all bins, which count in the coverage of the sample if they are long enough.
    """
    cover = F.sum(F.col("depth") * F.col("length"))
    total = contigs.where(F.col("length") >= least_contig).groupBy("sample").agg(cover.alias("all"))
    inside = contigs.where("bin IS NOT NULL")
    s = inside.groupBy("sample", "bin").agg(cover.alias("cov"))
    out = n50(inside, ["sample", "bin"]).join(s, ["sample", "bin"]).join(total, "sample", "left").join(quality, "bin", "left").withColumn("tier", tier("completeness", "contamination"))
    order = F.when(F.col("tier") == "High", 0).when(F.col("tier") == "Medium", 1).when(F.col("tier") == "Low", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("sample").orderBy(order, F.desc(F.coalesce(F.col("completeness").cast("double"), F.lit(0.0))), "bin"))
    return out.select(
        "sample", "bin", F.col("total").alias("size"), F.col("n").alias("contigs"), "n50", F.bround(F.col("cov") / F.greatest("total", F.lit(1)), 1).alias("depth"),
        F.bround(100 * F.col("cov") / F.coalesce(F.when(F.col("all") > 0, F.col("all")), F.lit(1.0)), 1).alias("coverage_share"), "completeness", "contamination", "tier", place.alias("place"),
    )


def bin_counts(bins: DataFrame) -> DataFrame:
    """One row (bins, high, medium, split, joined). bins: (tier, split_from, joined_from)."""
    count = lambda c: F.count(F.when(c, 1))
    return bins.agg(F.count("*").alias("bins"), count(F.col("tier") == "High").alias("high"), count(F.col("tier") == "Medium").alias("medium"), F.count_distinct("split_from").alias("split"), F.count("joined_from").alias("joined"))


def contig_types(contigs: DataFrame, plasmids: DataFrame, replicons: DataFrame) -> DataFrame:
    """(contig, type, cluster, replicons): types raised by a plasmid report (contig, molecule, cluster) and by replicon genes (contig, gene).

    A reported plasmid is one; a likely one (``plasmid?``) with a replicon is one, without it stays putative.
    """
    genes = replicons.groupBy("contig").agg(F.array_join(F.sort_array(F.collect_set("gene")), ", ").alias("replicons"))
    j = contigs.join(plasmids, "contig", "left").join(genes, "contig", "left")
    kind = F.when(F.col("molecule") == "plasmid", "plasmid").otherwise(F.col("type"))
    kind = F.when((kind == "plasmid?") & F.col("replicons").isNotNull(), "plasmid").when(kind == "plasmid?", "plasmid (putative)").otherwise(kind)
    return j.select("contig", kind.alias("type"), "cluster", F.coalesce("replicons", F.lit("")).alias("replicons"))


def purity_flags(quality: DataFrame, most_contamination: float = 5.0, least_completeness: float = 90.0) -> DataFrame:
    """(bin, flag): impure and incomplete genomes, a row for each flag."""
    dirty, short = F.when(F.col("contamination") > most_contamination, "contaminated"), F.when(F.col("completeness") < least_completeness, "incomplete")
    return quality.select("bin", F.explode(F.array_compact(F.array(dirty, short))).alias("flag"))


def mixed_culture(hits: DataFrame, least: float = 5.0, shown: int = 3) -> DataFrame:
    """(sample, others, names): other genera than the best hit's that hold at least that per cent of the assembly. hits: (sample, place, genus, species, pct), best first by place."""
    own = Window.partitionBy("sample")
    h = hits.withColumn("top", F.first("genus").over(own.orderBy("place"))).withColumn("first", F.min("place").over(own))
    other = h.where((F.col("place") > F.col("first")) & (F.col("genus") != F.col("top")) & (F.col("pct") >= least))
    return other.groupBy("sample").agg(F.count("*").alias("others"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("place", "species"))), 1, shown), lambda x: x["species"]), ", ").alias("names"))


def plain_species(name: str | Column) -> Column:
    """First two words of an organism's name, without the suffixes that mark parts of a split genus (``Bacillus_A``)."""
    words = F.split(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"_[A-Z]+\b", ""), " ")
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))


def candidate_genera(names: DataFrame, most: int = 2) -> DataFrame:
    """(place, genus): the first different genera of an ordered list of names (place, name)."""
    genus = F.regexp_replace(F.split(F.coalesce("name", F.lit("")), " ")[0], r"_[A-Z]+$", "")
    seen = names.select("place", genus.alias("genus")).where("genus <> ''").groupBy("genus").agg(F.min("place").alias("place"))
    return seen.orderBy("place").limit(most).select("place", "genus")


def ranked_strains(strains: DataFrame, neighbours: DataFrame, rrna: DataFrame, most: int = 20) -> DataFrame:
    """(place, organism, accession, identity): type strains to compare with, those of k-mer neighbours first, then by identity of the 16S, then by name.

    strains: (organism, accession); neighbours: (name); rrna: (species, identity), met by the full name or by its first two words.
    """
    near = neighbours.select(plain_species("name").alias("base")).where("base IS NOT NULL").distinct().withColumn("near", F.lit(True))
    best = rrna.groupBy("species").agg(F.max("identity").alias("identity"))
    s = strains.withColumn("base", plain_species("organism")).join(near, "base", "left")
    s = s.join(best.toDF("organism", "whole"), "organism", "left").join(best.toDF("base", "part"), "base", "left").withColumn("identity", F.coalesce("whole", "part"))
    order = [F.coalesce(F.when(F.col("near"), 0), F.lit(1)), F.desc(F.coalesce("identity", F.lit(0.0))), "organism", "accession"]
    top = s.orderBy(*order).limit(most)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "organism", "accession", "identity")


def comparison(strains: DataFrame, metrics: DataFrame, rrna: DataFrame) -> DataFrame:
    """(query, place, accession, anib, skani, identity): each genome's strains with their metrics, from the closest by ANIb, or by the sketch where that is missing. strains: (query, organism, accession, skani)."""
    j = strains.join(metrics, ["query", "accession"], "left").join(rrna.select("query", F.col("species").alias("organism"), "identity"), ["query", "organism"], "left")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.coalesce("anib", "skani", F.lit(0.0))), "accession"))
    return j.select("query", place.alias("place"), "accession", "anib", "skani", "identity")


def identified(genomes: DataFrame) -> DataFrame:
    """(genome, method, species, genus, ani, call): what stands of several identifications.

    genomes: (genome, sketch_species, sketch_genus, sketch_ani, checked_ani, rrna_species, rrna_genus, strain_level, strain_species, strain_ani), strain_level known, borderline or novel.
    A checked ANI replaces the sketch's; 16S alone counts where there is no species; a type strain's verdict stands over all.
    """
    sketch = F.col("sketch_species").isNotNull()
    method = F.when(sketch & F.col("checked_ani").isNotNull(), "ANI").when(sketch, "sketch").when(F.col("rrna_species").isNotNull(), "16S")
    species, genus = F.coalesce("sketch_species", "rrna_species"), F.when(sketch, F.col("sketch_genus")).otherwise(F.col("rrna_genus"))
    ani = F.when(sketch, F.coalesce("checked_ani", "sketch_ani"))
    call = F.when(~sketch & F.col("rrna_species").isNotNull(), "16S only").otherwise(species_call(ani))
    named, novel = F.col("strain_level").isin("known", "borderline"), F.col("strain_level") == "novel"
    stands = F.coalesce(named | novel, F.lit(False))
    return genomes.select(
        "genome", F.when(stands, "type strain").otherwise(method).alias("method"), F.when(stands, F.col("strain_species")).otherwise(species).alias("species"),
        F.when(F.coalesce(named, F.lit(False)), F.split("strain_species", " ")[0]).otherwise(genus).alias("genus"), F.when(stands, F.bround("strain_ani", 2)).otherwise(ani).alias("ani"),
        F.when(F.col("strain_level") == "known", "species").when(F.col("strain_level") == "borderline", "species (borderline)").when(novel, "potential novel species").otherwise(call).alias("call"),
    )


def partial_pathways(coverage: DataFrame, least: float = 0.5) -> DataFrame:
    """(feature, partial): whether no sample covers a pathway to that share. coverage: (sample, feature, value)."""
    return coverage.groupBy("feature").agg((F.max("value") < least).alias("partial"))
