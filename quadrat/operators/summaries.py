"""Result tables with their limits and marks: tests, shares, profiles, depth and peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators import stats
from quadrat.operators.community import UNCLASSIFIED
from quadrat.operators.intervals import low_runs

# Identities and similarities that decide between known and new species; digital hybridisation likewise.
SPECIES_ANI, STRICT_ANI, SPECIES_TETRA, RRNA_SPECIES = 95.0, 96.0, 0.99, 98.65
SUBSPECIES_DDH, SPECIES_DDH = 79.0, 70.0


def stars(p: str | Column) -> Column:
    v = F.col(p) if isinstance(p, str) else p
    return F.when(v.isNull(), "").when(v < 0.001, "***").when(v < 0.01, "**").when(v < 0.05, "*").otherwise("ns")


def largest_taxa(values: DataFrame, n: int) -> DataFrame:
    """(taxon): the n taxa with the largest sum of (taxon, grp, value)."""
    return values.groupBy("taxon").agg(F.sum("value").alias("__t")).orderBy(F.desc("__t"), "taxon").limit(n).select("taxon")


def kruskal_table(values: DataFrame, n: int = 30) -> DataFrame:
    """(place, taxon, p, sig): Kruskal-Wallis of the n largest taxa, the smallest p first. values: dense, (taxon, grp, value)."""
    own = values.join(largest_taxa(values, n), "taxon", "left_semi")
    t = stats.kruskal(own, ["taxon"]).select("taxon", F.round(stats.chi2_p(F.col("h"), F.col("df")), 6).alias("p"))
    return t.select(F.row_number().over(Window.orderBy(F.col("p").asc_nulls_last(), "taxon")).alias("place"), "taxon", "p", stars("p").alias("sig"))


def _moments(values: DataFrame) -> DataFrame:
    return values.groupBy("taxon", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"))


def wilcoxon_table(values: DataFrame, n: int = 30) -> DataFrame:
    """(taxon, grp_a, grp_b, mean_a, se_a, mean_b, se_b, diff, low, high, p, q): pairs of groups over the n largest taxa, 95 per cent interval of the difference by its normal deviation; q within each pair."""
    own = values.join(largest_taxa(values, n), "taxon", "left_semi")
    pairs = stats.group_pairs(_moments(own), ["taxon"])
    p = stats.wilcoxon(own, ["taxon"]).select("taxon", "grp_a", "grp_b", stats.normal_p(F.col("z")).alias("p"))
    wide = 1.96 * F.sqrt(F.col("se_a") * F.col("se_a") + F.col("se_b") * F.col("se_b"))
    diff = F.col("mean_a") - F.col("mean_b")
    t = pairs.join(p, ["taxon", "grp_a", "grp_b"]).select("taxon", "grp_a", "grp_b", "mean_a", "se_a", "mean_b", "se_b", diff.alias("diff"), (diff - wide).alias("low"), (diff + wide).alias("high"), "p")
    return stats.benjamini_hochberg(t, by=["grp_a", "grp_b"])


def welch_table(values: DataFrame, n: int = 25) -> DataFrame:
    """(place, taxon, grp_a, grp_b, mean_a, se_a, mean_b, se_b, p, q): the n smallest p of each pair of groups; groups of one sample are left out."""
    pairs = stats.group_pairs(_moments(values), ["taxon"]).where("n_a >= 2 AND n_b >= 2")
    p = stats.welch(values, ["taxon"]).select("taxon", "grp_a", "grp_b", stats.t_p(F.col("t"), F.col("df")).alias("p"))
    t = stats.benjamini_hochberg(pairs.join(p, ["taxon", "grp_a", "grp_b"]).select("taxon", "grp_a", "grp_b", "mean_a", "se_a", "mean_b", "se_b", "p"), by=["grp_a", "grp_b"])
    place = F.row_number().over(Window.partitionBy("grp_a", "grp_b").orderBy(F.col("p").asc_nulls_last(), "taxon"))
    return t.withColumn("place", place).where(F.col("place") <= n)


def discriminating(values: DataFrame, most_p: float = 0.05, least_score: float = 2.0) -> DataFrame:
    """(taxon, grp, score, p): taxa that differ between groups, with the group of the largest mean."""
    score = stats.effect_score(values, ["taxon"])
    p = stats.kruskal(values, ["taxon"]).select("taxon", stats.chi2_p(F.col("h"), F.col("df")).alias("p"))
    best = values.groupBy("taxon", "grp").agg(F.avg("value").alias("m")).groupBy("taxon").agg(F.max_by("grp", F.struct("m", "grp")).alias("grp"))
    return score.join(p, "taxon").join(best, "taxon").where((F.col("p") < most_p) & (F.col("score") >= least_score)).select("taxon", "grp", "score", "p")


def assigned_shares(named: DataFrame, ranks: list[str]) -> DataFrame:
    """(rank, name, pct): share of each name of the reads that have one at the rank."""
    long = named.select("reads", F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.nullif(F.col(r), F.lit("")).alias("name")) for r in ranks))).alias("x")).select("reads", "x.rank", "x.name").where("name IS NOT NULL")
    s = long.groupBy("rank", "name").agg(F.sum("reads").alias("reads"))
    return s.select("rank", "name", F.coalesce(F.try_divide(100 * F.col("reads"), F.sum("reads").over(Window.partitionBy("rank"))), F.lit(0.0)).alias("pct"))


def kingdom_check(named: DataFrame, expected: list[str], kingdom: str = "kingdom", warn_pct: float = 10.0) -> DataFrame:
    """One row (reads, off_pct, organelle_pct, unassigned_pct, warn): reads of other kingdoms than expected and of organelles, by names equal to those of organelles at any rank. named: (reads, kingdom, order, family)."""
    organelle = F.coalesce((F.col("order") == "Chloroplast") | (F.col("family") == "Mitochondria"), F.lit(False))
    name = F.nullif(F.col(kingdom), F.lit(""))
    off = organelle | F.coalesce(~name.isin(expected), F.lit(False))
    pct = lambda test: 100 * F.coalesce(F.sum(F.when(test, F.col("reads"))), F.lit(0.0)) / F.greatest(F.sum("reads"), F.lit(1.0))
    s = named.agg(F.sum("reads").alias("reads"), pct(off).alias("off_pct"), pct(organelle).alias("organelle_pct"), pct(name.isNull()).alias("unassigned_pct"))
    return s.withColumn("warn", F.col("off_pct") >= warn_pct)


def agglomerated(features: DataFrame, ranks: list[str], keep_missing: bool = True, most: int = 5000) -> DataFrame:
    """(sample, ranks..., reads): features of one lineage down to a rank added up, after all but the ``most`` largest features are left out. Features without the last rank stay as a lineage of their own unless keep_missing is off."""
    top = features.groupBy("feature_id").agg(F.sum("reads").alias("__t")).orderBy(F.desc("__t"), "feature_id").limit(most).select("feature_id")
    own = features.join(top, "feature_id", "left_semi")
    own = own if keep_missing else own.where(F.coalesce(F.col(ranks[-1]), F.lit("")) != "")
    return own.groupBy("sample", *ranks).agg(F.sum("reads").alias("reads"))


def ternary(shares: DataFrame, groups: DataFrame, top: int = 20, combinations: int = 3) -> DataFrame:
    """(combo, taxon, grp, share): per cent of a taxon's means in three groups, for the taxa with the largest sum of group means and the first combinations of groups by name."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    means = shares.join(groups, "sample").groupBy("taxon", "grp").agg(F.sum("pct").alias("s")).join(sizes, "grp").select("taxon", "grp", (F.col("s") / F.col("n")).alias("mean"))
    kept = means.groupBy("taxon").agg(F.sum("mean").alias("t")).orderBy(F.desc("t"), "taxon").limit(top).select("taxon")
    a, b, c = (sizes.select(F.col("grp").alias(x)) for x in "abc")
    combos = a.join(b, F.col("a") < F.col("b")).join(c, F.col("b") < F.col("c")).orderBy("a", "b", "c").limit(combinations)
    combos = combos.select(F.concat_ws("|", "a", "b", "c").alias("combo"), F.explode(F.array("a", "b", "c")).alias("grp"))
    grid = kept.join(combos).join(means, ["taxon", "grp"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    total = F.sum("mean").over(Window.partitionBy("combo", "taxon"))
    return grid.select("combo", "taxon", "grp", (100 * F.col("mean") / F.when(total == 0, 1.0).otherwise(total)).alias("share"))


def host_share(tracking: DataFrame) -> DataFrame:
    """One row (pct): host reads, removed or classified, of all that passed quality control. tracking: (after_qc, host_removed, host_classified)."""
    s = tracking.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("after_qc", "host_removed", "host_classified")))
    return s.select(F.try_divide(100.0 * (F.col("host_removed") + F.col("host_classified")), F.col("after_qc")).alias("pct"))


def genes_by_bin(genes: DataFrame, membership: DataFrame, kind: str = "AMR") -> DataFrame:
    """(bin, n, genes): different genes of a kind in each bin, packed in a cell; contigs outside all bins count under an empty one. genes: (contig, gene, type); membership: (contig, bin)."""
    own = genes.where(F.col("type") == kind).join(membership, "contig", "left").withColumn("bin", F.coalesce(F.col("bin").cast("string"), F.lit("")))
    return own.groupBy("bin").agg(F.count_distinct("gene").alias("n"), F.array_join(F.sort_array(F.collect_set("gene")), ";").alias("genes"))


def contig_classes(contigs: DataFrame, by: list[str]) -> DataFrame:
    """Adds type: the longest contig of a genome of a million bases or more is the chromosome, circular ones below that are likely plasmids."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("length"), "contig")) == 1
    return contigs.withColumn("type", F.when(first & (F.col("length") >= 1_000_000), "chromosome").when(F.col("circular") & (F.col("length") < 1_000_000), "plasmid?").otherwise("contig"))


def closed_counts(contigs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., circular, chromosome_closed): circular contigs, and whether the chromosome is one. contigs: as ``contig_classes`` gives them."""
    return contigs.groupBy(*by).agg(F.count(F.when(F.col("circular"), 1)).alias("circular"), F.coalesce(F.bool_or(F.col("circular") & (F.col("type") == "chromosome")), F.lit(False)).alias("chromosome_closed"))


def strain_verdict(ani: str, tetra: str) -> Column:
    """known, borderline or novel by identity to the closest type strain and the correlation of tetramers; unknown without an identity."""
    a, t = F.col(ani), F.coalesce(F.col(tetra), F.lit(0.0))
    return F.when(a.isNull(), "unknown").when((a >= STRICT_ANI) | ((a >= SPECIES_ANI) & (t >= SPECIES_TETRA)), "known").when(a >= SPECIES_ANI, "borderline").otherwise("novel")


def hybridisation_verdict(d4: str) -> Column:
    d = F.col(d4)
    return F.when(d.isNull(), None).when(d >= SUBSPECIES_DDH, "belongs to known species").when(d >= SPECIES_DDH, "belongs to known species, potential new subspecies").otherwise("potential new species")


def rrna_novelty(identity: str) -> Column:
    return F.col(identity) < RRNA_SPECIES


def base_quality_share(counts: DataFrame, least: int = 30, by: list[str] | None = None) -> DataFrame:
    """(by..., pct): share of bases of that quality or more, from counts by position and quality."""
    by = by or ["file"]
    return counts.groupBy(*by).agg((100.0 * F.sum(F.when(F.col("q") >= least, F.col("n")).otherwise(0)) / F.sum("n")).alias("pct"))


def weighted_gc(table: DataFrame, by: list[str]) -> DataFrame:
    """(by..., gc): GC per cent of all bases. table: (length, gc)."""
    return table.groupBy(*by).agg(F.try_divide(F.sum(F.col("gc") * F.col("length")), F.sum(F.when(F.col("gc").isNotNull(), F.col("length")))).alias("gc"))


def quality_cut(medians: DataFrame, by: list[str], primer: int, floor: float = 25.0, window: int = 10) -> DataFrame:
    """(by..., cut): positions before the median of that many medians falls below the floor, less the primer. medians: (by..., pos from 0, median)."""
    ahead = Window.partitionBy(*by).orderBy("pos").rowsBetween(0, window - 1)
    own = F.sort_array(F.collect_list("median").over(ahead))
    low = F.when(F.size(own) == window, (own[(window - 1) // 2] + own[window // 2]) / 2 < floor)
    s = medians.withColumn("low", low).groupBy(*by).agg(F.min(F.when(F.col("low"), F.col("pos"))).alias("first"), F.count("*").alias("n"))
    return s.select(*by, F.greatest(F.lit(0), F.coalesce("first", "n") - primer).cast("long").alias("cut"))


def truncation(cut_f: Column, cut_r: Column, length_f: Column, length_r: Column, insert: Column, overlap: int) -> Column:
    """forward, reverse and ok: lengths to cut a read pair to. Cuts that leave too little overlap on the insert are lengthened, both by half and the rest where there is room; without a known insert they stand."""
    short = F.greatest(insert + overlap - cut_f - cut_r, F.lit(0))
    room_f, room_r = length_f - cut_f, length_r - cut_r
    half = F.least(room_f, F.floor((short + 1) / 2))
    add_r = F.least(room_r, short - half)
    add_f = F.least(room_f, short - add_r)
    long = lambda c: c.cast("long")
    f, r = F.when(insert.isNull(), cut_f).otherwise(cut_f + add_f), F.when(insert.isNull(), cut_r).otherwise(cut_r + add_r)
    return F.struct(long(f).alias("forward"), long(r).alias("reverse"), F.coalesce(f + r >= insert + overlap, F.lit(True)).alias("ok"))


def separated_peaks(bins: DataFrame, by: list[str], least: float = 0.05, apart: int = 5, most: int = 4) -> DataFrame:
    """(by..., at, mass): peaks of a histogram smoothed over two bins to each side, the heaviest first as long as they are apart from all heavier ones.

    A peak's mass is that of four bins to each side. bins: (by..., at, count), at from 0 without gaps. Which peaks stay depends
    on those before it, so a histogram, some hundred rows, is one group.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        h = rows["count"].to_numpy(float)
        smooth = np.array([h[max(0, i - 2) : i + 3].mean() for i in range(len(h))])
        top = [(float(h[max(0, i - 4) : i + 5].sum() / (h.sum() or 1)), i) for i in range(1, len(h) - 1) if smooth[i] >= smooth[i - 1] and smooth[i] > smooth[i + 1]]
        kept: list[tuple[float, int]] = []
        for mass, i in sorted(top, key=lambda x: (-round(x[0], 3), x[1])):
            if mass >= least and all(abs(i - k) >= apart for _, k in kept):
                kept.append((mass, i))
        out = pd.DataFrame({"at": np.array([i for _, i in kept[:most]], np.int64), "mass": np.array([round(m, 3) for m, _ in kept[:most]], float)})
        for c in reversed(by):
            out.insert(0, c, rows[c].iloc[0])
        return out

    kinds = ", ".join(f"`{c}` {bins.schema[c].dataType.simpleString()}" for c in by)
    return bins.select(*by, "at", "count").groupBy(*by).applyInPandas(run, f"{kinds}, at long, mass double")


def until_total_without_outliers(rows: DataFrame, by: list[str], order: list, value: str, target: float, times: float = 20.0, enough: float = 0.1) -> DataFrame:
    """Rows in order until their running sum reaches the target; those of over ``times`` the median are skipped where the others alone reach ``enough`` of the target and there are three rows or more."""
    own = Window.partitionBy(*by)
    m = rows.withColumn("__m", F.percentile(F.when(F.col(value) > 0, F.col(value)), 0.5).over(own)).withColumn("__k", F.count(F.when(F.col(value) > 0, 1)).over(own))
    m = m.withColumn("__ok", (F.col(value) > 0) & (F.col(value) <= times * F.col("__m")))
    m = m.withColumn("__sum", F.sum(F.when(F.col("__ok"), F.col(value))).over(own)).withColumn("__all", F.bool_and("__ok").over(own))
    skip = F.coalesce((F.col("__k") >= 3) & ~F.col("__all") & (F.col("__sum") >= enough * target), F.lit(False))
    used = m.where(F.col("__ok") | ~skip)
    run = F.sum(value).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return used.withColumn("running", run).where(F.col("running") - F.col(value) < target).drop("__m", "__k", "__ok", "__sum", "__all")


def depth_bins(depths: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by..., start, mean_depth): means of that many positions in a row, the last bin of those that are left. depths: (by..., pos, depth)."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    return depths.withColumn("__b", F.floor((n - 1) / size)).groupBy(*by, "__b").agg(F.min("pos").alias("start"), F.avg("depth").alias("mean_depth")).drop("__b")


def depth_summary(depths: DataFrame, by: list[str], length: str, absent: float = 2.0, least: int = 500) -> DataFrame:
    """(by..., mean_depth, breadth_1x, breadth_10x, absent_regions, absent_bp): of the reference's whole length; absent are runs of positions of at most that depth. depths: (by..., pos, depth, length)."""
    s = depths.groupBy(*by).agg(F.max(length).alias("l"), F.sum("depth").alias("d"), F.count(F.when(F.col("depth") >= 1, 1)).alias("c1"), F.count(F.when(F.col("depth") >= 10, 1)).alias("c10"))
    runs = low_runs(depths, by, "pos", "depth", absent).where(F.col("end") - F.col("start") + 1 >= least).groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.col("end") - F.col("start") + 1).alias("bp"))
    pct = lambda c: F.round(100.0 * F.col(c) / F.col("l"), 2)
    return s.join(runs, by, "left").select(*by, F.round(F.col("d") / F.col("l"), 1).alias("mean_depth"), pct("c1").alias("breadth_1x"), pct("c10").alias("breadth_10x"), F.coalesce("k", F.lit(0)).alias("absent_regions"), F.coalesce("bp", F.lit(0)).alias("absent_bp"))


def species_totals(named: DataFrame) -> DataFrame:
    """(species, reads, pct) of all samples together, from the largest; names by ``labels.species_label``. named: (genus, species, reads)."""
    from quadrat.functions.labels import species_label

    s = named.groupBy(species_label("genus", "species").alias("species")).agg(F.sum("reads").alias("reads")).where(F.col("species") != UNCLASSIFIED)
    total = named.agg(F.sum("reads").alias("t"))
    return s.join(total).select("species", "reads", F.coalesce(F.try_divide(100 * F.col("reads"), F.col("t")), F.lit(0.0)).alias("pct"))


def catalogue_families(alleles: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """(tname, family, symbol, type): the family of each allele, its type from the nearest node at or above it that has one; families that are not to be reported are left out.

    alleles: (tname, node); nodes: (id, parent, symbol, type, reportable).
    """
    from quadrat.operators.selection import tree_ancestor

    up = tree_ancestor(nodes.select("id", "parent", "type"), F.coalesce(F.col("type"), F.lit("")) != "", most).join(nodes.select(F.col("id").alias("ancestor"), F.col("type").alias("own_type")), "ancestor", "left").select("id", "own_type")
    own = nodes.where(F.coalesce(F.col("reportable").cast("string"), F.lit("1")) != "0").join(up, "id")
    return alleles.join(own.withColumnRenamed("id", "node"), "node").select("tname", F.col("node").alias("family"), F.regexp_replace(F.coalesce(F.nullif(F.col("symbol"), F.lit("")), F.col("node").cast("string")), "_gen$", "").alias("symbol"), F.coalesce("own_type", F.lit("")).alias("type"))


def numbered_sequences(features: DataFrame, prefix: str = "ASV") -> tuple[DataFrame, DataFrame]:
    """(sample, feature_id, reads) with short names for sequences, from the most abundant, and (line): the records of a FASTA file of them. Features without reads go."""
    from quadrat.operators.community import numbered

    totals = numbered(features.groupBy("feature_id").agg(F.sum("reads").alias("total")).where("total > 0"), "total", "feature_id")
    names = totals.select(F.col("feature_id").alias("seq"), F.concat(F.lit(prefix), F.col("number").cast("string")).alias("name"))
    out = features.withColumnRenamed("feature_id", "seq").join(names, "seq").select("sample", F.col("name").alias("feature_id"), "reads")
    return out, names.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("line"))


def content_key(columns: list[str]) -> Column:
    """A key for a stored result: MD5 of what it was made from. Missing cells and empty ones differ."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns)))


def nested_tables(results: DataFrame, key: str, arrays: list[str]) -> Iterator[tuple[str, DataFrame]]:
    """(name, table) of each array of structs in the results: a row for each element, with the key of its result."""
    for name in arrays:
        yield name, results.select(key, F.explode(name).alias("x")).select(key, "x.*")


def read_pairs(files: DataFrame) -> DataFrame:
    """(sample, files): R1 and R2 of a sample by the ends of their names; a file without its mate is a sample of its own. files: (name)."""
    ends = r"^(.+?)[._-]R?([12])(_001)?\.(fastq|fq)(\.gz)?$"
    own = files.where(F.col("name").rlike(r"(?i)\.(fastq|fq)(\.gz)?$")).withColumn("base", F.regexp_extract("name", ends, 1)).withColumn("mate", F.regexp_extract("name", ends, 2))
    own = own.withColumn("mates", F.size(F.collect_set("mate").over(Window.partitionBy("base"))))
    paired = (F.col("base") != "") & (F.col("mates") == 2)
    sample = F.when(paired, F.col("base")).otherwise(F.regexp_replace("name", r"(?i)\.(fastq|fq)(\.gz)?$", ""))
    return own.groupBy(sample.alias("sample")).agg(F.sort_array(F.collect_set("name")).alias("files"))


def listed_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(sample, r1, r2): the files that a manifest gives each sample, several rows of a sample together.

    manifest: (sample, file1, file2), files: (name), what is there. A row without a sample or whose first file isn't there is
    left out; a second file that isn't there is as if not given. A file named twice counts once.
    """
    there = files.select("name").distinct()
    own = manifest.where("sample <> ''").join(there.withColumnRenamed("name", "file1"), "file1").join(there.select(F.col("name").alias("file2"), F.lit(True).alias("__second")), "file2", "left")
    each = own.select("sample", F.struct("file1", F.when(F.col("__second"), F.col("file2")).alias("file2")).alias("f"))
    found = each.groupBy("sample").agg(F.sort_array(F.collect_set("f")).alias("f"))
    return found.select("sample", F.array_distinct(F.col("f.file1")).alias("r1"), F.filter(F.array_distinct(F.col("f.file2")), lambda x: x.isNotNull()).alias("r2"))


def sample_files(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(sample, r1, r2): by the manifest if it names files that are there, else by the ends of the files' names."""
    if manifest is not None:
        listed = listed_files(manifest, files)
        if not listed.isEmpty():
            return listed
    pair = F.size("files") > 1
    return read_pairs(files).select("sample", F.slice("files", 1, 1).alias("r1"), F.when(pair, F.slice("files", 2, 1)).otherwise(F.array().cast("array<string>")).alias("r2"))
