"""Which features, samples, columns and records take part: filters, splits, subsets and best-of-group picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.community import numbered

# Genera that extraction kits and reagents are known to carry.
REAGENT_GENERA = [
    "Sphingomonas", "Alteriyabuuchia", "Ralstonia", "Methylobacterium", "Cutibacterium", "Propionibacterium", "Bradyrhizobium", "Acinetobacter", "Pseudomonas", "Burkholderia", "Delftia", "Herbaspirillum", "Novosphingobium",
    "Sphingosinithalassobacter", "Stenotrophomonas", "Chryseobacterium", "Brevundimonas", "Paracoccus", "Afipia", "Massilia", "Curvibacter", "Roseateles", "Pelomonas", "Diaphorobacter", "Pseudacidovorax", "Variovorax", "Comamonas",
    "Janthinobacterium", "Rhodococcus",
]


def feature_class(ranks: list[str], host: list[str] | None = None, eukaryotes_apart: str | None = None) -> Column:
    """mitochondria, chloroplast, host, eukaryote or community, by the names at any rank. Names count wherever they contain the word.

    eukaryotes_apart: for markers of bacteria, the column that holds the domain; markers of eukaryotes have them in the community.
    """
    names = F.array_compact(F.array(*ranks))
    holds = lambda word: F.exists(names, lambda x: F.lower(x).contains(word))
    own_host = F.exists(names, lambda x: x.isin(host)) if host else F.lit(False)
    return F.when(holds("mitochondria"), "mitochondria").when(holds("chloroplast"), "chloroplast").when(own_host, "host").when(F.coalesce(F.col(eukaryotes_apart) == "Eukaryota", F.lit(False)) if eukaryotes_apart else F.lit(False), "eukaryote").otherwise("community")


def split_reads(named: DataFrame, kind: Column) -> DataFrame:
    """(sample, kind, reads, pct): reads of each class and their share of the sample."""
    per = named.groupBy("sample", kind.alias("kind")).agg(F.sum("reads").alias("reads"))
    return per.withColumn("pct", F.coalesce(F.try_divide(100 * F.col("reads"), F.sum("reads").over(Window.partitionBy("sample"))), F.lit(0.0)))


def reagent_reads(named: DataFrame, genera: list[str] = REAGENT_GENERA) -> DataFrame:
    """(sample, reagent, unnamed, own): reads of reagent genera, of no genus, and of others."""
    known, reagent = F.col("genus").isNotNull(), F.coalesce(F.col("genus").isin(genera), F.lit(False))
    pick = lambda c: F.sum(F.when(c, F.col("reads")).otherwise(0.0))
    return named.groupBy("sample").agg(pick(reagent).alias("reagent"), pick(~known).alias("unnamed"), pick(known & ~reagent).alias("own"))


def kept_unless_all_fail(rows: DataFrame, passes: Column, by: list[str]) -> DataFrame:
    """Rows that pass; in groups where none does the filter is off."""
    marked = rows.withColumn("__ok", F.coalesce(passes, F.lit(False)))
    return marked.withColumn("__any", F.max("__ok").over(Window.partitionBy(*by))).where("__ok OR NOT __any").drop("__ok", "__any")


def mostly_present(counts: DataFrame, most_zero_share: float = 0.9) -> DataFrame:
    """Taxa that are absent from at most that share of all samples."""
    n = counts.agg(F.count_distinct("sample")).first()[0]
    return counts.groupBy("taxon").agg(F.sum((F.col("reads") > 0).cast("int")).alias("k")).where(1 - F.col("k") / F.lit(n) <= most_zero_share).select("taxon")


def abundant_in_a_group(shares: DataFrame, groups: DataFrame, least: float = 0.1) -> DataFrame:
    """Taxa whose mean per cent over the samples of some group reaches that, absent samples counting as 0."""
    sizes = F.broadcast(groups.groupBy("grp").agg(F.count("*").alias("n")))
    per = shares.join(groups, "sample").groupBy("taxon", "grp").agg(F.sum("pct").alias("s")).join(sizes, "grp")
    return per.where(F.col("s") / F.col("n") >= least).select("taxon").distinct()


def subset(features: DataFrame, samples: DataFrame, prefix: str = "SV") -> DataFrame:
    """(sample, feature_id, reads, name): the features that the samples have, named afresh by their abundance there."""
    own = features.where("reads > 0").join(samples.select("sample").distinct(), "sample", "left_semi")
    totals = numbered(own.groupBy("feature_id").agg(F.sum("reads").alias("total")), "total", "feature_id")
    return own.join(totals.select("feature_id", F.format_string(f"{prefix}%06d", "number").alias("name")), "feature_id").select("sample", "feature_id", "reads", "name")


def subset_hits(hits: DataFrame, features: DataFrame, by: str = "agreement") -> DataFrame:
    """(by, features, reads): hits of the features that a subset of samples still has, counted anew. hits: (feature_id, by); features: (feature_id, reads)."""
    own = features.where("reads > 0").groupBy("feature_id").agg(F.sum("reads").alias("reads")).join(hits, "feature_id")
    return own.groupBy(by).agg(F.count("*").alias("features"), F.sum("reads").alias("reads"))


def usable_variables(metadata: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, kind, levels, usable): numbers with over two levels; factors with two levels of two rows or more, and fewer levels than rows. One pass over the levels of all columns."""
    long = metadata.select(F.monotonically_increasing_id().alias("__r"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(["__r"], columns, "variable", "level").where("level IS NOT NULL AND level <> ''")
    per = long.groupBy("variable", "level").agg(F.count("*").alias("n"))
    s = per.groupBy("variable").agg(F.count("*").alias("levels"), F.sum("n").alias("rows"), F.sum((F.col("n") >= 2).cast("int")).alias("full"), F.bool_and(F.col("level").try_cast("double").isNotNull()).alias("numeric"))
    ok = F.when(F.col("numeric"), F.col("levels") > 2).otherwise((F.col("full") >= 2) & (F.col("levels") < F.col("rows")))
    return s.select("variable", F.when(F.col("numeric"), "number").otherwise("factor").alias("kind"), "levels", ok.alias("usable"))


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """The samples of one table that another lacks."""
    return before.select("sample").distinct().join(after.select("sample"), "sample", "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """The samples that both tables have."""
    return a.select("sample").distinct().join(b.select("sample"), "sample", "left_semi")


def best_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in that order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def near_best(rows: DataFrame, by: list[str], score: str, within: float, order: list) -> DataFrame:
    """Of the rows within that distance of their group's best score, the first in that order."""
    near = rows.withColumn("__m", F.max(score).over(Window.partitionBy(*by))).where(F.col(score) >= F.col("__m") - within).drop("__m")
    return best_of(near, by, order)


def tree_ancestor(nodes: DataFrame, wanted: Column, most: int = 5) -> DataFrame:
    """(id, ancestor): the nearest node at or above each one that is wanted, at most that many steps up. nodes: (id, parent).

    Each step is one join of the unresolved rows by id.
    """
    marked = nodes.withColumn("ok", F.coalesce(wanted, F.lit(False))).select("id", "parent", "ok")
    at = marked.select("id", F.col("parent").alias("next"), F.when(F.col("ok"), F.col("id")).alias("ancestor"))
    up = marked.select(F.col("id").alias("next"), F.col("parent").alias("above"), F.col("ok").alias("up_ok"))
    for _ in range(most):
        at = at.join(up, "next", "left").select("id", F.when(F.col("ancestor").isNull(), F.col("above")).alias("next"), F.coalesce("ancestor", F.when(F.col("up_ok"), F.col("next"))).alias("ancestor"))
    return at.select("id", "ancestor")


def shared_lineage(rows: DataFrame, by: list[str], ranks: list[str]) -> DataFrame:
    """(by..., n, ranks...): rows of equal key merged; names down to the last rank on which all agree."""
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), *(c for r in ranks for c in (F.min(r).alias(r), (F.count_distinct(r) <= 1).alias(f"__{r}"))))
    agree, out = F.lit(True), []
    for r in ranks:
        agree = agree & F.col(f"__{r}")
        out.append(F.when(agree, F.col(r)).alias(r))
    return s.select(*by, "n", *out)


def clipped(lengths: DataFrame, by: list[str], ceiling: int) -> DataFrame:
    """(by..., near_pct, longest, clipped): whether lengths pile up at a ceiling: over 2 % within two letters of it, or the longest one letter below it or more."""
    near = F.try_divide(100 * F.sum(F.when(F.col("length") >= ceiling - 2, F.col("reads")).otherwise(0)), F.sum("reads"))
    s = lengths.groupBy(*by).agg(near.alias("near_pct"), F.max("length").alias("longest"))
    return s.withColumn("clipped", (F.col("near_pct") > 2) | (F.col("longest") >= ceiling - 1))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sample, taxon, x, y): two profiles side by side, 0 where one lacks the taxon."""
    both = a.select("sample", "taxon", F.col("pct").alias("x")).join(b.select("sample", "taxon", F.col("pct").alias("y")), ["sample", "taxon"], "full")
    return both.select("sample", "taxon", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def key_findings(values: DataFrame, group: str, item: str, carrier: str, value: str, top: int = 3) -> DataFrame:
    """(group, rank, item, most, carrier): the items of each group with the largest value anywhere, and who has it."""
    per = values.groupBy(group, item).agg(F.max(value).alias("most"), F.max_by(carrier, F.struct(value, carrier)).alias("carrier"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("most"), item)))
    return ranked.where(F.col("rank") <= top).select(group, "rank", item, "most", "carrier")


def joined_names(rows: DataFrame, by: list[str], name: str, sep: str = ";") -> DataFrame:
    """(by..., n, names): different names of each group, sorted and packed in a cell."""
    return rows.groupBy(*by).agg(F.count_distinct(name).alias("n"), F.array_join(F.sort_array(F.collect_set(name)), sep).alias("names"))


def accumulation(features: DataFrame, orders: int = 100, seed: int = 1) -> DataFrame:
    """(samples, mean, sd): features seen in the first k samples, over random orders of the samples.

    An order is the MD5 of sample, number and seed; a feature is first seen at the smallest place of its samples. Features
    that the same samples have are one row from the start, so an order is gone through once for each such set.
    """
    own = features.where("reads > 0").select("sample", "feature_id").distinct()
    sets = own.groupBy("feature_id").agg(F.sort_array(F.collect_list("sample")).alias("in")).groupBy("in").agg(F.count("*").alias("features"), F.min("feature_id").alias("id"))
    names = own.select("sample").distinct().withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(orders))))
    key = F.md5(F.concat_ws("-", F.col("sample").cast("string"), F.col("o").cast("string"), F.lit(str(seed))))
    place = names.withColumn("k", F.row_number().over(Window.partitionBy("o").orderBy(key, "sample")))
    # a set is known by its smallest feature; its first places in all orders are one row, and its samples lie side by side
    places = place.groupBy("sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]).alias("ks"))
    first = sets.select("id", "features", F.explode("in").alias("sample")).join(places, "sample").groupBy("id").agg(F.first("features").alias("features"), *[F.min(F.get("ks", F.lit(o))).alias(f"k{o}") for o in range(orders)])
    new = first.select("features", F.posexplode(F.array(*[f"k{o}" for o in range(orders)])).alias("o", "k")).groupBy((F.col("o") + 1).alias("o"), "k").agg(F.sum("features").alias("new"))
    run = place.select("o", "k").join(new, ["o", "k"], "left").withColumn("seen", F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("o").orderBy("k")))
    return run.groupBy(F.col("k").alias("samples")).agg(F.avg("seen").alias("mean"), F.coalesce(F.stddev_samp("seen"), F.lit(0.0)).alias("sd"))
