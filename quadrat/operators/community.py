"""Counts by taxon and sample: shares, top taxa, prevalence, controls, set membership.

Tables are long: (sample, feature_id, reads). A taxon that a sample lacks has no
row; where a mean or a prevalence needs its zero, the number of samples is
counted instead of building the dense grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.rounds import Rounds

OTHER, UNCLASSIFIED = "Other", "Unclassified"


def with_taxonomy(features: DataFrame, taxonomy: DataFrame, keep_unnamed: bool = True) -> DataFrame:
    """Features with their lineage; those without one stay unless keep_unnamed is off.

    A taxonomy has a row for each feature and packs well, so by the size of its files Spark would send it to every task whole.
    """
    return features.join(taxonomy.hint("merge"), "feature_id", "left" if keep_unnamed else "inner")


def rank_counts(named: DataFrame, label: str | Column) -> DataFrame:
    """(sample, taxon, reads)."""
    taxon = F.col(label) if isinstance(label, str) else label
    return named.groupBy("sample", taxon.alias("taxon")).agg(F.sum("reads").alias("reads"))


def with_share(counts: DataFrame, by: str | list[str] = "sample", value: str = "reads", name: str = "pct") -> DataFrame:
    """Adds the value as per cent of its group's total; 0 in groups without any."""
    total = F.sum(value).over(Window.partitionBy(*([by] if isinstance(by, str) else by)))
    return counts.withColumn(name, F.coalesce(F.try_divide(100 * F.col(value), total), F.lit(0.0)))


def sample_count(counts: DataFrame) -> Column:
    """Number of samples as a column of one value, from a one-row aggregate."""
    return F.lit(counts.agg(F.count_distinct("sample")).first()[0])


def top_taxa(counts: DataFrame, n: int, unclassified_competes: bool = False, by: str = "pct", counted_name: bool = False) -> DataFrame:
    """(sample, taxon, value): the n taxa with the largest total, the rest summed as Other; Unclassified apart unless it competes.

    Totals over all samples rank as means over all samples do. The kept names are n rows; they are broadcast.
    """
    pool = counts if unclassified_competes else counts.where(F.col("taxon") != UNCLASSIFIED)
    ranked = pool.groupBy("taxon").agg(F.sum(by).alias("total")).orderBy(F.desc("total"), "taxon")
    kept = F.broadcast(ranked.limit(n).select("taxon", F.col("taxon").alias("kept")))
    other: Column = F.lit(OTHER)
    if counted_name:
        other = F.lit(f"Others ({max(0, pool.select('taxon').distinct().count() - n)} taxa)")
    label = F.coalesce(F.col("kept"), F.when((F.col("taxon") == UNCLASSIFIED) & F.lit(not unclassified_competes), UNCLASSIFIED).otherwise(other))
    return counts.join(kept, "taxon", "left").groupBy("sample", label.alias("taxon")).agg(F.sum(by).alias("value"))


def dominant(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k largest named taxa of each sample."""
    order = Window.partitionBy("sample").orderBy(F.desc("pct"), "taxon")
    named = counts.where((F.col("taxon") != UNCLASSIFIED) & (F.col("pct") > 0))
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def group_means(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, taxon, mean_pct, se, prevalence_pct): means over all samples of a group, absent taxa counting as 0."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    s = counts.join(groups, "sample").groupBy("grp", "taxon").agg(F.sum("pct").alias("s"), F.sum(F.col("pct") * F.col("pct")).alias("ss"), F.sum((F.col("pct") > 0).cast("int")).alias("k"))
    mean = F.col("s") / F.col("n")
    spare = F.greatest(F.col("ss") - F.col("n") * mean * mean, F.lit(0.0))
    se = F.when(F.col("n") > 1, F.sqrt(spare / F.greatest(F.col("n") - 1, F.lit(1))) / F.sqrt("n")).otherwise(0.0)
    return s.join(F.broadcast(sizes), "grp").select("grp", "taxon", mean.alias("mean_pct"), se.alias("se"), (100 * F.col("k") / F.col("n")).alias("prevalence_pct"))


def prevalent(counts: DataFrame, least_prevalence: float, least_mean: float) -> DataFrame:
    """Taxa that at least that share of all samples has, with at least that mean per cent."""
    n = sample_count(counts)
    out = counts.groupBy("taxon").agg((100 * F.sum((F.col("pct") > 0).cast("int")) / n).alias("prevalence_pct"), (F.sum("pct") / n).alias("mean_pct"))
    return out.where((F.col("prevalence_pct") >= least_prevalence) & (F.col("mean_pct") >= least_mean))


def abundant_anywhere(counts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows of the taxa that reach the per cent in some sample; and reads dropped from each sample with the others."""
    most = counts.withColumn("most", F.max("pct").over(Window.partitionBy("taxon")))
    dropped = most.groupBy("sample").agg(F.sum(F.when(F.col("most") < least, F.col("reads")).otherwise(0)).alias("dropped"))
    return most.where(F.col("most") >= least).drop("most"), dropped


def detected_lineages(named: DataFrame, ranks: list[str]) -> DataFrame:
    """(sample, rank, taxa): different lineages down to each rank, where the rank has a name."""
    out = None
    for i, rank in enumerate(ranks):
        lineage = F.concat_ws(";", *(F.coalesce(F.col(r), F.lit("")) for r in ranks[: i + 1]))
        own = named.where(F.col(rank).isNotNull() & (F.col("reads") > 0)).groupBy("sample").agg(F.count_distinct(lineage).alias("taxa")).select("sample", F.lit(rank).alias("rank"), "taxa")
        out = own if out is None else out.unionByName(own)
    return out


def assigned_share(named: DataFrame, ranks: list[str]) -> DataFrame:
    """(rank, pct): reads with a name at each rank, of all reads; one pass."""
    total = F.sum("reads")
    sums = named.agg(*(F.try_divide(100 * F.sum(F.when(F.col(r).isNotNull(), F.col("reads")).otherwise(0)), total).alias(r) for r in ranks))
    return sums.unpivot([], ranks, "rank", "pct")


def group_membership(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(taxon, members, n_groups): the groups that have a taxon, in order."""
    own = counts.where("reads > 0").join(groups, "sample").select("taxon", "grp").distinct()
    return own.groupBy("taxon").agg(F.array_join(F.sort_array(F.collect_set("grp")), "|").alias("members"), F.count("*").alias("n_groups"))


def venn(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(members, taxa): how many taxa each set of groups shares."""
    return group_membership(counts, groups).groupBy("members").agg(F.count("*").alias("taxa"))


def negative_controls(counts: DataFrame, controls: DataFrame, top: int = 12) -> DataFrame:
    """Largest taxa of the pooled control samples held against the other samples.

    counts: (sample, taxon, reads, pct). Flagged: named, at least 1 % of the pooled controls and at least twice the mean
    per cent of the samples.
    """
    marked = counts.join(controls.select("sample", F.lit(1).alias("control")).distinct(), "sample", "left")
    is_control = F.col("control").isNotNull()
    totals = marked.groupBy("sample").agg(F.first("control", ignorenulls=True).alias("control"), F.sum("reads").alias("reads")).agg(
        F.sum(F.when(is_control, F.col("reads"))).alias("pooled"), F.count(F.when(~is_control, 1)).alias("n_samples")
    )
    taxa = marked.groupBy("taxon").agg(
        F.sum(F.when(is_control, F.col("reads")).otherwise(0)).alias("in_controls"), F.sum(F.when(~is_control, F.col("pct")).otherwise(0)).alias("sum_pct"), F.sum((~is_control & (F.col("pct") >= 0.1)).cast("int")).alias("samples_present")
    )
    best = taxa.where("in_controls > 0").orderBy(F.desc("in_controls"), "taxon").limit(top)
    pct, mean = F.try_divide(100 * F.col("in_controls"), F.col("pooled")), F.coalesce(F.try_divide("sum_pct", F.col("n_samples").cast("double")), F.lit(0.0))
    flag = (F.col("taxon") != UNCLASSIFIED) & (F.col("pct_in_controls") >= 1) & (F.col("pct_in_controls") >= 2 * F.col("mean_pct_in_samples"))
    # one row of totals beside at most ``top`` rows
    return best.join(F.broadcast(totals)).select("taxon", pct.alias("pct_in_controls"), mean.alias("mean_pct_in_samples"), "samples_present", "n_samples").withColumn("flag", flag)


def upper_median(values: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """The value at position n // 2 (from 0) in ascending order: the upper middle of an even number."""
    keys = [by] if by else []
    middle = F.floor(F.col("__all") / 2) + 1
    at = running_counts(values, value, keys).where((F.col("__run") >= middle) & (F.col("__run") - F.col("__n") < middle))
    return at.select(*keys, F.col(value).alias("median"))


def running_counts(rows: DataFrame, value: str, by: list[str], parts: int = 64) -> DataFrame:
    """(by..., value, __n, __part, __run, __all): rows of each different value, rows up to it, and all rows.

    Values are dealt into parts by their quantiles, the same wherever they are computed; only a total for each part is
    summed in one order.
    """
    each = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    # one row, and the same rows as are counted: Spark uses their shuffle again
    cuts = each.agg(F.array_distinct(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000)).alias("__cuts"))
    each = each.join(F.broadcast(cuts)).withColumn("__part", F.size(F.filter(F.coalesce("__cuts", F.array().cast(cuts.schema["__cuts"].dataType)), lambda x: x < F.col(value)))).drop("__cuts")
    run = F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy(value))
    keys = Window.partitionBy(*by)
    totals = each.groupBy(*by, "__part").agg(F.sum("__n").alias("__all"))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__all").over(keys.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__all").over(keys))
    return joined(each.withColumn("__run", run), totals, [*by, "__part"]).withColumn("__run", F.col("__run") + F.col("__before")).drop("__before")


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by keys in which null equals null."""
    other = right.select(*(F.col(c).alias(f"__key_{c}" if c in keys else c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    return left.join(other, on).drop(*(f"__key_{k}" for k in keys))


def mock_comparison(shares: DataFrame, expected: DataFrame) -> DataFrame:
    """(sample, bray_curtis, other_pct, missing): mock samples against the expected composition.

    shares: (sample, taxon, pct) of mock samples. expected: (taxon, weight), a small table. Missing: taxa with less than a
    quarter of their expected per cent.
    """
    total = Window.partitionBy(F.lit(0))
    want = F.broadcast(expected.select("taxon", (100 * F.col("weight") / F.sum("weight").over(total)).alias("expected")))
    grid = shares.select("sample").distinct().join(want)
    own = grid.join(shares, ["sample", "taxon"], "left").select("sample", "taxon", "expected", F.coalesce("pct", F.lit(0.0)).alias("observed"))
    per = own.groupBy("sample").agg(F.sum(F.abs(F.col("expected") - F.col("observed"))).alias("apart"), F.sum("observed").alias("known"), F.sort_array(F.collect_list(F.when(F.col("observed") < 0.25 * F.col("expected"), F.col("taxon")))).alias("missing"))
    rest = shares.where(F.col("taxon") != UNCLASSIFIED).groupBy("sample").agg(F.sum("pct").alias("named"))
    return per.join(rest, "sample", "left").select("sample", ((F.col("apart") + F.coalesce("named", F.lit(0.0)) - F.col("known")) / 200).alias("bray_curtis"), (F.coalesce("named", F.lit(0.0)) - F.col("known")).alias("other_pct"), F.array_join("missing", "|").alias("missing"))


def rescaled(features: DataFrame, final_reads: DataFrame) -> DataFrame:
    """Counts scaled so that each sample adds up to its final number of reads."""
    share = F.try_divide("reads", F.sum("reads").over(Window.partitionBy("sample")))
    return features.withColumn("__share", share).join(final_reads, "sample").select("sample", "feature_id", (F.col("__share") * F.col("final_reads")).alias("reads"))


def looks_like_ppm(features: DataFrame, off: float = 1e4) -> DataFrame:
    """One row, ppm: whether every sample with reads adds up to about a million."""
    totals = features.groupBy("sample").agg(F.sum("reads").alias("t")).where("t <> 0")
    return totals.agg(F.coalesce(F.bool_and(F.abs(F.col("t") - 1e6) <= off), F.lit(False)).alias("ppm"))


def numbered(rows: DataFrame, value: str, tie: str, name: str = "number") -> DataFrame:
    """Adds each row's place from the largest value, ties by another column; rows without a value are left out.

    Rows are dealt by ranges of both columns and counted range by range, so no value is too common: only the sizes of the
    ranges meet in one place.
    """
    keep, order = Rounds(rows.sparkSession, "numbered"), [F.desc(value), F.asc(tie)]
    dealt = rows.where(F.col(value).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = keep(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long")).alias("__before"))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")  # a row for each range


def positional_ids(features: DataFrame, prefix: str = "SV", digits: int = 3) -> DataFrame:
    """(feature_id, name, total): names numbered from the most abundant feature."""
    totals = numbered(features.groupBy("feature_id").agg(F.sum("reads").alias("total")), "total", "feature_id")
    return totals.select("feature_id", "total", F.format_string(f"{prefix}%0{digits}d", "number").alias("name"))


def rollup_ranks(named: DataFrame, ranks: list[str]) -> DataFrame:
    """Reads by every prefix of the ranks at once, in one pass. level: number of ranks in the key."""
    sets = [ranks[:i] for i in range(len(ranks) + 1)]
    level = sum((1 - F.grouping(r).cast("int") for r in ranks), F.lit(0))
    return named.groupingSets(sets, *ranks).agg(level.cast("int").alias("level"), F.sum("reads").alias("reads"))
