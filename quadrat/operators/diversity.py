"""Diversity within and between samples, from long counts (sample, feature_id, reads)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import kernels
from quadrat.operators.blocks import grid_sums, pair_sums
from quadrat.rounds import Rounds


def alpha(features: DataFrame, classic_chao: bool = False) -> DataFrame:
    """Observed, Chao1 with its standard error, ACE, Shannon and Simpson of each sample. Counts are rounded half to even.

    One aggregation: each index is made of sums over the sample's features.
    """
    c = features.select("sample", F.bround("reads").alias("c")).where("c > 0")
    c = c.withColumn("total", F.sum("c").over(Window.partitionBy("sample"))).withColumn("p", F.col("c") / F.col("total"))
    rare = F.col("c") <= 10
    s = c.groupBy("sample").agg(
        F.count("*").alias("observed"), F.sum((F.col("c") == 1).cast("long")).alias("f1"), F.sum((F.col("c") == 2).cast("long")).alias("f2"),
        F.sum(rare.cast("long")).alias("s_rare"), F.sum(F.when(rare, F.col("c")).otherwise(0)).alias("n_rare"), F.sum(F.when(rare, F.col("c") * (F.col("c") - 1)).otherwise(0)).alias("pairs"),
        (-F.sum(F.col("p") * F.ln("p"))).alias("shannon"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"),
    )
    f1, f2, n_rare = F.col("f1").cast("double"), F.col("f2").cast("double"), F.col("n_rare").cast("double")
    corrected = f1 * (f1 - 1) / (2 * (f2 + 1))
    chao = F.when(f2 > 0, f1 * f1 / (2 * F.greatest(f2, F.lit(1.0)))).otherwise(f1 * (f1 - 1) / 2) if classic_chao else corrected
    se = F.when(f1 > 0, F.sqrt(corrected + f1 * F.pow(2 * f1 - 1, 2) / (4 * F.pow(f2 + 1, 2)) + f1 * f1 * f2 * F.pow(f1 - 1, 2) / (4 * F.pow(f2 + 1, 4)))).otherwise(0.0)
    cover = 1 - F.try_divide(f1, n_rare)
    spread = F.when(n_rare > 1, F.greatest(F.try_divide("s_rare", cover) * F.try_divide("pairs", n_rare * (n_rare - 1)) - 1, F.lit(0.0))).otherwise(0.0)
    ace = F.when((n_rare > 0) & (n_rare != f1), F.col("observed") - F.col("s_rare") + F.try_divide("s_rare", cover) + F.try_divide(f1, cover) * spread).otherwise(F.col("observed").cast("double"))
    return s.select("sample", "observed", (F.col("observed") + chao).alias("chao1"), se.alias("se_chao1"), ace.alias("ace"), "shannon", "simpson")


def evenness(features: DataFrame) -> DataFrame:
    """Shannon over its largest possible value; null for a single feature."""
    a = alpha(features)
    return a.select("sample", F.try_divide("shannon", F.ln("observed")).alias("evenness"))


def rank_abundance(features: DataFrame) -> DataFrame:
    own = Window.partitionBy("sample")
    share = F.col("reads") / F.sum("reads").over(own)
    return features.where("reads > 0").select("sample", "feature_id", F.row_number().over(own.orderBy(F.desc("reads"), "feature_id")).alias("rank"), share.alias("share"))


def rarefaction(features: DataFrame, points: int = 30, power: float = 1.6) -> DataFrame:
    """(sample, depth, expected): expected features at depths N (i / points) ** power. Samples are spread over tasks; one sample's counts are one group."""

    def curve(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.rint(rows["reads"].to_numpy()).astype(np.int64)
        total = int(counts.sum())
        depths = sorted({max(1, int(total * (i / points) ** power)) for i in range(1, points + 1)} | {total}) if total >= 2 else []
        return pd.DataFrame({"sample": rows["sample"].iloc[0], "depth": depths, "expected": [kernels.hurlbert(counts, d) for d in depths]}).astype({"depth": "int64", "expected": "float64"})

    kind = features.schema["sample"].dataType.simpleString()
    return features.select("sample", "reads").groupBy("sample").applyInPandas(curve, f"sample {kind}, depth long, expected double")


def rarefaction_steps(features: DataFrame, most: int = 50_000, parts: int = 50) -> DataFrame:
    """(sample, depth, expected) at the same depths for all samples: from 100 in equal steps to the largest sample's total, at most ``most``; a sample ends at its own total."""
    top = features.groupBy("sample").agg(F.sum(F.bround("reads")).alias("t")).agg(F.max("t").alias("t")).first()["t"]
    deepest = int(min(top or 0, most))
    steps = sorted({*range(100, deepest + 1, max(100, deepest // parts)), deepest} - {0})
    return _at_depths(features, steps)


def rarefaction_common(features: DataFrame, points: int = 25) -> DataFrame:
    """(sample, depth, expected) at that many depths up to the smallest sample's total, which all samples reach."""
    low = features.groupBy("sample").agg(F.sum(F.bround("reads")).alias("t")).agg(F.min("t").alias("t")).first()["t"]
    return _at_depths(features, sorted({int(x) for x in np.linspace(1, low or 0, points)} - {0}))


def _at_depths(features: DataFrame, steps: list[int]) -> DataFrame:
    def curve(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.rint(rows["reads"].to_numpy()).astype(np.int64)
        own = [s for s in steps if s <= counts.sum()]
        return pd.DataFrame({"sample": [rows["sample"].iloc[0]] * len(own), "depth": own, "expected": [kernels.hurlbert(counts, s) for s in own]}).astype({"depth": "int64", "expected": "float64"})

    kind = features.schema["sample"].dataType.simpleString()
    return features.select("sample", "reads").groupBy("sample").applyInPandas(curve, f"sample {kind}, depth long, expected double")


def shannon_rarefaction(features: DataFrame, most: int = 30_000, parts: int = 30, seed: int = 42) -> DataFrame:
    """(sample, depth, shannon) of one random draw without replacement at each depth; the draw depends on the seed alone. Samples with fewer than two depths are left out."""
    top = features.groupBy("sample").agg(F.sum(F.bround("reads")).alias("t")).agg(F.max("t").alias("t")).first()["t"]
    deepest = int(min(top or 0, most))
    steps = sorted({*range(100, deepest + 1, max(200, deepest // parts)), deepest} - {0})

    def curve(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.rint(rows.sort_values("feature_id")["reads"].to_numpy()).astype(np.int64)
        own, out = [s for s in steps if s <= counts.sum()], []
        for s in own if len(own) > 1 else ():
            drawn = np.random.default_rng(seed).multivariate_hypergeometric(counts, s, method="marginals")
            p = drawn[drawn > 0] / s
            out.append((rows["sample"].iloc[0], s, float(-(p * np.log(p)).sum())))
        return pd.DataFrame(out, columns=["sample", "depth", "shannon"]).astype({"depth": "int64", "shannon": "float64"})

    kind = features.schema["sample"].dataType.simpleString()
    return features.select("sample", "feature_id", "reads").groupBy("sample").applyInPandas(curve, f"sample {kind}, depth long, shannon double")


def plateau(features: DataFrame) -> DataFrame:
    """(sample, gained_pct): richness gained over the last tenth of the depth; null under 20 reads."""

    def gain(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.rint(rows["reads"].to_numpy()).astype(np.int64)
        total = int(counts.sum())
        full = kernels.hurlbert(counts, total) if total >= 20 else 0
        return pd.DataFrame({"sample": rows["sample"].iloc[:1], "gained_pct": [100 * (full - kernels.hurlbert(counts, int(total * 0.9))) / full if full else None]}).astype({"gained_pct": "float64"})

    kind = features.schema["sample"].dataType.simpleString()
    return features.select("sample", "reads").groupBy("sample").applyInPandas(gain, f"sample {kind}, gained_pct double")


def _grid(features: DataFrame, own: Column, value: Column, shared: str, share: bool = False) -> DataFrame:
    """(i, j, xi, xj, shared) of all pairs of samples: an aggregate of each, and a sum over the features that both have, of values or their shares of the aggregate."""
    counts = Rounds(features.sparkSession, "counts")(features.select("sample", "feature_id", "reads"), compression="zstd")
    v = counts.where("reads > 0").select(F.col("sample").alias("item"), F.col("feature_id").alias("feature"), value.alias("v"), F.lit(1.0).alias("w"))
    return grid_sums(counts.groupBy(F.col("sample").alias("item")).agg(own.alias("x")), v, shared, share=share).withColumnRenamed(shared, "shared")


def sample_pairs(samples: DataFrame) -> DataFrame:
    """All (i, j) with i < j: the rows of a distance matrix, which is this operator's result, from the list of samples alone."""
    s = samples.select("sample").distinct()
    return s.select(F.col("sample").alias("i")).join(s.select(F.col("sample").alias("j")), F.col("i") < F.col("j"))


def bray_curtis(features: DataFrame, on_counts: bool = False) -> DataFrame:
    """(i, j, d) of proportions, or of raw counts. Pairs without a common feature have distance 1; two empty samples 0."""
    total = F.sum("reads")
    if on_counts:
        grid = _grid(features, total, F.col("reads"), "least")
        return grid.select("i", "j", F.coalesce(1 - F.try_divide(2 * F.col("shared"), F.col("xi") + F.col("xj")), F.lit(0.0)).alias("d"))
    grid = _grid(features, total, F.col("reads"), "least", share=True)
    return grid.select("i", "j", F.when((F.col("xi") == 0) & (F.col("xj") == 0), 0.0).otherwise(1 - F.col("shared")).alias("d"))


def jaccard(features: DataFrame) -> DataFrame:
    """(i, j, d) of presence and absence."""
    grid = _grid(features, F.sum((F.col("reads") > 0).cast("long")), F.lit(1), "both")
    return grid.select("i", "j", F.coalesce(1 - F.try_divide("shared", F.col("xi") + F.col("xj") - F.col("shared")), F.lit(0.0)).alias("d"))


def quantitative_jaccard(bray: DataFrame) -> DataFrame:
    return bray.select("i", "j", (2 * F.col("d") / (1 + F.col("d"))).alias("d"))


def unifrac(features: DataFrame, ancestry: DataFrame, weighted: bool = False) -> DataFrame:
    """(i, j, d). ancestry: (feature_id, node, length), a row for each branch from a tip to the root; branches are features of their own."""
    own = Window.partitionBy("sample")
    p = features.where("reads > 0").withColumn("p", F.col("reads") / F.sum("reads").over(own))
    on = p.join(ancestry.hint("merge"), "feature_id").groupBy("sample", "node").agg(F.sum("p").alias("p"), F.first("length").alias("length"))
    near = pair_sums(on.select(F.col("sample").alias("item"), F.col("node").alias("feature"), F.col("p").alias("v"), F.col("length").alias("w")), ["both", "least"])
    reach = on.groupBy("sample").agg(F.sum("length").alias("u"), F.sum(F.col("length") * F.col("p")).alias("w"))
    grid = sample_pairs(features).join(reach.select(F.col("sample").alias("i"), F.col("u").alias("ui"), F.col("w").alias("wi")), "i").join(reach.select(F.col("sample").alias("j"), F.col("u").alias("uj"), F.col("w").alias("wj")), "j")
    both, least = F.coalesce("both", F.lit(0.0)), F.coalesce("least", F.lit(0.0))
    d = F.try_divide(F.col("wi") + F.col("wj") - 2 * least, F.col("wi") + F.col("wj")) if weighted else F.try_divide(F.col("ui") + F.col("uj") - 2 * both, F.col("ui") + F.col("uj") - both)
    return grid.join(near, ["i", "j"], "left").select("i", "j", F.coalesce(d, F.lit(0.0)).alias("d"))


def faith_pd(features: DataFrame, ancestry: DataFrame) -> DataFrame:
    """(sample, pd): total length of the branches above a sample's features. An ancestry has several rows for each feature: it is never broadcast."""
    on = features.where("reads > 0").join(ancestry.hint("merge"), "feature_id").select("sample", "node", "length").distinct()
    return on.groupBy("sample").agg(F.sum("length").alias("pd"))


def within_between(distances: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, grp_i, grp_j, n, mean_d): distances within groups and between each pair of them."""
    groups = Rounds(groups.sparkSession, "groups")(groups.select("sample", "grp"))  # their size is known then, so that many distances are not shuffled to meet few groups
    gi, gj = groups.select(F.col("sample").alias("i"), F.col("grp").alias("a")), groups.select(F.col("sample").alias("j"), F.col("grp").alias("b"))
    d = distances.join(gi, "i").join(gj, "j").select(F.least("a", "b").alias("grp_i"), F.greatest("a", "b").alias("grp_j"), "d")
    return d.groupBy("grp_i", "grp_j").agg(F.count("*").alias("n"), F.avg("d").alias("mean_d")).withColumn("kind", F.when(F.col("grp_i") == F.col("grp_j"), "within").otherwise("between"))


def clr(counts: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """(sample, taxon, clr): centred log ratio of count + pseudo over all taxa.

    A missing taxon contributes ln(pseudo), so the mean needs the number of taxa, not the dense grid; rows stay sparse and
    ``base`` is the value of every taxon without a row.
    """
    n = counts.agg(F.count_distinct("taxon")).first()[0]
    own = Window.partitionBy("sample")
    log = F.ln(F.col("reads") + pseudo)
    zero = float(np.log(pseudo))
    mean = (F.sum(log).over(own) + (n - F.count("*").over(own)) * zero) / n
    return counts.select("sample", "taxon", (log - mean).alias("clr"), (F.lit(zero) - mean).alias("base"))


def z_scores(shares: DataFrame, limit: float = 3.0) -> DataFrame:
    """(sample, taxon, z) of every taxon in every sample, absent ones counting as 0; clamped, and 0 for constant taxa.

    The grid of samples and taxa is this operator's result. It is made from the lists of names, not from the rows.
    """
    n = shares.agg(F.count_distinct("sample")).first()[0]
    sums = shares.groupBy("taxon").agg((F.sum("pct") / n).alias("mean"), F.sum(F.col("pct") * F.col("pct")).alias("ss"))
    sd = F.sqrt(F.greatest((F.col("ss") - n * F.col("mean") * F.col("mean")) / max((n or 1) - 1, 1), F.lit(0.0)))
    grid = sums.select("taxon", "mean", sd.alias("sd")).join(shares.select("sample").distinct())
    z = F.coalesce(F.try_divide(F.coalesce("pct", F.lit(0.0)) - F.col("mean"), F.when(F.col("sd") > 1e-12, F.col("sd"))), F.lit(0.0))
    return grid.join(shares.select("sample", "taxon", "pct"), ["sample", "taxon"], "left").select("sample", "taxon", F.greatest(F.lit(-limit), F.least(F.lit(limit), z)).alias("z"))
