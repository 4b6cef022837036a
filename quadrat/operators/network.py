"""Co-occurrence of taxa: correlations of their ranks over samples, degrees and participation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.blocks import pair_sums
from quadrat.operators.stats import mid_rank, t_p


def correlations(counts: DataFrame, least: float = 0.6, most_p: float | None = None) -> DataFrame:
    """(a, b, both, rho, p): Spearman correlation of taxa over all samples, absent ones counting as 0, with |rho| of at least ``least`` and p of at most ``most_p``, if given.

    Zeros of absent samples tie at the lowest rank of a taxon, so the sums over the dense grid follow from the rows that
    exist, as sums over blocks of taxa and samples. For two taxa that never meet the sums reduce to -v v', with one number for each taxon;
    those pairs meet by classes of that number which can reach the limit.
    """
    n = counts.agg(F.count_distinct("sample")).first()[0] or 1
    own = Window.partitionBy("taxon")
    present = counts.where("value > 0")
    z = n - F.count("*").over(own)
    # ranks on the grid: absent samples share rank (z + 1) / 2, present ones come after them; centred at (n + 1) / 2
    r = present.withColumn("c", mid_rank("value", ["taxon"]) + z - (n + 1) / 2).withColumn("z", z)
    r = r.withColumn("low", (F.col("z") + 1) / 2 - (n + 1) / 2)
    r = r.withColumn("ss", F.sum(F.col("c") * F.col("c")).over(own) + F.col("z") * F.col("low") * F.col("low")).withColumn("sum_c", F.sum("c").over(own))
    rows = r.select(F.col("taxon").alias("item"), F.col("sample").alias("feature"), F.col("c").alias("v"), F.lit(1.0).alias("w"))
    each = r.groupBy("taxon").agg(*[F.first(c).alias(c) for c in ("low", "ss", "sum_c", "z")])
    side = lambda x: each.select(*(F.col(c).alias(x if c == "taxon" else f"{c}_{x}") for c in ("taxon", "low", "ss", "sum_c", "z")))
    met = pair_sums(rows, ["both", "product", "first", "second"]).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("both").cast("long").alias("both"), F.col("product").alias("cc"), F.col("first").alias("ca"), F.col("second").alias("cb"))
    s = met.join(side("a"), "a").join(side("b"), "b")
    only_a, only_b = (F.col("sum_c_a") - F.col("ca")) * F.col("low_b"), (F.col("sum_c_b") - F.col("cb")) * F.col("low_a")
    neither = (F.col("z_a") + F.col("z_b") - n + F.col("both")) * F.col("low_a") * F.col("low_b")
    rho = F.try_divide(F.col("cc") + only_a + only_b + neither, F.sqrt(F.col("ss_a") * F.col("ss_b")))

    v = F.try_divide(-F.col("low") * n**0.5, F.sqrt("ss"))
    taxa = r.select("taxon", "z", v.alias("v")).distinct().where("v > 0").withColumn("k", F.floor(8 * F.log2("v")).cast("int"))
    # v is at most sqrt(3), of class 6; classes k and k' reach the limit only if (k + 1 + k' + 1) / 8 >= log2(least)
    first = F.ceil(F.lit(8 * math.log2(max(least, 1e-6)) - 2) - F.col("k")).cast("int")
    wide = taxa.where(first <= 6).select(F.col("taxon").alias("a"), F.col("z").alias("z_a"), F.col("v").alias("v_a"), F.explode(F.sequence(first, F.lit(6))).alias("k"))
    apart = wide.join(taxa.select("k", F.col("taxon").alias("b"), F.col("z").alias("z_b"), F.col("v").alias("v_b")), "k").where((F.col("a") < F.col("b")) & (F.col("z_a") + F.col("z_b") >= n))
    apart = apart.select("a", "b", F.lit(0).cast("long").alias("both"), (-F.col("v_a") * F.col("v_b")).alias("rho")).join(s.select("a", "b"), ["a", "b"], "left_anti")
    out = s.select("a", "b", "both", rho.alias("rho")).unionByName(apart).where(F.abs("rho") >= least)
    t = F.try_divide(F.col("rho") * max(n - 2, 0) ** 0.5, F.sqrt(F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0))))
    out = out.withColumn("p", F.when(F.abs("rho") >= 1 - 1e-12, 0.0).otherwise(t_p(t, F.lit(max(n - 2, 1)))))
    return out if most_p is None else out.where(F.col("p") <= most_p)


def degrees(edges: DataFrame) -> DataFrame:
    """(taxon, degree, positive): links of each taxon."""
    both = edges.select(F.col("a").alias("taxon"), "rho").unionByName(edges.select(F.col("b").alias("taxon"), "rho"))
    return both.groupBy("taxon").agg(F.count("*").alias("degree"), F.sum((F.col("rho") > 0).cast("int")).alias("positive"))


def modules(edges: DataFrame) -> DataFrame:
    """(taxon, module): groups of taxa by greedy modularity: the two groups whose union raises it most are joined, ties to the smaller numbers, until none does. Numbers go from the smallest name.

    What is joined next depends on all joins before it, so a network is one task; its taxa are those of a rank that pass the filters, some thousands at most.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["a"]) | set(rows["b"]))
        at = {n: i for i, n in enumerate(names)}
        links: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
        for a, b in zip(rows["a"].map(at), rows["b"].map(at), strict=True):
            links[a][b] = links[b][a] = links[a].get(b, 0.0) + 1.0
        total = sum(sum(x.values()) for x in links.values())
        degree = {i: sum(x.values()) for i, x in links.items()}
        member = {i: [i] for i in links}
        while True:
            gain, a, b = max(((x / total - degree[i] * degree[j] / total**2, -i, -j) for i, near in links.items() for j, x in near.items() if i < j), default=(0.0, 0, 0))
            if gain <= 1e-12:
                break
            a, b = -a, -b
            for c, x in links.pop(b).items():
                links[c].pop(b)
                if c != a:
                    links[a][c] = links[c][a] = links[a].get(c, 0.0) + x
            degree[a] += degree.pop(b)
            member[a] += member.pop(b)
        groups = sorted(member.values(), key=min)
        return pd.DataFrame([(names[i], k + 1) for k, own in enumerate(groups) for i in own], columns=["taxon", "module"])

    return edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.lit(1).alias("k")).groupBy("k").applyInPandas(run, "taxon string, module int")


def roles(edges: DataFrame, modules: DataFrame, hub: float = 2.5, connector: float = 0.62) -> DataFrame:
    """(taxon, module, zi, pi, role): degree as z-score among the taxa of the module, spread of the links over modules, and the role they give."""
    m = modules.select(F.col("taxon").alias("other"), F.col("module").alias("other_module"))
    both = edges.select(F.col("a").alias("taxon"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("taxon"), F.col("a").alias("other")))
    per = both.join(m, "other").groupBy("taxon", "other_module").agg(F.count("*").alias("k")).join(modules, "taxon")
    s = per.groupBy("taxon", "module").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    own = Window.partitionBy("module")
    zi = F.coalesce(F.try_divide(F.col("k") - F.avg("k").over(own), F.stddev_samp("k").over(own)), F.lit(0.0))
    pi = 1 - F.col("kk") / (F.col("k") * F.col("k"))
    role = F.when((F.col("zi") >= hub) & (F.col("pi") >= connector), "network hub").when(F.col("zi") >= hub, "module hub").when(F.col("pi") >= connector, "connector").otherwise("peripheral")
    return s.select("taxon", "module", zi.alias("zi"), pi.alias("pi")).withColumn("role", role)
