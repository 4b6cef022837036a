"""Group comparisons. Statistics are sums and windows; only the tails of distributions are pandas functions on the few result rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import kernels
from quadrat.operators.community import joined, running_counts


def _tail(kernel):
    """A function of three columns by a kernel on whole arrays; null where the first is."""

    @F.pandas_udf("double")
    def p(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out, known = pd.Series(np.nan, index=x.index), x.notna() & a.notna() & b.notna()
        out[known] = kernel(x[known].to_numpy(), a[known].to_numpy(), b[known].to_numpy())
        return out.astype(object).where(known, None).astype("Float64")

    return p


def chi2_p(x: Column, df: Column) -> Column:
    return _tail(lambda v, m, n: kernels.chi2_tail(v, m))(x, df.cast("double"), F.lit(0.0))


def t_p(t: Column, df: Column) -> Column:
    return _tail(lambda v, m, n: kernels.t_tail(v, m))(t, df.cast("double"), F.lit(0.0))


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    return _tail(kernels.f_tail)(f, df1.cast("double"), df2.cast("double"))


def normal_p(z: Column) -> Column:
    return _tail(lambda v, m, n: kernels.normal_tail(v))(z, F.lit(0.0), F.lit(0.0))


def mid_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at the mean of their places."""
    own = Window.partitionBy(*by)
    return F.rank().over(own.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def kruskal(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, k, h, df): Kruskal-Wallis with tie correction of (by..., grp, value). Null h for one group or all values equal."""
    ranked = values.withColumn("r", mid_rank("value", by)).withColumn("t", F.count("*").over(Window.partitionBy(*by, "value")))
    per = ranked.groupBy(*by, "grp").agg(F.count("*").alias("m"), F.sum("r").alias("s"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    all_ = per.groupBy(*by).agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("ss"), F.sum("ties").alias("ties"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)
    correction = 1 - F.try_divide("ties", n * n * n - n)
    h = F.when((F.col("k") >= 2) & (n > F.col("k")) & (correction > 1e-15), F.try_divide(raw, correction))
    return all_.select(*by, "n", "k", h.alias("h"), (F.col("k") - 1).alias("df"))


def anova(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., f, df1, df2) of (by..., grp, value)."""
    per = values.groupBy(*by, "grp").agg(F.count("*").alias("m"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    s = per.groupBy(*by).agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("between"))
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    inner = F.greatest(F.col("q") - F.col("between"), F.lit(0.0))
    f = F.try_divide(F.try_divide(F.col("between") - F.col("s") * F.col("s") / F.col("n"), df1.cast("double")), F.try_divide(inner, df2.cast("double")))
    return s.select(*by, f.alias("f"), df1.alias("df1"), df2.alias("df2"))


def _group_moments(values: DataFrame, by: list[str]) -> DataFrame:
    return values.groupBy(*by, "grp").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def group_pairs(per: DataFrame, by: list[str]) -> DataFrame:
    """Every two groups of the same key side by side, columns suffixed _a and _b."""
    a = per.select(*by, *(F.col(c).alias(f"{c}_a") for c in per.columns if c not in by))
    b = per.select(*by, *(F.col(c).alias(f"{c}_b") for c in per.columns if c not in by))
    return (a.join(b, by) if by else a.join(b, F.col("grp_a") < F.col("grp_b"))).where("grp_a < grp_b")


def welch(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., grp_a, grp_b, diff, t, df) for each pair of groups; null t where a group has one value or neither varies."""
    p = group_pairs(_group_moments(values, by), by)
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))
    df = F.try_divide(F.pow(va + vb, 2), F.pow(va, 2) / (F.col("n_a") - 1) + F.pow(vb, 2) / (F.col("n_b") - 1))
    enough = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    return p.select(*by, "grp_a", "grp_b", (F.col("mean_a") - F.col("mean_b")).alias("diff"), F.when(enough, t).alias("t"), F.when(enough, df).alias("df"))


def wilcoxon(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., grp_a, grp_b, w, z) for each pair of groups: rank sum of the first, normal score with tie and continuity correction.

    A pair's values are ranked together, so each value takes part once for every other group: groups are few.
    """
    groups = values.select(*by, "grp").distinct()
    pairs = group_pairs(groups, by)
    both = pairs.join(values, by) if by else pairs.join(values)
    both = both.where((F.col("grp") == F.col("grp_a")) | (F.col("grp") == F.col("grp_b")))
    keys = [*by, "grp_a", "grp_b"]
    r = both.withColumn("r", mid_rank("value", keys)).withColumn("t", F.count("*").over(Window.partitionBy(*keys, "value")))
    first = F.col("grp") == F.col("grp_a")
    s = r.groupBy(*keys).agg(F.sum(F.when(first, F.col("r"))).alias("s"), F.sum(first.cast("long")).alias("na"), F.sum((~first).cast("long")).alias("nb"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    w = F.col("s") - na * (na + 1) / 2
    off = w - na * nb / 2
    sd = F.sqrt(na * nb / 12 * (na + nb + 1 - F.try_divide("ties", (na + nb) * (na + nb - 1))))
    return s.select(*keys, w.alias("w"), F.try_divide(off - F.signum(off) * 0.5, sd).alias("z"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Adds q: p n / rank, at most that of any larger p. Null p stay null and don't count."""
    by = by or []
    known = tests.where(F.col(p).isNotNull())
    raw = running_counts(known, p, by).withColumn("__q", F.col(p) * F.col("__all") / F.col("__run"))
    least = raw.groupBy(*by, "__part").agg(F.min("__q").alias("__least"))
    later = least.withColumn("__least", F.min("__least").over(Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)))
    own = F.min("__q").over(Window.partitionBy(*by, "__part").orderBy(F.desc(p)))
    q = joined(raw.withColumn("__own", own), later, [*by, "__part"]).select(*by, p, F.least(F.lit(1.0), "__own", "__least").alias("__q"))
    out = joined(known, q, [*by, p]).withColumn("q", F.col("__q")).drop("__q")
    return out.unionByName(tests.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def spearman(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by..., n, rho): correlation of mid-ranks; null for fewer than three rows or a constant side. Ranks are those of different values, in parts by quantile."""
    rank = lambda v, name: running_counts(pairs, v, by).select(*by, v, (F.col("__run") - (F.col("__n") - 1) / 2).alias(name))
    r = joined(joined(pairs.groupBy(*by, x, y).agg(F.count("*").alias("m")), rank(x, "rx"), [*by, x]), rank(y, "ry"), [*by, y])
    mean = lambda c: F.sum(F.col("m") * c) / F.sum("m")
    rx, ry = F.col("rx"), F.col("ry")
    s = r.groupBy(*by).agg(F.sum("m").alias("n"), mean(rx).alias("mx"), mean(ry).alias("my"), mean(rx * ry).alias("xy"), mean(rx * rx).alias("xx"), mean(ry * ry).alias("yy"))
    rho = F.try_divide(F.col("xy") - F.col("mx") * F.col("my"), F.sqrt(F.greatest(F.col("xx") - F.col("mx") * F.col("mx"), F.lit(0.0)) * F.greatest(F.col("yy") - F.col("my") * F.col("my"), F.lit(0.0))))
    return s.select(*by, "n", F.when(F.col("n") >= 3, rho).alias("rho"))


def effect_score(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., score): 3 log10(1 + SSB / SSW) of log10(value + 0.01), as used to rank discriminating taxa."""
    v = values.withColumn("value", F.log10(F.col("value") + 0.01))
    per = v.groupBy(*by, "grp").agg(F.count("*").alias("m"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    s = per.groupBy(*by).agg(F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"))
    ssb, ssw = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return s.select(*by, F.when(ssw > 1e-12, 3 * F.log10(1 + F.try_divide(F.greatest(ssb, F.lit(0.0)), ssw))).alias("score"))


def permanova_statistic(distances: DataFrame, groups: DataFrame) -> DataFrame:
    """One row (n, k, r2, f) from pairwise distances: sums of squares, without a dense matrix."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m"))
    gi, gj = groups.select(F.col("sample").alias("i"), F.col("grp").alias("a")), groups.select(F.col("sample").alias("j"), F.col("grp").alias("b"))
    d = distances.join(gi, "i").join(gj, "j").withColumn("d2", F.col("d") * F.col("d"))
    per = d.groupBy("a", "b").agg(F.sum("d2").alias("s")).join(sizes.withColumnRenamed("grp", "a"), "a")
    sums = per.agg(F.sum("s").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s") / F.col("m")).otherwise(0.0)).alias("within"))
    total = sizes.agg(F.sum("m").alias("n"), F.count("*").alias("k"))
    sst, n, k = F.col("all") / F.col("n"), F.col("n"), F.col("k")
    f = F.try_divide((sst - F.col("within")) / (k - 1), F.try_divide("within", (n - k).cast("double")))
    return sums.join(F.broadcast(total)).select("n", "k", F.try_divide(sst - F.col("within"), sst).alias("r2"), f.alias("f"))


def anosim_statistic(distances: DataFrame, groups: DataFrame) -> DataFrame:
    """One row (r): difference of the mean ranks of distances between and within groups."""
    gi, gj = groups.select(F.col("sample").alias("i"), F.col("grp").alias("a")), groups.select(F.col("sample").alias("j"), F.col("grp").alias("b"))
    rank = running_counts(distances, "d", []).select("d", (F.col("__run") - (F.col("__n") - 1) / 2).alias("r"))
    ranked = distances.join(rank, "d").join(gi, "i").join(gj, "j")
    s = ranked.agg(F.count("*").alias("m"), F.avg(F.when(F.col("a") != F.col("b"), F.col("r"))).alias("between"), F.avg(F.when(F.col("a") == F.col("b"), F.col("r"))).alias("within"))
    return s.select(F.try_divide(F.col("between") - F.col("within"), F.col("m") / 2.0).alias("r"))
