"""Differential abundance by models: negative binomial Wald tests, and log-linear tests without the bias of sampling.

Counts are long, (sample, taxon, reads); groups are (sample, grp). A sample without a group takes no part.

Negative binomial. Size factors are medians of log ratios to the taxa's geometric means over positive counts. A taxon's
dispersion comes from its variance within groups; the trend a / mean + b over all taxa is fitted by weighted sums, and each
log dispersion is drawn towards it by how much it varies beyond what its degrees of freedom explain. The model has a mean
for each group, so a taxon's fit falls apart into one number a group, found by scoring steps over the group's samples in
Spark's own expressions. Only taxa present in a tenth of the samples are fitted: so the grid with its zeros has at most
ten rows for each row of counts.

Bias correction. Log counts of present taxa differ between groups by the taxon's own difference and by a bias of sampling
that all taxa share. Taxa that don't differ scatter around the bias; it is the middle one of three normal parts, fitted by
expectation and maximisation over all taxa's differences. Each round is one row of sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.stats import benjamini_hochberg, normal_p
from quadrat.rounds import Rounds

LEAST_DISPERSION, MOST_DISPERSION, PRESENT = 1e-8, 100.0, 0.1
STEPS = 30


def _grouped(counts: DataFrame, groups: DataFrame) -> DataFrame:
    own = groups.where("grp IS NOT NULL").select("sample", "grp").distinct()
    return counts.where("reads > 0").groupBy("sample", "taxon").agg(F.sum("reads").cast("double").alias("reads")).join(own, "sample")


def size_factors(counts: DataFrame) -> DataFrame:
    """(sample, factor): their geometric mean is 1. Samples without reads have no row."""
    present = counts.where("reads > 0").groupBy("sample", "taxon").agg(F.sum("reads").cast("double").alias("reads"))
    n = present.select("sample").distinct().count()
    level = present.groupBy("taxon").agg((F.sum(F.log("reads")) / max(n, 1)).alias("level"))
    raw = present.join(level, "taxon").groupBy("sample").agg(F.median(F.log("reads") - F.col("level")).alias("f"))
    mean = raw.agg(F.avg("f").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("sample", F.exp(F.col("f") - F.col("mean")).alias("factor"))


def _grid(counts: DataFrame, groups: DataFrame, factors: DataFrame, present: float) -> DataFrame:
    """(taxon, grp, sample, reads, factor) with zeros, for taxa in at least that share of the samples."""
    rows = _grouped(counts, groups).join(factors, "sample")
    samples = groups.where("grp IS NOT NULL").select("sample", "grp").distinct().join(factors, "sample")
    n = samples.count()
    taxa = rows.groupBy("taxon").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= max(present * n, 1)).select("taxon")
    # a taxon meets the samples group by group: the grid is the model's own table
    kinds = samples.select("grp").distinct()
    grid = taxa.join(kinds, F.lit(True)).join(samples, "grp")
    return grid.join(rows.select("taxon", "sample", "reads"), ["taxon", "sample"], "left").select("taxon", "grp", "sample", "factor", F.coalesce("reads", F.lit(0.0)).alias("reads"))


def nb_moments(counts: DataFrame, groups: DataFrame, present: float = PRESENT) -> DataFrame:
    """(taxon, base_mean, df, dispersion): mean of counts over size factors, degrees of freedom within groups, and the
    dispersion that the variance within groups gives."""
    return _moments(_grid(counts, groups, size_factors(_grouped(counts, groups)), present))


def _moments(grid: DataFrame) -> DataFrame:
    value = F.col("reads") / F.col("factor")
    per = grid.groupBy("taxon", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q"), F.sum(1 / F.col("factor")).alias("inverse"))
    inner = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    all_ = per.groupBy("taxon").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), inner.alias("inner"), F.sum("inverse").alias("inverse"), F.count(F.lit(1)).alias("k"))
    mean, df = F.col("s") / F.col("n"), F.col("n") - F.col("k")
    raw = F.try_divide(F.try_divide(F.greatest(F.col("inner"), F.lit(0.0)), df.cast("double")) - F.col("inverse") / F.col("n") * mean, mean * mean)
    return all_.select("taxon", mean.alias("base_mean"), df.alias("df"), F.least(F.greatest(raw, F.lit(LEAST_DISPERSION)), F.lit(MOST_DISPERSION)).alias("dispersion"))


def dispersion_trend(moments: DataFrame, rounds: int = 20) -> tuple[float, float]:
    """(a, b) of dispersion = a / mean + b over taxa above the least dispersion; each round is five sums over all taxa."""
    good = moments.where(F.col("dispersion") > 100 * LEAST_DISPERSION).select((1 / F.col("base_mean")).alias("x"), F.col("dispersion").alias("y"))
    first = good.agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    if not first["n"]:
        return 0.0, LEAST_DISPERSION
    a, b = 0.0, first["y"]
    for _ in range(rounds):
        fit = F.greatest(F.lit(a) * F.col("x") + b, F.lit(LEAST_DISPERSION))
        w = 1 / (fit * fit)  # the variance of a dispersion grows with its square
        own = good.withColumn("ratio", F.col("y") / fit).where("ratio BETWEEN 1e-4 AND 15")
        s = own.agg(*[F.sum(w * v).alias(k) for k, v in (("w", F.lit(1.0)), ("x", F.col("x")), ("xx", F.col("x") * F.col("x")), ("y", F.col("y")), ("xy", F.col("x") * F.col("y")))]).first()
        if s["w"] is None:
            break
        det = s["w"] * s["xx"] - s["x"] ** 2
        if det <= 1e-12 * s["w"] * s["xx"]:
            new = 0.0, s["y"] / s["w"]
        else:
            new = (s["w"] * s["xy"] - s["x"] * s["y"]) / det, (s["xx"] * s["y"] - s["x"] * s["xy"]) / det
        if new[0] < 0:  # no slope: one level for all
            new = 0.0, s["y"] / s["w"]
        elif new[1] <= 0:
            new = s["xy"] / s["xx"], LEAST_DISPERSION
        done = abs(new[0] - a) + abs(new[1] - b) < 1e-6 * (abs(a) + abs(b))
        a, b = new
        if done:
            break
    return float(a), float(b)


def _trigamma(x: float) -> float:
    total = 0.0
    while x < 8:
        total, x = total + 1 / x**2, x + 1
    return total + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def shrunk_dispersions(moments: DataFrame) -> DataFrame:
    """The moments with trend and final: log dispersions are drawn to the trend as if both were normal; a taxon far above it
    (two deviations of the taxa) keeps its own."""
    a, b = dispersion_trend(moments)
    fitted = moments.withColumn("trend", F.greatest(F.lit(a) / F.col("base_mean") + b, F.lit(LEAST_DISPERSION))).withColumn("off", F.log("dispersion") - F.log("trend"))
    good = fitted.where(F.col("dispersion") > 100 * LEAST_DISPERSION)
    middle = good.agg(F.percentile_approx("off", 0.5, 100_000).alias("m"), F.max("df").alias("df")).first()
    if middle["m"] is None or not middle["df"]:
        return fitted.drop("off").withColumn("final", F.col("trend"))
    spread = good.agg(F.percentile_approx(F.abs(F.col("off") - middle["m"]), 0.5, 100_000).alias("d")).first()["d"] * 1.4826
    noise = _trigamma(middle["df"] / 2)
    prior = max(spread**2 - noise, 0.25)
    drawn = F.exp(F.log("trend") + F.col("off") * prior / (prior + noise))
    return fitted.withColumn("final", F.when(F.col("off") > 2 * math.sqrt(prior + noise), F.col("dispersion")).otherwise(drawn)).drop("off")


def nb_means(grid: DataFrame, dispersions: DataFrame, steps: int = STEPS) -> DataFrame:
    """(taxon, grp, n, log_mean, information): the mean of each group by scoring, with dispersions (taxon, final)."""
    rows = grid.groupBy("taxon", "grp").agg(F.collect_list(F.struct("reads", "factor")).alias("own"), F.sum("reads").alias("y"), F.sum("factor").alias("s"), F.count(F.lit(1)).alias("n"))  # one entry for each sample of the group
    rows = rows.join(dispersions.select("taxon", "final"), "taxon").withColumn("start", F.log(F.greatest(F.col("y"), F.lit(1e-3)) / F.col("s")))
    sums = "aggregate(own, named_struct('u', 0D, 'i', 0D), (a, r) -> named_struct('u', a.u + (r.reads - r.factor * exp({b})) / (1 + final * r.factor * exp({b})), 'i', a.i + r.factor * exp({b}) / (1 + final * r.factor * exp({b}))))"
    # a group without reads has its mean at zero: steps are bounded, and the floor keeps it finite
    inner = sums.format(b="b")
    step = f"transform(array({inner}), x -> greatest(b + least(greatest(x.u / greatest(x.i, 1e-12D), -2D), 2D), start - 10D))[0]"
    fitted = rows.withColumn("log_mean", F.expr(f"aggregate(sequence(1, {steps}), start, (b, k) -> {step})"))
    return fitted.withColumn("information", F.expr(sums.format(b="log_mean") + ".i")).select("taxon", "grp", "n", "log_mean", "information")


def nb_wald(counts: DataFrame, groups: DataFrame, reference: str, present: float = PRESENT) -> DataFrame:
    """(taxon, grp, base_mean, dispersion, log2_change, error, z, p, q): each group against the reference, q within it."""
    keep = Rounds(counts.sparkSession, "wald")
    grid = keep(_grid(counts, groups, size_factors(_grouped(counts, groups)), present))
    final = keep(shrunk_dispersions(keep(_moments(grid))))
    means = nb_means(grid, final)
    base = means.where(F.col("grp") == reference).select("taxon", F.col("log_mean").alias("ref_mean"), F.col("information").alias("ref_information"))
    both = means.where(F.col("grp") != reference).join(base, "taxon").join(final.select("taxon", "base_mean", F.col("final").alias("dispersion")), "taxon")
    change = (F.col("log_mean") - F.col("ref_mean")) / math.log(2)
    error = F.sqrt(1 / F.greatest("information", F.lit(1e-12)) + 1 / F.greatest("ref_information", F.lit(1e-12))) / math.log(2)
    out = both.select("taxon", "grp", "base_mean", "dispersion", change.alias("log2_change"), error.alias("error")).withColumn("z", F.col("log2_change") / F.col("error"))
    out = keep(benjamini_hochberg(out.withColumn("p", normal_p(F.col("z"))), by=["grp"]))
    keep.keep(out)
    return out


def log_differences(counts: DataFrame, groups: DataFrame, reference: str, present: float = PRESENT) -> DataFrame:
    """(taxon, grp, n, difference, variance): difference of the means of log counts of the samples that have the taxon."""
    rows = _grouped(counts, groups)
    n = groups.where("grp IS NOT NULL").select("sample").distinct().count()
    kept = rows.groupBy("taxon").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= max(present * n, 1)).select("taxon")
    value = F.log("reads")
    per = rows.join(kept, "taxon").groupBy("taxon", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    pooled = per.groupBy("taxon").agg(F.sum(F.col("n") * F.col("var")).alias("ss"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    base = per.where(F.col("grp") == reference).select("taxon", F.col("n").alias("n0"), F.col("mean").alias("mean0"))
    both = per.where(F.col("grp") != reference).join(base, "taxon").join(pooled, "taxon").where("all > k")
    variance = F.col("ss") / (F.col("all") - F.col("k")) * (1 / F.col("n") + 1 / F.col("n0"))
    return both.select("taxon", "grp", (F.col("n") + F.col("n0")).alias("n"), (F.col("mean") - F.col("mean0")).alias("difference"), variance.alias("variance"))


def sampling_bias(differences: DataFrame, rounds: int = 100, tolerance: float = 1e-4) -> dict[str, float]:
    """The bias of each group: the middle of three normal parts of (grp, difference, variance).

    Taxa of the middle part scatter by their own variances; the others lie below and above it, more widely.
    """
    good = differences.where("variance > 0")
    first = good.groupBy("grp").agg(F.percentile_approx("difference", F.array(F.lit(0.125), F.lit(0.5), F.lit(0.875)), 100_000).alias("q"), F.var_pop("difference").alias("v"), F.avg("variance").alias("own"))
    state = {r["grp"]: {"pi": (0.125, 0.75, 0.125), "bias": r["q"][1], "low": min(r["q"][0] - r["q"][1], -1e-3), "high": max(r["q"][2] - r["q"][1], 1e-3), "wide": (max(r["v"] - r["own"], 0.01),) * 2} for r in first.collect()}  # a row for each group
    open_ = set(state)
    for _ in range(rounds):
        if not open_:
            break
        now = good.sparkSession.createDataFrame([(g, *s["pi"], s["bias"], s["low"], s["high"], *s["wide"]) for g, s in state.items() if g in open_], "grp string, p1 double, p0 double, p2 double, bias double, low double, high double, w1 double, w2 double")
        rows = good.join(F.broadcast(now), "grp")
        parts = {"1": ("p1", F.col("bias") + F.col("low"), F.col("variance") + F.col("w1")), "0": ("p0", F.col("bias"), F.col("variance")), "2": ("p2", F.col("bias") + F.col("high"), F.col("variance") + F.col("w2"))}
        logs = {k: F.log(F.greatest(F.col(p), F.lit(1e-12))) - F.log(v) / 2 - (F.col("difference") - m) * (F.col("difference") - m) / (2 * v) for k, (p, m, v) in parts.items()}
        rows = rows.withColumns({f"l{k}": x for k, x in logs.items()}).withColumn("top", F.greatest("l0", "l1", "l2"))
        rows = rows.withColumn("all", sum((F.exp(F.col(f"l{k}") - F.col("top")) for k in parts), F.lit(0.0))).withColumns({f"r{k}": F.exp(F.col(f"l{k}") - F.col("top")) / F.col("all") for k in parts})
        off, sums = {"1": F.col("low"), "0": F.lit(0.0), "2": F.col("high")}, []
        for k, (_, _, v) in parts.items():
            r, y = F.col(f"r{k}"), F.col("difference")
            sums += [F.sum(r).alias(f"n{k}"), F.sum(r / v).alias(f"h{k}"), F.sum(r * (y - off[k]) / v).alias(f"b{k}"), F.sum(r * (y - F.col("bias")) / v).alias(f"o{k}"), F.sum(r * ((y - F.col("bias") - off[k]) * (y - F.col("bias") - off[k]) - F.col("variance"))).alias(f"v{k}")]
        for s in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row for each group
            old = state[s["grp"]]
            wide = tuple(max(s[f"v{k}"] / s[f"n{k}"], 1e-4) if s[f"n{k}"] > 1e-9 else old["wide"][i] for i, k in enumerate("12"))
            new = {
                "pi": tuple(s[f"n{k}"] / s["n"] for k in "102"),
                "bias": sum(s[f"b{k}"] for k in "012") / sum(s[f"h{k}"] for k in "012"),
                "low": min(s["o1"] / s["h1"], 0.0) if s["h1"] > 1e-12 else old["low"],
                "high": max(s["o2"] / s["h2"], 0.0) if s["h2"] > 1e-12 else old["high"],
                "wide": wide,
            }
            state[s["grp"]] = new
            if abs(new["bias"] - old["bias"]) < tolerance:
                open_.discard(s["grp"])
    return {g: s["bias"] for g, s in state.items()}


def bias_corrected_tests(counts: DataFrame, groups: DataFrame, reference: str, present: float = PRESENT) -> DataFrame:
    """(taxon, grp, n, difference, error, z, p, q): differences of log counts less their group's bias; q within the group."""
    spark = counts.sparkSession
    keep = Rounds(spark, "bias")
    rows = keep(log_differences(counts, groups, reference, present).withColumn("grp", F.col("grp").cast("string")))
    bias = spark.createDataFrame(list(sampling_bias(rows).items()), "grp string, bias double")
    out = rows.join(F.broadcast(bias), "grp", "left").withColumns({"difference": F.col("difference") - F.coalesce("bias", F.lit(0.0)), "error": F.sqrt("variance")})
    out = out.withColumn("z", F.try_divide("difference", "error")).withColumn("p", normal_p(F.col("z"))).drop("bias", "variance")
    out = keep(benjamini_hochberg(out, by=["grp"]))
    keep.keep(out)
    return out.select("taxon", "grp", "n", "difference", "error", "z", "p", "q")
