"""Linear models with a random intercept for each subject, fitted for every taxon at once from sums.

Samples of one subject are alike, so each taxon's values are fitted as variables plus a subject's own level. All that the
restricted likelihood needs are sums: by subject first, then over the subjects that have the same number of samples, as a
subject counts only by its number of samples, its sums of the variables and its sum of the values. So a taxon comes down to
one row of sums for each different number of samples, however many subjects and samples there are; what is fitted in Python
are these few rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.stats import benjamini_hochberg, t_p

RATIOS = np.exp(np.linspace(-10, 10, 81))


def mixed_sums(values: DataFrame, metadata: DataFrame, variables: list[str]) -> DataFrame:
    """(taxon, n, subjects, xx, xy, yy, bb, bc, cc): sums over the subjects with n samples of the taxon.

    values: (sample, taxon, value); metadata: (sample, subject, variables...). xx, xy, yy are sums of products over samples,
    bb, bc, cc of products of the subjects' sums; the first variable is 1. Tables are rows one after another. A sample without
    a subject is a subject of its own; samples that lack a variable or a value are left out.
    """
    known = metadata.select("sample", F.coalesce(F.concat(F.lit("s:"), F.col("subject").cast("string")), F.concat(F.lit("own:"), F.col("sample").cast("string"))).alias("subject"), *[F.col(v).cast("double").alias(f"x{k + 1}") for k, v in enumerate(variables)])
    known = known.dropDuplicates(["sample"]).dropna()
    rows = values.where("value IS NOT NULL").select("sample", "taxon", F.col("value").cast("double").alias("y")).join(known, "sample").withColumn("x0", F.lit(1.0))
    xs = [f"x{k}" for k in range(len(variables) + 1)]
    cells = [(a, b) for a in xs for b in xs]
    per = rows.groupBy("taxon", "subject").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"b_{a}") for a in xs], F.sum("y").alias("c"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        *[F.sum(F.col(a) * F.col("y")).alias(f"xy_{a}") for a in xs], *[F.sum(F.col(a) * F.col(b)).alias(f"xx_{a}_{b}") for a, b in cells if a <= b],
    )
    ordered = lambda a, b: f"xx_{min(a, b)}_{max(a, b)}"
    return per.groupBy("taxon", "n").agg(
        F.count(F.lit(1)).alias("subjects"), F.array(*[F.sum(ordered(a, b)) for a, b in cells]).alias("xx"), F.array(*[F.sum(f"xy_{a}") for a in xs]).alias("xy"), F.sum("yy").alias("yy"),
        F.array(*[F.sum(F.col(f"b_{a}") * F.col(f"b_{b}")) for a, b in cells]).alias("bb"), F.array(*[F.sum(F.col(f"b_{a}") * F.col("c")) for a in xs]).alias("bc"), F.sum(F.col("c") * F.col("c")).alias("cc"),
    )


class _Profile:
    """The restricted likelihood of one taxon by the ratio of the subjects' variance to the samples'."""

    def __init__(self, rows: pd.DataFrame):
        p = len(rows["xy"].iloc[0])
        stack = lambda c, *shape: np.stack([np.asarray(v, float).reshape(shape) for v in rows[c]])
        self.n, self.m = rows["n"].to_numpy(float), rows["subjects"].to_numpy(float)
        self.xx, self.xy, self.yy = stack("xx", p, p).sum(axis=0), stack("xy", p).sum(axis=0), float(rows["yy"].sum())
        self.bb, self.bc, self.cc = stack("bb", p, p), stack("bc", p), rows["cc"].to_numpy(float)
        self.total, self.p = int((self.n * self.m).sum()), p

    def fit(self, ratio: float):
        """(-2 log-likelihood, estimates, their covariance over the variance, variance)."""
        k = ratio / (1 + self.n * ratio)
        a, v, w = self.xx - np.tensordot(k, self.bb, 1), self.xy - k @ self.bc, self.yy - float(k @ self.cc)
        inverse = np.linalg.inv(a)
        beta = inverse @ v
        variance = max((w - float(beta @ v)) / (self.total - self.p), 1e-300)
        return float(self.m @ np.log1p(self.n * ratio)) + (self.total - self.p) * np.log(variance) + np.linalg.slogdet(a)[1], beta, inverse, variance

    def best(self) -> float:
        """The ratio of the greatest likelihood: the best of a grid, then by golden sections between its neighbours; or 0."""
        grid = np.array([self.fit(r)[0] for r in RATIOS])
        at = int(grid.argmin())
        lo, hi = np.log(RATIOS[max(at - 1, 0)]), np.log(RATIOS[min(at + 1, len(RATIOS) - 1)])
        gold = (np.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
            lo, hi = (lo, b) if self.fit(np.exp(a))[0] < self.fit(np.exp(b))[0] else (a, hi)
        found = float(np.exp((lo + hi) / 2))
        return found if self.fit(found)[0] < self.fit(0.0)[0] - 1e-12 else 0.0


def mixed_effects(values: DataFrame, metadata: DataFrame, variables: list[str]) -> DataFrame:
    """(taxon, variable, samples, subjects, estimate, error, subject_share, t, p, q): restricted maximum likelihood.

    subject_share is the subjects' part of the unexplained variance. t has as many degrees of freedom as there are samples
    beyond the coefficients, and q is within the variable. Taxa with no more samples than coefficients, or whose variables
    don't vary by themselves, have no rows.
    """
    sums = mixed_sums(values, metadata, variables)
    kind = sums.schema["taxon"].dataType.simpleString()

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        out, own = [], _Profile(rows)
        scale = np.sqrt(np.maximum(np.diag(own.xx), 1e-300))
        if own.total > own.p and np.linalg.matrix_rank(own.xx / np.outer(scale, scale), tol=1e-9, hermitian=True) == own.p:
            ratio = own.best()
            _, beta, inverse, variance = own.fit(ratio)
            for k, name in enumerate(variables, 1):
                out.append((rows["taxon"].iloc[0], name, own.total, int(own.m.sum()), beta[k], float(np.sqrt(variance * inverse[k, k])), ratio / (1 + ratio), own.total - own.p))
        return pd.DataFrame(out, columns=["taxon", "variable", "samples", "subjects", "estimate", "error", "subject_share", "df"])

    schema = f"taxon {kind}, variable string, samples long, subjects long, estimate double, error double, subject_share double, df long"
    found = sums.groupBy("taxon").applyInPandas(fitted, schema).withColumn("t", F.try_divide("estimate", "error"))
    out = benjamini_hochberg(found.withColumn("p", t_p(F.col("t"), F.col("df"))), by=["variable"])
    return out.select("taxon", "variable", "samples", "subjects", "estimate", "error", "subject_share", "t", "p", "q")
