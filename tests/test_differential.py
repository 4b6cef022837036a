"""Models of differential abundance against plain fits and planted differences."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import differential
from quadrat.session import ship


@pytest.fixture(scope="module")
def drawn(spark):
    """60 taxa in 24 samples of three groups; the first eight taxa are eight times as common in group b."""
    ship(spark)
    rng = np.random.default_rng(5)
    groups = np.array(["a", "b", "c"] * 8)
    depth = np.exp(rng.normal(0, 0.5, 24))
    level = np.exp(rng.uniform(1.5, 6, 60))
    mean = level[:, None] * depth * np.where((np.arange(60) < 8)[:, None] & (groups == "b"), 8.0, 1.0)
    y = rng.poisson(mean * rng.gamma(1 / 0.1, 0.1, mean.shape))
    counts = spark.createDataFrame([(f"s{j:02}", f"t{i:02}", int(y[i, j])) for i in range(60) for j in range(24)] + [("s00", "rare", 5), ("none", "t01", 9)], "sample string, taxon string, reads long")
    table = spark.createDataFrame([(f"s{j:02}", groups[j]) for j in range(24)] + [("s00", "a"), ("none", None)], "sample string, grp string")
    return y, groups, counts, table


def factors_by_hand(y):
    y = np.concatenate([y, [[5] + [0] * (y.shape[1] - 1)]]).astype(float)
    logs = np.where(y > 0, np.log(np.maximum(y, 1)), 0)
    level = logs.sum(axis=1) / y.shape[1]
    f = np.array([np.median((logs[:, j] - level)[y[:, j] > 0]) for j in range(y.shape[1])])
    return np.exp(f - f.mean())


def test_size_factors_and_moments(drawn):
    y, groups, counts, table = drawn
    f = factors_by_hand(y)
    got = {r["sample"]: r["factor"] for r in differential.size_factors(counts.where("sample <> 'none'")).collect()}
    assert np.allclose([got[f"s{j:02}"] for j in range(24)], f)
    k = y / f
    mean, inner = k.mean(axis=1), sum(((k[:, groups == g] - k[:, groups == g].mean(axis=1, keepdims=True)) ** 2).sum(axis=1) for g in "abc") / 21
    want = np.clip((inner - (1 / f).mean() * mean) / mean**2, 1e-8, 100)
    rows = {r["taxon"]: r for r in differential.nb_moments(counts, table).collect()}
    assert "rare" not in rows and len(rows) == (np.count_nonzero(y, axis=1) >= 2.4).sum()
    for t, r in rows.items():
        i = int(t[1:])
        assert abs(r["base_mean"] - mean[i]) < 1e-9 * mean[i] and abs(r["dispersion"] - want[i]) < 1e-9 and r["df"] == 21


def test_means_equal_a_plain_fit(spark, drawn):
    """Scoring in Spark's expressions against bisection of the score of each taxon and group."""
    y, groups, counts, table = drawn
    f = factors_by_hand(y)
    grid = differential._grid(counts, table, differential.size_factors(differential._grouped(counts, table)), 0.1)
    alpha = spark.createDataFrame([(f"t{i:02}", 0.01 * (i + 1)) for i in range(60)], "taxon string, final double")
    for r in differential.nb_means(grid, alpha).collect():
        i, own = int(r["taxon"][1:]), groups == r["grp"]
        a, s, v = 0.01 * (i + 1), f[own], y[i, own]
        if not v.sum():
            continue
        lo, hi = -20.0, 20.0
        for _ in range(200):
            mid = (lo + hi) / 2
            m = s * math.exp(mid)
            lo, hi = (mid, hi) if ((v - m) / (1 + a * m)).sum() > 0 else (lo, mid)
        m = s * math.exp(lo)
        assert abs(r["log_mean"] - lo) < 1e-6 and abs(r["information"] - (m / (1 + a * m)).sum()) < 1e-4 * r["information"] and r["n"] == own.sum()


def test_trend_and_shrinkage(spark):
    rng = np.random.default_rng(2)
    mean = np.exp(rng.uniform(1, 8, 4000))
    noisy = (3.0 / mean + 0.2) * rng.chisquare(20, 4000) / 20
    moments = spark.createDataFrame([(f"t{i}", float(m), 20, float(d)) for i, (m, d) in enumerate(zip(mean, noisy))] + [("odd", 100.0, 20, 50.0), ("flat", 100.0, 20, 1e-8)], "taxon string, base_mean double, df long, dispersion double")
    a, b = differential.dispersion_trend(moments)
    assert abs(a - 3.0) < 0.4 and abs(b - 0.2) < 0.02
    out = {r["taxon"]: r for r in differential.shrunk_dispersions(moments).collect()}
    assert out["odd"]["final"] == 50.0 and out["flat"]["final"] > 1e-8
    off = lambda c: np.std([math.log(out[f"t{i}"][c] / out[f"t{i}"]["trend"]) for i in range(4000) if out[f"t{i}"]["final"] != out[f"t{i}"]["dispersion"]])
    assert off("final") < 0.85 * off("dispersion")
    assert differential.dispersion_trend(moments.where("false")) == (0.0, 1e-8)


def test_planted_taxa_are_found(drawn):
    _, _, counts, table = drawn
    rows = {(r["taxon"], r["grp"]): r for r in differential.nb_wald(counts, table, "a").collect()}
    found = {k for k, r in rows.items() if r["q"] < 0.05}
    planted = {(f"t{i:02}", "b") for i in range(8)}
    assert planted <= found and len(found - planted) <= 4
    assert all(abs(rows[k]["log2_change"] - 3) < 1.2 for k in planted)


def test_planted_bias_is_recovered(spark):
    """Group b is sequenced e times as deep; a fifth of the taxa differ in truth."""
    ship(spark)
    rng = np.random.default_rng(7)
    change = np.where(np.arange(200) < 40, rng.choice([-2.0, 2.0], 200), 0.0)
    rows = [(f"{g}{j}", f"t{i}", int(math.exp(6 + rng.normal(0, 0.4) + (change[i] + 1.0) * (g == "b")))) for i in range(200) for g in "ab" for j in range(8)]
    counts = spark.createDataFrame(rows, "sample string, taxon string, reads long")
    table = spark.createDataFrame([(f"{g}{j}", g) for g in "ab" for j in range(8)], "sample string, grp string")
    bias = differential.sampling_bias(differential.log_differences(counts, table, "a"))
    assert bias.keys() == {"b"} and abs(bias["b"] - 1.0) < 0.1
    out = {int(r["taxon"][1:]): r for r in differential.bias_corrected_tests(counts, table, "a").collect()}
    assert len(out) == 200 and sum(out[i]["q"] < 0.05 for i in range(40)) >= 38 and sum(out[i]["q"] < 0.05 for i in range(40, 200)) <= 12


def test_empty_tables(spark):
    counts = spark.createDataFrame([], "sample string, taxon string, reads long")
    table = spark.createDataFrame([], "sample string, grp string")
    assert differential.nb_wald(counts, table, "a").count() == 0
    assert differential.bias_corrected_tests(counts, table, "a").count() == 0
    assert differential.size_factors(counts).count() == 0
