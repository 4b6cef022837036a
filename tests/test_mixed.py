"""Mixed models against a dense restricted likelihood."""

import numpy as np
import pytest

from quadrat.operators import mixed
from quadrat.session import ship


def dense(y, x, subject):
    """The best of a fine grid of variance ratios, with the whole covariance matrix."""
    same = (subject[:, None] == subject[None, :]).astype(float)
    best = None
    for ratio in [0.0, *np.exp(np.linspace(-9, 6, 3001))]:
        v = np.eye(len(y)) + ratio * same
        inverse = np.linalg.inv(v)
        a = x.T @ inverse @ x
        beta = np.linalg.solve(a, x.T @ inverse @ y)
        rest = y - x @ beta
        s2 = rest @ inverse @ rest / (len(y) - x.shape[1])
        value = np.linalg.slogdet(v)[1] + (len(y) - x.shape[1]) * np.log(s2) + np.linalg.slogdet(a)[1]
        if best is None or value < best[0]:
            best = value, ratio, beta, np.sqrt(np.diag(np.linalg.inv(a)) * s2)
    return best


@pytest.fixture(scope="module")
def drawn(spark):
    ship(spark)
    rng = np.random.default_rng(12)
    subject = np.repeat(np.arange(12), [1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 7])
    n = len(subject)
    env = np.stack([rng.normal(size=n), rng.normal(size=n) * 3 + subject * 0.1], axis=1)
    level = {"strong": 2.0, "weak": 0.4, "none": 0.0}
    y = {t: 1 + env @ [0.8, 0.0] + s * rng.normal(size=12)[subject] + rng.normal(size=n) * 0.5 for t, s in level.items()}
    rows = [(f"s{i:02}", t, float(v[i])) for t, v in y.items() for i in range(n) if not (t == "weak" and i % 7 == 3)]
    values = spark.createDataFrame([*rows, ("s00", "lone", 1.0), ("s01", "lone", None), ("lost", "strong", 9.0)], "sample string, taxon string, value double")
    meta = spark.createDataFrame([(f"s{i:02}", None if i == 0 else f"p{subject[i]}", *map(float, env[i])) for i in range(n)] + [("lost", "p1", None, 1.0)], "sample string, subject string, a double, b double")
    return y, env, subject, values, meta


def test_effects_equal_a_dense_fit(drawn):
    y, env, subject, values, meta = drawn
    got = {(r["taxon"], r["variable"]): r for r in mixed.mixed_effects(values, meta, ["a", "b"]).collect()}
    assert set(got) == {(t, v) for t in y for v in "ab"}
    for t in y:
        keep = np.array([not (t == "weak" and i % 7 == 3) for i in range(len(subject))])
        x = np.column_stack([np.ones(len(subject)), env])[keep]
        _, ratio, beta, error = dense(y[t][keep], x, subject[keep])
        for k, v in enumerate("ab", 1):
            r = got[t, v]
            assert abs(r["estimate"] - beta[k]) < 1e-3 and abs(r["error"] - error[k]) < 1e-3 and abs(r["subject_share"] - ratio / (1 + ratio)) < 2e-3
            assert (r["samples"], r["subjects"]) == (keep.sum(), len(set(subject[keep])))
    assert all(got[t, "a"]["q"] < 0.01 for t in y)


def test_one_sample_a_subject_is_a_plain_regression(spark, drawn):
    y, env, _, values, meta = drawn
    out = {r["taxon"]: r for r in mixed.mixed_effects(values.where("taxon = 'none'"), meta.drop("subject").selectExpr("*", "CAST(NULL AS STRING) AS subject"), ["a"]).collect()}
    x = np.column_stack([np.ones(len(env)), env[:, 0]])
    beta = np.linalg.lstsq(x, y["none"], rcond=None)[0]
    assert abs(out["none"]["estimate"] - beta[1]) < 1e-8


def test_a_variable_that_does_not_vary(drawn):
    _, _, _, values, meta = drawn
    assert mixed.mixed_effects(values, meta.selectExpr("*", "1D AS same"), ["same"]).count() == 0
    assert mixed.mixed_effects(values.where("false"), meta, ["a"]).count() == 0
