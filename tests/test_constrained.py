"""Constrained ordination against dense linear algebra."""

import numpy as np
import pytest

from quadrat.operators import constrained


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(9)
    env = rng.normal(size=(20, 3)) * [1, 5, 2]
    y = rng.poisson(np.exp(1 + env @ rng.normal(0, 0.3, (3, 30)) + rng.normal(0, 0.3, (20, 30)))) * (rng.random((20, 30)) < 0.7)
    counts = spark.createDataFrame([(f"s{i:02}", f"t{j}", int(y[i, j])) for i in range(20) for j in range(30)] + [("lost", "t1", 5)], "sample string, taxon string, reads long")
    rows = [(f"s{i:02}", *map(float, env[i]), 4.0) for i in range(20)] + [("lost", None, 1.0, 1.0, 4.0), ("empty", 1.0, 1.0, 1.0, 4.0)]
    return y, env, counts, spark.createDataFrame(rows, "sample string, a double, b double, c double, same double")


def dense(y, env):
    y = y[:, y.sum(axis=0) > 0]
    clr = np.log(y + 1.0)
    clr -= clr.mean(axis=1, keepdims=True)
    clr -= clr.mean(axis=0)
    x = env - env.mean(axis=0)
    q, _ = np.linalg.qr(x)
    fitted = q @ (q.T @ clr)
    u, s, _ = np.linalg.svd(fitted, full_matrices=False)
    return clr, x, u, s**2, (clr**2).sum()


def test_axes_equal_a_dense_ordination(drawn):
    y, env, counts, metadata = drawn
    _, x, u, size, total = dense(y, env)
    rows = constrained.constrained_axes(counts, metadata, ["a", "b", "same", "c"]).collect()
    sites = {(r["name"], r["axis"]): r for r in rows if r["kind"] == "site"}
    arrows = {(r["name"], r["axis"]): r["value"] for r in rows if r["kind"] == "variable"}
    assert len(sites) == 40 and len(arrows) == 6
    for a in (1, 2):
        mine = np.array([sites[f"s{i:02}", a]["value"] for i in range(20)])
        sign = np.sign(mine @ u[:, a - 1])
        assert np.allclose(mine, sign * u[:, a - 1], atol=1e-8)
        assert abs(sites["s00", a]["share"] - size[a - 1] / total) < 1e-9
        want = [np.corrcoef(x[:, k], mine)[0, 1] for k in range(3)]
        assert np.allclose([arrows[n, a] for n in "abc"], want, atol=1e-8) and max(want, key=abs) > 0


def test_ratio_and_permutations(drawn):
    y, env, counts, metadata = drawn
    clr, x, _, size, total = dense(y, env)
    row = constrained.constrained_test(counts, metadata, ["a", "b", "c"], permutations=99).first()
    e = size.sum()
    assert (row["samples"], row["df"], row["residual_df"]) == (20, 3, 16)
    assert np.allclose([row["explained"], row["residual"], row["f"]], [e, total - e, (e / 3) / ((total - e) / 16)])
    assert row["p"] == 0.01  # the variables do explain the counts
    rng = np.random.default_rng(1)
    noise = metadata.sparkSession.createDataFrame([(f"s{i:02}", float(rng.normal())) for i in range(20)], "sample string, v double")
    chance = constrained.constrained_test(counts, noise, ["v"], permutations=199).first()
    own = np.array([r["v"] for r in noise.orderBy("sample").collect()])
    own -= own.mean()
    ratio = lambda v: ((v @ clr) ** 2).sum() / (v @ v)
    share = np.mean([ratio(rng.permutation(own)) >= ratio(own) for _ in range(4000)])
    assert abs(chance["p"] - share) < 4 * np.sqrt(0.25 / 200)


def test_nothing_to_explain(drawn):
    _, _, counts, metadata = drawn
    assert constrained.constrained_test(counts, metadata, ["same"]).first()["f"] is None
    assert constrained.constrained_axes(counts.where("false"), metadata, ["a"]).count() == 0
    with pytest.raises(ValueError, match="variables"):
        constrained.constrained_axes(counts, metadata, ["a"] * 51)


def test_permutations_are_no_broadcast_and_give_dense_sums(drawn, monkeypatch):
    y, env, counts, metadata = drawn
    clr, x, _, _, _ = dense(y, env)
    monkeypatch.setattr(constrained, "CELLS", 400)  # blocks of samples, parts of the taxa
    c = constrained.Constrained(counts, metadata, ["a", "b", "c"])
    out = c.permuted(9, 1)
    samples = c.x.sparkSession.range(20).selectExpr("format_string('s%02d', id) AS sample")
    keys = {(r["r"], r["sample"]): r["h"] for r in samples.selectExpr("sample", "explode(sequence(1, 9)) AS r").selectExpr("r", "sample", "xxhash64(r, 1, sample) AS h").collect()}
    found = out.collect()
    assert len(found) == 9
    for r in found:
        order = sorted(range(20), key=lambda i: (keys[r["r"], f"s{i:02}"], i))
        moved = np.empty_like(x)
        moved[order] = x
        b = moved.T @ clr
        assert np.allclose([r["o0_0"], r["o0_1"], r["o1_2"]], [b[0] @ b[0], b[0] @ b[1], b[1] @ b[2]], atol=1e-8)
    # each broadcast is a short list (places, or numbers): none holds a row for each sample and permutation
    plan = c.permuted(999, 1)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert any("Window" in line for line in plan)
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = []
            for other in plan[k + 1 :]:
                if len(other) - len(other.lstrip(" :+-")) <= depth:
                    break
                below.append(other)
            assert not any("CartesianProduct" in z or "BroadcastNestedLoopJoin" in z or "Generate" in z for z in below)
