"""Exact conditional likelihood: subset enumeration, integer polynomials, split strata."""
import itertools
import math

import numpy as np
import pytest

from statframe.operators import condlogit as C
from statframe.operators import discrete as D


def enumerate_strata(strata, beta):
    """(llf, score, Hessian) by summing over all subsets of each stratum's size of cases."""
    k = len(beta)
    l, g, h = 0.0, np.zeros(k), np.zeros((k, k))
    for y, x in strata:
        m = int(y.sum())
        if m in (0, len(y)):
            continue
        sums = np.array([x[list(c)].sum(axis=0) for c in itertools.combinations(range(len(y)), m)])
        w = np.exp(sums @ beta)
        e1 = w @ sums / w.sum()
        l += x[y > 0].sum(axis=0) @ beta - math.log(w.sum())
        g += x[y > 0].sum(axis=0) - e1
        h -= (sums * w[:, None]).T @ sums / w.sum() - np.outer(e1, e1)
    return l, g, h


def newton(strata, k):
    b = np.zeros(k)
    for _ in range(30):
        _, g, h = enumerate_strata(strata, b)
        b = b + np.linalg.solve(-h, g)
    return b, np.linalg.inv(-enumerate_strata(strata, b)[2])


def draw(rng, sizes, beta):
    out = []
    for n in sizes:
        x = rng.normal(size=(n, len(beta))) + rng.normal()
        y = (rng.random(n) < 1 / (1 + np.exp(-(x @ beta - 1)))).astype(float)
        out.append((y, x))
    return out


def frame(spark, strata):
    rows = [(f"s{s}", float(a), *map(float, v)) for s, (y, x) in enumerate(strata) for a, v in zip(y, x)]
    return spark.createDataFrame(rows, "s string, y double, " + ", ".join(f"x{j} double" for j in range(strata[0][1].shape[1])))


def test_equals_subset_enumeration(spark):
    rng = np.random.default_rng(11)
    strata = draw(rng, rng.integers(1, 11, 60), np.array([.7, -.4]))
    df = frame(spark, strata).repartition(3)
    layout = C.ExactLayout(df, "y", ["x0", "x1"], "s")
    for beta in (np.zeros(2), np.array([.5, -1.0])):
        l, g, h, n = layout.evaluate(beta)
        want = enumerate_strata(strata, beta)
        assert l == pytest.approx(want[0], rel=1e-11) and n == sum(0 < y.sum() < len(y) for y, _ in strata)
        np.testing.assert_allclose(g, want[1], atol=1e-10)
        np.testing.assert_allclose(h, want[2], atol=1e-9)
    layout.close()
    fit = D.clogit(df, "y", ["x0", "x1"], "s")
    theta, cov = newton(strata, 2)
    assert fit.converged
    np.testing.assert_allclose(fit.theta, theta, rtol=1e-7)
    np.testing.assert_allclose(fit.cov, cov, rtol=1e-6)


def test_split_stratum_gives_the_same(spark):
    """Strata of several blocks, whole in one task or dealt in parts over many tasks."""
    rng = np.random.default_rng(3)
    strata = draw(rng, [700, 5, 300, 65, 9, 128, 1], np.array([.8, -.3])) + [(np.ones(90), rng.normal(size=(90, 2)))]
    df = frame(spark, strata).repartition(4)
    whole = C.fit_exact(df, "y", ["x0", "x1"], "s")
    split = C.fit_exact(df, "y", ["x0", "x1"], "s", heavy_strata=10 ** 6, part_rows=50)
    for key in ("theta", "cov"):
        np.testing.assert_allclose(split[key], whole[key], rtol=1e-7)
    assert split["llf"] == pytest.approx(whole["llf"], rel=1e-10) and split["strata"] == whole["strata"] >= 5


def test_large_stratum_equals_integer_polynomial():
    """exp(x'b) = 2 or 1: e_m is a sum of binomial products, exact in integers."""
    n, n1, m = 2000, 700, 900
    x = np.r_[np.ones(n1), np.zeros(n - n1)][:, None]
    y = np.zeros(n)
    y[:m] = 1
    beta = np.array([math.log(2.0)])
    w = [math.comb(n1, u) * math.comb(n - n1, m - u) * 2 ** u for u in range(n1 + 1) if 0 <= m - u <= n - n1]
    u = [u for u in range(n1 + 1) if 0 <= m - u <= n - n1]
    total = sum(w)
    e1 = sum(a * b for a, b in zip(u, w)) / total
    e2 = sum(a * a * b for a, b in zip(u, w)) / total
    got = C.strata_sums(y, x, np.array([n]), beta)
    log_total = math.log(total >> 1500) + 1500 * math.log(2)
    assert got[1] == pytest.approx(min(m, n1) * beta[0] - log_total, rel=1e-11)
    assert got[2] == pytest.approx(min(m, n1) - e1, abs=1e-7)
    assert got[3] == pytest.approx(-(e2 - e1 * e1), rel=1e-7)


def test_one_case_is_breslow_and_no_contrast_is_refused(spark):
    rng = np.random.default_rng(5)
    strata = []
    for _ in range(150):
        n = int(rng.integers(2, 6))
        y = np.zeros(n)
        y[rng.integers(n)] = 1
        strata.append((y, rng.normal(size=(n, 1)) + y[:, None]))
    df = frame(spark, strata)
    a, b = D.clogit(df, "y", ["x0"], "s"), D.clogit_breslow(df, "y", ["x0"], "s")
    np.testing.assert_allclose([a.theta[0], a.cov[0, 0], a.llf], [b.theta[0], b.cov[0, 0], b.llf], rtol=1e-7)
    with pytest.raises(ValueError, match="cases and controls"):
        D.clogit(df.where("y = 1"), "y", ["x0"], "s")
