"""Zero-inflated models and the two-step selection model against plain numpy likelihoods and scores."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statframe.operators import discrete as D
from statframe.operators.zeroinfl import digamma_col, trigamma_col, zero_inflated


def llf(theta, y, x, nb):
    g, b = theta[:2], theta[2:4]
    X = np.column_stack([np.ones(len(x)), x])
    p, mu = 1 / (1 + np.exp(-X @ g)), np.exp(X @ b)
    lg = np.vectorize(math.lgamma)
    if nb:
        r = math.exp(-theta[4])
        lf = lg(y + r) - math.lgamma(r) - lg(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))
    else:
        lf = y * np.log(mu) - mu - lg(y + 1)
    return np.where(y == 0, np.log(p + (1 - p) * np.exp(lf)), np.log1p(-p) + lf).sum()


def derivatives(f, t, h=1e-4):
    k = len(t)
    e = np.eye(k) * h
    g = np.array([(f(t + e[i]) - f(t - e[i])) / (2 * h) for i in range(k)])
    H = np.array([[(f(t + e[i] + e[j]) - f(t + e[i] - e[j]) - f(t - e[i] + e[j]) + f(t - e[i] - e[j])) / (4 * h * h) for j in range(k)] for i in range(k)])
    return g, H


@pytest.mark.parametrize("family", ["poisson", "negbin"])
def test_zero_inflated_optimum_and_information(spark, family):
    rng = np.random.default_rng(12)
    n = 3000
    x = rng.normal(size=n)
    mu = np.exp(1 + .5 * x) * (rng.gamma(2, .5, size=n) if family == "negbin" else 1)
    y = np.where(rng.random(n) < 1 / (1 + np.exp(.8 - .6 * x)), 0, rng.poisson(mu)).astype(float)
    df = spark.createDataFrame(list(zip(y.tolist(), x.tolist())) + [(None, 1.0)], "y double, x double")
    fit = zero_inflated(df, "y", ["x"], ["x"], family)
    assert fit.converged and fit.n == n and fit.terms[:4] == ["inflate:const", "inflate:x", "count:const", "count:x"]
    f = lambda t: llf(t, y, x, family == "negbin")
    assert fit.llf == pytest.approx(f(fit.theta), rel=1e-10) and fit.llf > fit.llnull
    g, H = derivatives(f, fit.theta)
    np.testing.assert_allclose(g, 0, atol=2e-3)
    np.testing.assert_allclose(fit.cov, np.linalg.inv(-H), rtol=2e-3, atol=1e-6)
    truth = [-.8, .6, 1, .5] + ([math.log(.5)] if family == "negbin" else [])
    assert np.all(np.abs(fit.theta - truth) < 4.5 * fit.se)


def test_gamma_derivatives(spark):
    z = [0.05, 0.5, 1.0, 2.5, 10.0, 300.0]
    r = spark.createDataFrame([(v,) for v in z], "z double").select("z", digamma_col(F.col("z")).alias("d"), trigamma_col(F.col("z")).alias("t")).collect()
    for row in r:
        v = row["z"]
        # sums up to a large shift, then the leading terms of the series
        d = math.log(v + 5000) - .5 / (v + 5000) - 1 / (12 * (v + 5000) ** 2) - sum(1 / (v + k) for k in range(5000))
        t = 1 / (v + 5000) + .5 / (v + 5000) ** 2 + 1 / (6 * (v + 5000) ** 3) + sum(1 / (v + k) ** 2 for k in range(5000))
        assert row["d"] == pytest.approx(d, abs=1e-9) and row["t"] == pytest.approx(t, rel=1e-9)


def test_two_step_covariance_is_the_stacked_sandwich(spark):
    rng = np.random.default_rng(3)
    n = 1500
    w, x = rng.normal(size=n), rng.normal(size=n)
    u = rng.normal(size=n)
    s = (.3 + .8 * w + u > 0).astype(float)
    y = 1 + 2 * x + .7 * u + rng.normal(size=n)
    df = spark.createDataFrame([(float(a) if c else None, float(b), float(c), float(d)) for a, b, c, d in zip(y, x, s, w)], "y double, x double, s double, w double")
    r = D.heckman(df, "y", ["x"], "s", ["w"])
    pdf = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda z: .5 * math.erfc(-z / math.sqrt(2)))
    W = np.column_stack([np.ones(n), w])

    def psi(theta):
        g, b = theta[:2], theta[2:]
        z = W @ g
        lam = pdf(z) / cdf(z)
        score = np.where(s > 0, lam, -pdf(z) / cdf(-z))
        X = np.column_stack([np.ones(n), x, lam])
        return np.column_stack([W * score[:, None], X * (s * (np.where(s > 0, y, 0) - X @ b))[:, None]])

    theta = np.r_[r["selection"].theta, r["outcome"].beta]
    p = psi(theta)
    np.testing.assert_allclose(p.sum(axis=0), 0, atol=1e-6)
    h = 1e-5
    A = -np.column_stack([(psi(theta + e).sum(axis=0) - psi(theta - e).sum(axis=0)) / (2 * h) for e in np.eye(5) * h])
    V = np.linalg.inv(A) @ (p.T @ p) @ np.linalg.inv(A).T
    # the selection block uses expected information, which differs from the observed one by sampling error
    np.testing.assert_allclose(np.sqrt(np.diag(r["outcome"].cov)), np.sqrt(np.diag(V)[2:]), rtol=.01)
    assert r["sigma"] > 0 and abs(r["rho"]) <= 1.2
