"""Block-wise FFT autocovariances equal the plain sums at every lag and block size."""
import numpy as np
import pytest

from statframe.operators import linear as L
from statframe.operators import series as S
from statframe.plans.autocov import bartlett, lag_products, weighted_products
from statframe.plans.order import GlobalOrder


def brute(x, lags):
    n = len(x)
    return np.array([x[:n - k].T @ x[k:] if k < n else np.zeros((x.shape[1],) * 2) for k in range(lags + 1)])


@pytest.mark.parametrize("lags,block", [(0, 16), (3, 16), (16, 16), (17, 16), (31, 16), (60, 16), (250, 7), (7, 512), (400, 64)])
def test_products_at_any_lag_and_block(spark, lags, block):
    rng = np.random.default_rng(lags + block)
    x = rng.normal(size=(301, 2)).cumsum(axis=0)
    df = spark.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(x)], "_idx long, a double, b double").repartition(3)
    want = brute(x, lags)
    scale = np.abs(want).max()
    np.testing.assert_allclose(lag_products(df, ["a", "b"], lags, block), want, atol=1e-10 * scale)
    w = bartlett(lags)
    total = w[0] * want[0] + sum(w[k] * (want[k] + want[k].T) for k in range(1, lags + 1))
    np.testing.assert_allclose(weighted_products(df, ["a", "b"], w, block), total, atol=1e-9 * scale)


def test_series_tests_with_thousands_of_lags(spark):
    rng = np.random.default_rng(8)
    n, lags = 6000, 2000
    x = np.convolve(rng.normal(size=n + 5), np.ones(6) / 6, "valid")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(n, None)], "t int, v double")
    e = x - x.mean()
    g = brute(e[:, None], lags)[:, 0, 0]
    lrv = (g[0] + 2 * (bartlett(lags)[1:] @ g[1:])) / n
    got = S.kpss(df, "v", ["t"], lags=lags)
    assert got["kpss_stat"] == pytest.approx((e.cumsum() ** 2).sum() / (n * n * lrv), rel=1e-9) and got["n_obs"] == n
    np.testing.assert_allclose(S.acf(df, "v", ["t"], lags=lags), g / g[0], atol=1e-12)
    with pytest.raises(ValueError, match="duplicate"):
        S.kpss(df.union(df), "v", ["t"])


def test_hac_covariance_at_a_wide_bandwidth(spark):
    rng = np.random.default_rng(4)
    n, lags = 900, 120
    x = rng.normal(size=n).cumsum()
    y = 2 + 0.5 * x + rng.normal(size=n).cumsum() * .3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t int, x double, y double")
    fit = L.ols(df, "y", ["x"], se_type="HAC", order_by=["t"], maxlags=lags)
    X = np.column_stack([np.ones(n), x])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    u = X * (y - X @ b)[:, None]
    G, w, A = brute(u, lags), bartlett(lags), np.linalg.inv(X.T @ X)
    want = A @ (G[0] + sum(w[k] * (G[k] + G[k].T) for k in range(1, lags + 1))) @ A
    np.testing.assert_allclose(fit.cov, want, rtol=1e-6)


def test_large_indices_keep_their_blocks(spark):
    order = GlobalOrder(spark.range(2000).selectExpr("id", "double(id % 13) as v"), ["id"], n_buckets=5).with_running_sums([])
    x = (np.arange(2000) % 13).astype(float)[:, None]
    np.testing.assert_allclose(lag_products(order, ["v"], 40, 128), brute(x, 40), rtol=1e-12)
