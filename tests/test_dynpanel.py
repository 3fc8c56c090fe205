"""Difference GMM against a plain per-entity loop, and on simulated data."""
import numpy as np
import pytest

from statframe.operators.dynpanel import arellano_bond


def simulate(rng, n, t, a=0.5, b=1.0, holes=0.0):
    rows = []
    for i in range(n):
        eff, y = rng.normal(), rng.normal()
        for p in range(-10, t):
            x = rng.normal() + .5 * eff
            y = a * y + b * x + eff + rng.normal()
            if p >= 0 and rng.random() >= holes:
                rows.append((f"e{i}", 2000 + p, float(y), float(x)))
    return rows


def twin(rows, t, max_lag, collapse):
    """One- and two-step estimates with explicit Z matrices per entity."""
    ent = {}
    for e, p, y, x in rows:
        ent.setdefault(e, {})[p - 2000] = (y, x)
    cols = [(-1, g) for g in range(2, min(max_lag + 1, t - 1) + 1)] if collapse else [(p, g) for p in range(2, t) for g in range(2, min(p, max_lag + 1) + 1)]
    Zs, Xs, Ys, Ts = [], [], [], []
    for d in ent.values():
        z, x, y, ts = [], [], [], []
        for p in range(2, t):
            if all(q in d for q in (p, p - 1, p - 2)):
                row = [d[p - g][0] if (p - g) in d and p - g >= 0 and q in (-1, p) else 0.0 for q, g in cols]
                dx = d[p][1] - d[p - 1][1]
                z.append(row + [dx])
                x.append([d[p - 1][0] - d[p - 2][0], dx])
                y.append(d[p][0] - d[p - 1][0])
                ts.append(p)
        if z:
            Zs.append(np.array(z)); Xs.append(np.array(x)); Ys.append(np.array(y)); Ts.append(np.array(ts))
    ZX = sum(z.T @ x for z, x in zip(Zs, Xs))
    Zy = sum(z.T @ y for z, y in zip(Zs, Ys))
    H = lambda ts: 2.0 * np.eye(len(ts)) - (np.abs(ts[:, None] - ts[None, :]) == 1)
    A1 = sum(z.T @ H(ts) @ z for z, ts in zip(Zs, Ts))
    W1 = np.linalg.pinv(A1)
    M1 = np.linalg.inv(ZX.T @ W1 @ ZX)
    b1 = M1 @ ZX.T @ W1 @ Zy
    us = [y - x @ b1 for x, y in zip(Xs, Ys)]
    A2 = sum(np.outer(z.T @ u, z.T @ u) for z, u in zip(Zs, us))
    V1 = M1 @ ZX.T @ W1 @ A2 @ W1 @ ZX @ M1
    W2 = np.linalg.pinv(A2)
    M2 = np.linalg.inv(ZX.T @ W2 @ ZX)
    b2 = M2 @ ZX.T @ W2 @ Zy
    e2 = Zy - ZX @ b2
    D = np.zeros((2, 2))
    for j in range(2):
        dA = -sum(np.outer(z.T @ x[:, j], z.T @ u) + np.outer(z.T @ u, z.T @ x[:, j]) for z, x, u in zip(Zs, Xs, us))
        D[:, j] = -M2 @ ZX.T @ W2 @ dA @ W2 @ e2
    V2 = M2 + D @ M2 + M2 @ D.T + D @ V1 @ D.T
    n = sum(map(len, Ys))
    e1 = Zy - ZX @ b1
    out = {"b1": b1, "V1": V1, "b2": b2, "V2": V2, "hansen": e2 @ W2 @ e2, "sargan": e1 @ W1 @ e1 / (sum(u @ u for u in us) / (2 * (n - 2))), "n": n, "J": len(Zy)}
    for name, b, V, M, W in (("1", b1, V1, M1, W1), ("2", b2, V2, M2, W2)):
        us = [y - x @ b for x, y in zip(Xs, Ys)]
        for m in (1, 2):
            ws = [np.array([u[list(ts).index(p - m)] if p - m in ts else 0.0 for p in ts]) for u, ts in zip(us, Ts)]
            wu = [w @ u for w, u in zip(ws, us)]
            wx = sum(w @ x for w, x in zip(ws, Xs))
            zuw = sum((z.T @ u) * d for z, u, d in zip(Zs, us, wu))
            var = sum(d * d for d in wu) - 2 * wx @ M @ ZX.T @ W @ zuw + wx @ V @ wx
            out[f"ar{m}_{name}"] = sum(wu) / np.sqrt(var)
    return out


@pytest.mark.parametrize("max_lag,collapse", [(None, False), (2, False), (None, True)])
def test_equals_entity_loop(spark, max_lag, collapse):
    rows = simulate(np.random.default_rng(7), 80, 6, holes=.08)
    df = spark.createDataFrame(rows, "e string, p int, y double, x double").repartition(3)
    want = twin(rows, 6, max_lag or 6, collapse)
    one = arellano_bond(df, "y", ["x"], "e", "p", max_lag, collapse, steps=1)
    two = arellano_bond(df, "y", ["x"], "e", "p", max_lag, collapse)
    assert one.n == want["n"] and one.instruments == want["J"]
    np.testing.assert_allclose(one.beta, want["b1"], rtol=1e-8)
    np.testing.assert_allclose(one.cov, want["V1"], rtol=1e-7)
    np.testing.assert_allclose(two.beta, want["b2"], rtol=1e-8)
    np.testing.assert_allclose(two.cov, want["V2"], rtol=1e-6)
    assert one.tests["sargan"][0] == pytest.approx(want["sargan"], rel=1e-8)
    assert two.tests["hansen"][0] == pytest.approx(want["hansen"], rel=1e-8)
    for m in (1, 2):
        assert one.tests[f"ar{m}"][0] == pytest.approx(want[f"ar{m}_1"], rel=1e-7)
        assert two.tests[f"ar{m}"][0] == pytest.approx(want[f"ar{m}_2"], rel=1e-7)


def test_recovers_parameters_and_refuses_bad_panels(spark):
    rows = simulate(np.random.default_rng(1), 1500, 7)
    df = spark.createDataFrame(rows, "e string, p int, y double, x double")
    fit = arellano_bond(df, "y", ["x"], "e", "p")
    assert abs(fit.beta[0] - .5) < 4 * fit.se[0] < .2 and abs(fit.beta[1] - 1) < 4 * fit.se[1]
    assert fit.tests["ar1"][2] < .01 < fit.tests["ar2"][2] and fit.tests["hansen"][2] > .001
    with pytest.raises(ValueError, match="not unique"):
        arellano_bond(df.union(df.limit(1)), "y", ["x"], "e", "p")
    with pytest.raises(ValueError, match="periods"):
        arellano_bond(df.selectExpr("e", "p * 1000 as p", "y", "x"), "y", ["x"], "e", "p")
