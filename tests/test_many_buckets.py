"""Operators on a global order of eight keys cut into 64 buckets and more equal a loop over the entities; their plans fit the driver."""
import numpy as np
import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

import statframe.plans.order as order
from statframe.operators import causal, linear, panel

KEYS = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for i in range(2000):
        x = float(rng.normal())
        out.append((i % 37, i // 300, i % 4, i % 11, i % 37, i, float(i), x, float(2 * x + rng.normal() + i % 5)))
    return out


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "g long, a long, b long, c long, d long, e long, f double, x double, y double")


def _series(rows):
    """x and y of each entity in the order of the keys."""
    got = {}
    for r in sorted(rows, key=lambda r: r[1:7]):
        got.setdefault(r[0], []).append(r[7:])
    return {g: np.array(v).T for g, v in got.items()}


def _buckets(monkeypatch, n):
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", 2000 / n)
    assert order.bucket_count(2000) == n


@pytest.mark.parametrize("buckets", [64, 80])
def test_first_difference(df, rows, monkeypatch, buckets):
    _buckets(monkeypatch, buckets)
    fit = panel.first_difference(df, "y", ["x"], "g", KEYS)
    dx, dy = (np.concatenate([np.diff(s[j]) for s in _series(rows).values()]) for j in (0, 1))
    assert fit.n == len(dx) and fit.beta[0] == pytest.approx(dx @ dy / (dx @ dx), rel=1e-10)


@pytest.mark.parametrize("buckets", [64, 80])
def test_block_ar_whatever_the_columns_are_called(df, rows, monkeypatch, buckets):
    """Names of the order plan's own columns stand in the rows: gls_block_ar calls its constant ``_c``."""
    _buckets(monkeypatch, buckets)
    fit = linear.gls_block_ar(df.withColumnsRenamed({"x": "_at", "y": "_low"}), "_low", ["_at"], "g", KEYS, [0.3])
    z = []
    for s in _series(rows).values():
        v = np.vstack([np.ones(s.shape[1]), s])
        z.append(np.hstack([np.sqrt(1 - 0.09) * v[:, :1], v[:, 1:] - 0.3 * v[:, :-1]]))
    c, x, y = np.hstack(z)
    np.testing.assert_allclose(fit.beta, np.linalg.lstsq(np.column_stack([c, x]), y, rcond=None)[0], rtol=1e-9)


def test_wooldridge(df, rows, monkeypatch):
    _buckets(monkeypatch, 80)
    got = panel.wooldridge_ac(df, "y", ["x"], "g", KEYS)
    d = {g: np.diff(s) for g, s in _series(rows).items()}
    dx, dy = np.hstack(list(d.values()))
    e = [v[1] - dx @ dy / (dx @ dx) * v[0] for v in d.values()]
    xy, xx = np.array([v[1:] @ v[:-1] for v in e]), np.array([v[:-1] @ v[:-1] for v in e])
    rho = xy.sum() / xx.sum()
    assert got["rho"] == pytest.approx(rho, rel=1e-9)
    assert got["f_stat"] == pytest.approx(((rho + .5) * xx.sum()) ** 2 / ((xy - rho * xx) ** 2).sum(), rel=1e-9)


def test_difference_gmm(df, rows, monkeypatch):
    _buckets(monkeypatch, 80)
    got = panel.difference_gmm(df, "y", ["x"], "g", KEYS)
    s = list(_series(rows).values())
    dy, dx, dly, l2y = (np.concatenate(v) for v in ([np.diff(y)[1:] for _, y in s], [np.diff(x)[1:] for x, _ in s], [np.diff(y)[:-1] for _, y in s], [y[:-2] for _, y in s]))
    one = np.ones(len(dy))
    want = np.linalg.solve(np.array([one, dx, l2y]) @ np.array([one, dx, dly]).T, np.array([one, dx, l2y]) @ dy)
    assert got["n_obs"] == len(dy)
    np.testing.assert_allclose(got["beta"], want, rtol=1e-8)


def test_matching_on_the_score(df, rows, monkeypatch):
    _buckets(monkeypatch, 80)
    scored = df.selectExpr("*", "cast(g % 3 = 0 as double) as t", "round(x, 1) as score")
    got = causal.psm_att(scored, "t", "y", [], KEYS, caliper=0.05, ps_col="score")
    key = lambda r: (round(r[7], 1), int(r[0] % 3 == 0), *r[1:7])
    found, last, back = {}, None, {}
    ordered = sorted(rows, key=key)
    for r in ordered:
        last = r if r[0] % 3 else last
        back[key(r)] = last
    last = None
    for r in reversed(ordered):
        last = r if r[0] % 3 else last
        if r[0] % 3 == 0:
            near = sorted((abs(key(c)[0] - key(r)[0]), i, c[8]) for i, c in enumerate((back[key(r)], last)) if c)
            found[key(r)] = (near[0][0], r[8] - near[0][2])
    gain = [g for d, g in found.values() if d <= 0.05]
    assert (got["matched"], got["unmatched"]) == (len(gain), len(found) - len(gain))
    assert got["att"] == pytest.approx(np.mean(gain), rel=1e-9) and got["se"] == pytest.approx(np.std(gain, ddof=1) / len(gain) ** .5, rel=1e-9)


@pytest.mark.parametrize("n", [5, 40, 90])
def test_search_equals_tuple_comparison(spark, n):
    """Ties, NaN, infinities and signed zeros in the first key; few cuts and more than are compared one by one."""
    rng = np.random.default_rng(n)
    draw = lambda m: list(zip(rng.choice([0.0, -0.0, 1.5, -2.0, np.inf, -np.inf, np.nan], m).tolist(), rng.choice(["", "a", "é", "zz"], m).tolist(), rng.integers(0, 9, m).tolist()))
    key = lambda t: (np.isnan(t[0]), 0.0 if np.isnan(t[0]) else t[0], t[1], t[2])
    cuts = sorted({key(t): t for t in draw(400)}.values(), key=key)[:n]
    assert len(cuts) == n
    rows = draw(600)
    df = spark.createDataFrame(rows, "k double, s string, t long").select("*", order._literal_search(
        [F.col("k"), F.col("s"), F.col("t")], ["k", "s", "t"], [T.DoubleType(), T.StringType(), T.LongType()], cuts).alias("b"))
    assert [r["b"] for r in df.collect()] == [sum(key(c) <= key(r) for c in cuts) for r in rows]
