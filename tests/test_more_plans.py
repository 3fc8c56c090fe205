"""Radix selection, fold-batched CV, roll-ups, block AR whitening and the one-scan report."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from statframe.operators import diagnostics as G
from statframe.operators import discrete as D
from statframe.operators import features as X
from statframe.operators import linear as L
from statframe.operators.evaluate import auc
from statframe.operators.foldcv import cross_validate_discrete
from statframe.plans.selection import exact_quantiles, from_order_bits, order_bits, order_statistics
from statframe.sources.scan import load
from tests.conftest import SF_SMALL


def test_order_bits_sort_as_the_numbers():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e9, np.inf])
    u = order_bits(x)
    assert (np.diff(u.astype(object)) > 0).all() and order_bits(np.array([-0.0]))[0] == u[4]
    assert [from_order_bits(int(v)) for v in u] == x.tolist()


def test_quantiles_of_many_columns_are_exact(spark):
    rng = np.random.default_rng(9)
    n = 3001
    cols = {"normal": rng.normal(size=n) * 1e6, "tied": rng.integers(-3, 4, n).astype(float), "tiny": rng.random(n) * 1e-300, "one": np.full(n, -7.25),
            "near": 1 + np.arange(n) * 2.0 ** -52}
    rows = [tuple(float(c[i]) for c in cols.values()) for i in range(n)] + [(None,) * 5, (float("nan"),) * 5]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    probs = [0, .001, .1, .5, .77, 1]
    got = exact_quantiles(df, list(cols), probs)
    for c, x in cols.items():
        np.testing.assert_array_equal(order_statistics(df, [c], {c: [0, 1, n // 2, n - 1]})[c][n // 2], np.sort(x)[n // 2])
        np.testing.assert_allclose(got[c], np.quantile(x, probs), rtol=1e-15)
    empty = exact_quantiles(df.limit(0), ["normal"], [.5])["normal"]
    assert np.isnan(empty[0]) and order_statistics(df, ["one"], {"one": [n + 5]})["one"] == {}


@pytest.mark.parametrize("family", ["logit", "mnlogit", "ordered"])
def test_folds_fitted_together_equal_single_fits(spark, family):
    rng = np.random.default_rng(2)
    n = 600
    x = rng.normal(size=(n, 2))
    z = x @ [.8, -.5] + rng.logistic(size=n)
    y = np.digitize(z, [0] if family == "logit" else [-1, .7])
    df = spark.createDataFrame([(int(c), int(i % 4), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))], "y int, f int, a double, b double")
    res = cross_validate_discrete(df, "y", ["a", "b"], F.col("f"), family)
    assert [r["fold"] for r in res] == [0, 1, 2, 3] and all(r["converged"] for r in res)
    fit = {"logit": D.logit, "mnlogit": D.mnlogit, "ordered": D.ordered}[family]
    for r in res:
        m = fit(df.where(F.col("f") != r["fold"]), "y", ["a", "b"])
        test = df.where(F.col("f") == r["fold"])
        p = D.class_probabilities(m) if family != "logit" else F.array(1 - D.probability(m), D.probability(m))
        own = test.select(F.get(p, F.col("y")).alias("p")).agg(F.avg(-F.log("p"))).first()[0]
        assert r["log_loss"] == pytest.approx(own, rel=1e-6) and r["n"] == test.count()


def test_many_folds_and_bad_targets(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"c{int(rng.random() < .4)}", i, float(rng.normal())) for i in range(120)], "y string, f int, a double")
    res = cross_validate_discrete(df, "y", ["a"], F.col("f"), "logit")  # a fold per row
    assert len(res) == 120 and all(r["n"] == 1 for r in res)
    with pytest.raises(ValueError, match="two classes"):
        cross_validate_discrete(df.where("y = 'c0'"), "y", ["a"], F.col("f"))
    with pytest.raises(ValueError, match="two folds"):
        cross_validate_discrete(df, "y", ["a"], F.lit(1))


def test_rollup_equals_separate_fits(spark):
    li = load(spark, SF_SMALL, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    got = {tuple(r[:4]): r["coefficient"] for r in L.segmented_ols_sets(li, "l_extendedprice", ["l_quantity"], keys,
                                                                         [keys, ["l_linestatus"], []]).collect()}
    for by, level in ((keys, 0), (["l_linestatus"], 2)):
        for r in L.segmented_ols(li, "l_extendedprice", ["l_quantity"], by).collect():
            key = (r["l_returnflag"] if "l_returnflag" in by else None, r["l_linestatus"], level, r["term"])
            assert got.pop(key) == pytest.approx(r["coefficient"], rel=1e-5)
    assert set(got) == {(None, None, 3, "const"), (None, None, 3, "l_quantity")}
    assert got[(None, None, 3, "l_quantity")] == pytest.approx(L.ols(li, "l_extendedprice", ["l_quantity"]).beta[1], rel=1e-5)


@pytest.mark.parametrize("phi", [[], [.6], [.5, -.3], [.4, .2, .1]])
def test_block_ar_whitening_equals_dense_gls(spark, phi):
    rng = np.random.default_rng(len(phi))
    p, rows, blocks = len(phi), [], []
    for g, n in enumerate([1, 2, 3, 17, 40]):
        x, y = rng.normal(size=n), rng.normal(size=n)
        rows += [(f"g{g}", t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))]
        # covariance from a long moving-average expansion of the process
        psi = np.zeros(4000)
        psi[0] = 1
        for i in range(1, 4000):
            psi[i] = sum(f * psi[i - j] for j, f in enumerate(phi, 1) if i >= j)
        gamma = np.array([psi[:4000 - k] @ psi[k:] for k in range(n)])
        blocks.append((np.column_stack([np.ones(n), x]), y, np.linalg.inv(gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))])))
    fit = L.gls_block_ar(spark.createDataFrame(rows, "g string, t int, x double, y double"), "y", ["x"], "g", ["t"], phi)
    A = sum(X_.T @ W @ X_ for X_, _, W in blocks)
    beta = np.linalg.solve(A, sum(X_.T @ W @ y for X_, y, W in blocks))
    ssr = sum((y - X_ @ beta) @ W @ (y - X_ @ beta) for X_, y, W in blocks)
    np.testing.assert_allclose(fit.beta, beta, rtol=1e-8)
    np.testing.assert_allclose(fit.cov, np.linalg.inv(A) * ssr / (63 - 2), rtol=1e-8)
    with pytest.raises(ValueError, match="stationary"):
        L.ar_whitening([1.1])


def test_one_scan_report_equals_the_single_tests(spark):
    ev = load(spark, SF_SMALL, "events").withColumn("h", F.hour("ts").cast("double"))
    fit = L.ols(ev, "value", ["user_id", "h"])
    order = ["ts", "event_id"]
    got = {r["test"]: r for r in G.validate_assumptions(spark, ev, fit, order).collect()}
    single = [G.breusch_pagan(ev, fit), G.white(ev, fit), G.jarque_bera(ev, fit), G.reset(ev, fit), G.durbin_watson(ev, fit, order),
              G.breusch_godfrey(ev, fit, order)]
    for t in single:
        assert got[t[0]]["statistic"] == pytest.approx(t[1], rel=2e-6) and got[t[0]]["flag"] == t[4]
    assert 0 < got["shapiro_wilk"]["statistic"] <= 1
    n = sum(not k.startswith("summary") for k in got)
    assert got["summary:n_tests"]["statistic"] == n == len(single) + 3
    assert got["summary:n_pass"]["statistic"] + got["summary:n_warn"]["statistic"] + got["summary:n_fail"]["statistic"] <= n


def test_strata_without_sample_and_one_class_auc(spark):
    pop = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "s string")
    got = {r["s"]: (r["n_sample"], r["n_pop"], r["weight"]) for r in X.strata_weights(spark.createDataFrame([("a",), ("d",)], "s string"), pop, "s").collect()}
    assert got == {"a": (1, 2, 2.0), "b": (0, 1, None), "c": (0, 1, None), "d": (1, 0, None)}
    assert np.isnan(auc(spark.createDataFrame([(1.0, .2), (1.0, .4)], "y double, p double"), "y", "p"))


def test_two_way_effects_of_many_periods(spark, monkeypatch):
    """Conjugate gradients over period vectors give what the period matrix gives, unconnected blocks included."""
    from statframe.operators import panel as P
    rng = np.random.default_rng(3)
    rows = []
    for e in range(40):
        for t in rng.choice(12, rng.integers(2, 8), replace=False):
            x = rng.normal() + .1 * t
            rows.append((e, int(t) + (100 if e >= 30 else 0), float(x), float(1.5 * x + e * .2 + t * .3 + rng.normal())))
    df = spark.createDataFrame(rows, "e int, t int, x double, y double")
    want = P.within(df, "y", ["x"], "e", "t")
    monkeypatch.setattr(P, "MAX_PERIODS", 3)
    got = P.within(df, "y", ["x"], "e", "t")
    np.testing.assert_allclose(got.beta, want.beta, rtol=1e-8)
    np.testing.assert_allclose(got.cov, want.cov, rtol=1e-7)
    assert got.df_resid == want.df_resid and got.groups == want.groups


def test_curves_without_row_multiplication(spark):
    """Partial dependence and ordered curves from one aggregate equal scoring every row at every point."""
    from statframe.operators import interpret as I
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    z = x @ [.8, -.5] + rng.logistic(size=300)
    rows = [(float(a), float(b), float(v > 0), int(np.digitize(v, [-1, 1])), float(t)) for (a, b), v, t in zip(x, z, rng.random(300))]
    df = spark.createDataFrame(rows + [(None, 1.0, 0.0, 0, 0.0)], "a double, b double, y double, o int, off double")
    for fit in (D.logit(df, "y", ["a", "b"]), D.poisson(df, "o", ["a", "b"], offset="off"), L.ols(df, "y", ["a", "b"])):
        got = {r["grid_index"]: r for r in I.partial_dependence(df, fit, "b", 7).collect()}
        clean = df.dropna(subset=["a"])
        for i, r in got.items():
            want = clean.withColumn("b", F.lit(r["grid_value"])).agg(F.avg(I._default_score(fit))).first()[0]
            assert r["partial_dependence"] == pytest.approx(want, rel=1e-10)
        assert len(got) == 7
    for link in ("logit", "probit"):
        fit = D.ordered(df, "o", ["a", "b"], link)
        for r in I.probability_curves(df, fit, "a", 4).collect():
            p = clean.withColumn("a", F.lit(r["grid_value"])).withColumn("p", D.class_probabilities(fit))
            want = p.agg(*[F.avg(F.col("p")[k]) for k in range(3)]).first()
            np.testing.assert_allclose(r["probabilities"], list(want), atol=1e-12)
    fit = L.ols(df, "y", ["a", "b"])
    keyed = df.withColumn("k", F.monotonically_increasing_id())
    some = keyed.limit(5)
    assert I.ice(keyed, fit, "a", "k", 3, ids=some).count() == 15
    one = some.first()["k"]
    assert {r["k"] for r in I.ice(keyed, fit, "a", "k", 3, ids=[one]).collect()} == {one}
