"""Identities for the tail models on small fixtures."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from statframe.operators import discrete as D
from statframe.operators import diagnostics as G
from statframe.operators import evaluate as E
from statframe.operators import linear as L
from statframe.operators import series as S
from statframe.plans.order import series_lags
from statframe.sources.scan import load
from tests.conftest import SF_SMALL


def test_clogit_pairs_equal_symmetric_logit(spark):
    rng = np.random.default_rng(3)
    rows, diff = [], []
    for s in range(400):
        x1, x2 = rng.normal(size=2)
        p = 1 / (1 + np.exp(-(x1 - x2) * 0.8))
        case_first = rng.random() < p
        rows += [(s, float(x1), 1.0 if case_first else 0.0), (s, float(x2), 0.0 if case_first else 1.0)]
        d = x1 - x2
        diff += [(float(d), 1.0 if case_first else 0.0), (float(-d), 0.0 if case_first else 1.0)]
    cl = D.clogit(spark.createDataFrame(rows, "s int, x double, y double"), "y", ["x"], "s")
    lg = D.logit(spark.createDataFrame(diff, "x double, y double"), "y", ["x"])
    assert abs(lg.theta[0]) < 1e-8
    assert cl.theta[0] == pytest.approx(lg.theta[1], rel=1e-7)


def test_tobit_without_censoring_is_ols(spark):
    li = load(spark, SF_SMALL, "lineitem")
    t = D.tobit(li, "l_extendedprice", ["l_quantity"], lower=-1e12)
    o = L.ols(li, "l_extendedprice", ["l_quantity"])
    np.testing.assert_allclose(t.theta[:2], o.beta, rtol=1e-6)
    assert np.exp(t.theta[2]) == pytest.approx(np.sqrt(o.ssr / o.n), rel=1e-6)


def test_gologit_without_free_terms_is_ordered(spark):
    o = load(spark, SF_SMALL, "orders")
    a = D.gologit(o, "o_orderpriority", ["o_totalprice"], [])
    b = D.ordered(o, "o_orderpriority", ["o_totalprice"])
    np.testing.assert_allclose(a.theta, b.theta, rtol=1e-6, atol=1e-10)


def test_block_gls_rho_zero_is_ols(spark):
    li = load(spark, SF_SMALL, "lineitem")
    g = L.gls_equicorrelated(li, "l_extendedprice", ["l_quantity"], "l_suppkey", 0.0)
    o = L.ols(li, "l_extendedprice", ["l_quantity"])
    np.testing.assert_allclose(g.beta, o.beta, rtol=1e-8)


def test_series_lags_hot_series(spark):
    rows = [(0 if i % 2 == 0 else i % 17 + 1, float(i), float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "sid int, t double, v double")
    got = series_lags(df, ["sid"], ["t"], ["v"], 2, n_buckets=8).toPandas().sort_values(["sid", "t"])
    pdf = df.toPandas().sort_values(["sid", "t"])
    want = pdf.groupby("sid")["v"].shift(2).to_numpy(dtype=float)
    np.testing.assert_array_equal(got["v_lag2"].to_numpy(dtype=float), want)


def test_arima_recovers_ar1(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(2):
        x = 0.0
        for t in range(1500):
            x = 0.6 * x + rng.normal()
            rows.append((s, t, float(x)))
    df = spark.createDataFrame(rows, "s int, t int, x double")
    coefs, fc = S.arima_hr(df, "x", "s", ["t"], p=1, d=0, q=0, long_ar=3, horizon=2)
    ar = {r["s"]: r["coefficient"] for r in coefs.where(F.col("term") == "ar1").collect()}
    assert all(abs(v - 0.6) < 0.07 for v in ar.values())
    assert fc.count() == 4


def test_negbin_detects_overdispersion(spark):
    rng = np.random.default_rng(9)
    lam = rng.gamma(shape=2.0, scale=2.5, size=3000)
    y = rng.poisson(lam)
    df = spark.createDataFrame([(float(v), float(i % 2)) for i, v in enumerate(y)], "y double, x double")
    fit = D.negbin(df, "y", ["x"])
    assert 0.3 < fit.extra["alpha"] < 0.8  # true alpha = 1 / shape = 0.5


def test_shapiro_wilk_normal_vs_skewed(spark):
    rng = np.random.default_rng(1)
    rows = [("n", float(v)) for v in rng.normal(size=400)] + [("e", float(v)) for v in rng.exponential(size=400)]
    r = {x["g"]: x for x in G.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    assert r["n"]["W"] > 0.99 and r["n"]["p_value"] > 0.01
    assert r["e"]["W"] < 0.9 and r["e"]["p_value"] < 1e-6


def test_bootstrap_632_and_nested_cv(spark):
    li = load(spark, SF_SMALL, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    b = E.bootstrap_632(li, "l_extendedprice", ["l_quantity"], key, B=10)
    assert b["replicates"] == 10 and b["err_oob"] > 0
    n = E.nested_cv_ridge(li, "l_extendedprice", ["l_quantity"], F.year("l_shipdate"), F.col("l_returnflag"), [0.0, 10.0])
    assert len(n) >= 5


def test_sampled_shapley_zero_for_unused_feature(spark):
    from statframe.operators import trees
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(3 * a)) for i, (a, b) in enumerate(zip(rng.normal(size=300), rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "id int, x1 double, x2 double, y double")
    m = trees.train_tree_model(df, "y", ["x1", "x2"], "tree", maxDepth=3)
    phi = {r["feature"]: r["s"] for r in trees.sampled_shapley(m, df, ["x1", "x2"], ["id"], samples=4)
           .groupBy("feature").agg(F.sum(F.abs("phi")).alias("s")).collect()}
    assert phi["x2"] == 0.0 and phi["x1"] > 0


def test_sampled_shapley_takes_its_references_from_all_rows(spark):
    from statframe.operators import trees
    # two feature points, 150 copies each: a prefix by feature hash holds one of them only
    rows = [(i, float(i % 2 * 10), float(i % 2 * 10)) for i in range(300)] + [(300, None, 0.0), (None, 10.0, 10.0), (0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    m = trees.train_tree_model(df, "y", ["x"], "tree", maxDepth=2)
    phi = trees.sampled_shapley(m, df, ["x"], ["id"], samples=4)
    assert phi.columns == ["id", "feature", "phi"]
    got = phi.toPandas()
    assert len(got) == 302 and (got["id"] == 0).sum() == 2 and got["id"].isna().sum() == 1
    assert abs(got["phi"].sum()) < 1e-6  # every row is a reference equally often: gains and losses cancel
    assert 3.5 < got["phi"].abs().mean() < 6.5 and (got["phi"] > 0).any() and (got["phi"] < 0).any()


def test_psm_heavy_ties_multi_bucket_equals_single(spark):
    """Few distinct scores (heavy ties): the matched ATT is the same whether the global
    order runs in one bucket or is split (heavy scores refined by the row key)."""
    from statframe.operators import causal
    import statframe.plans.order as order
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 3)), float(rng.random() < 0.4), float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, t double, y double")
    old = order.MIN_BUCKETS
    try:
        order.MIN_BUCKETS = 1
        one = causal.psm_att(df, "t", "y", ["x"], ["id"], caliper=0.5)
        order.MIN_BUCKETS = 40
        many = causal.psm_att(df, "t", "y", ["x"], ["id"], caliper=0.5)
    finally:
        order.MIN_BUCKETS = old
    assert one["matched"] == many["matched"]
    assert one["att"] == pytest.approx(many["att"], rel=1e-12)


def test_arima_with_a_difference_forecasts_levels(spark):
    """A random walk with drift: forecasts go on from the last level; a series shorter than
    the lag order still gets rows."""
    rng = np.random.default_rng(6)
    x, rows = 2000.0, []
    for t in range(800):
        x += 0.5 + rng.normal()
        rows.append((0, t, float(x)))
    df = spark.createDataFrame(rows, "s int, t int, x double")
    _, fc = S.arima_hr(df, "x", "s", ["t"], p=1, d=1, q=0, long_ar=3, horizon=3)
    got = [r["forecast"] for r in fc.orderBy("step").collect()]
    assert all(abs(v - (x + 0.5 * h)) < 5 for h, v in enumerate(got, 1))


def test_clogit_strata_without_contrast_change_nothing(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(150):
        a, b = rng.normal(size=2)
        first = rng.random() < 1 / (1 + np.exp(-(a - b)))
        rows += [(s, float(a), float(first)), (s, float(b), float(not first))]
    base = D.clogit(spark.createDataFrame(rows, "s int, x double, y double"), "y", ["x"], "s")
    more = rows + [(500 + k // 2, float(k % 7), float(k // 200)) for k in range(400)]
    full = D.clogit(spark.createDataFrame(more, "s int, x double, y double"), "y", ["x"], "s")
    assert full.theta[0] == pytest.approx(base.theta[0], rel=1e-8) and full.converged


def test_multinomial_scores_do_not_overflow(spark):
    fit = D.DiscreteFit("mnlogit", ["b:const", "b:x", "c:const", "c:x"], np.array([0.0, 1.0, 0.0, 2.0]), np.eye(4), 0, 0, 10, 3, True, 1, ["x"], "y")
    p = spark.createDataFrame([(1000.0,), (-1000.0,)], "x double").select(D.class_probabilities(fit).alias("p")).collect()
    assert p[0]["p"] == [0.0, 0.0, 1.0] and p[1]["p"] == [1.0, 0.0, 0.0]


def test_shapiro_wilk_above_5000_rows(spark):
    from statframe.operators import diagnostics
    rng = np.random.default_rng(2)
    rows = [("n", float(v)) for v in rng.normal(size=6000)] + [("e", float(v)) for v in rng.exponential(size=6000)] + [("s", 1.0)] * 3
    got = {r["g"]: r for r in diagnostics.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    assert got["n"]["W"] > 0.999 and got["e"]["W"] < 0.9 and got["s"]["W"] is None


def test_unset_checkpoint_folder_is_refused_off_local():
    from statframe import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
