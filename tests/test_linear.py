"""GRAM identities and OLS cross-checks."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from statframe.functions.linalg import RankDeficient
from statframe.operators.linear import ols, segmented_ols
from statframe.plans.gram import block_gram, gram, grouped_gram, moments_from_row
from statframe.sources.scan import load
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def li(spark):
    return load(spark, SF_SMALL, "lineitem").cache()


def test_grouped_gram_rows_add_up(li):
    names = ["l_quantity", "l_discount", "l_extendedprice"]
    total = gram(li, names)
    rows = grouped_gram(li, ["l_returnflag"], names).collect()
    parts = [moments_from_row(r, names) for r in rows]
    s = parts[0]
    for p in parts[1:]:
        s = s + p
    assert s.n == total.n
    np.testing.assert_allclose(s.m, total.m, rtol=1e-12)


def test_block_gram_equals_sum_gram(li):
    names = ["l_quantity", "l_discount", "l_extendedprice"]
    a = gram(li, names)
    b = block_gram(li, [F.col(c) for c in names], None, names)
    np.testing.assert_allclose(a.m, b.m, rtol=1e-10)
    np.testing.assert_allclose(a.s, b.s, rtol=1e-10)


def test_ols_matches_spark_ml(li):
    fit = ols(li, "l_extendedprice", ["l_quantity", "l_discount"])
    va = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="f")
    lr = LinearRegression(featuresCol="f", labelCol="l_extendedprice", solver="normal", regParam=0.0).fit(va.transform(li))
    np.testing.assert_allclose(fit.beta[1:], lr.coefficients.toArray(), rtol=1e-8)
    assert fit.beta[0] == pytest.approx(lr.intercept, rel=1e-8)
    se = lr.summary.coefficientStandardErrors  # intercept last
    np.testing.assert_allclose(fit.se[1:], se[:-1], rtol=1e-6)


def test_segmented_equals_per_segment_fit(li):
    seg = {(r["l_returnflag"], r["term"]): r["coefficient"]
           for r in segmented_ols(li, "l_extendedprice", ["l_quantity"], ["l_returnflag"]).collect()}
    one = ols(li.where(F.col("l_returnflag") == "R"), "l_extendedprice", ["l_quantity"])
    assert seg[("R", "l_quantity")] == pytest.approx(one.beta[1], rel=1e-5)


def test_robust_se_are_positive_and_hc1_scales_hc0(li):
    f0 = ols(li, "l_extendedprice", ["l_quantity"], se_type="HC0")
    f1 = ols(li, "l_extendedprice", ["l_quantity"], se_type="HC1")
    np.testing.assert_allclose(f1.se, f0.se * np.sqrt(f0.n / (f0.n - 2)), rtol=1e-12)


def test_edge_cases(spark, li):
    with pytest.raises(ValueError, match="not found"):
        ols(li, "l_extendedprice", ["nope"])
    with pytest.raises(TypeError, match="Non-numeric"):
        ols(li, "l_extendedprice", ["l_returnflag"])
    with pytest.raises(ValueError, match="empty"):
        ols(li.where(F.lit(False)), "l_extendedprice", ["l_quantity"])
    with pytest.raises(RankDeficient, match="const_col"):
        ols(li.withColumn("const_col", F.lit(3.0)), "l_extendedprice", ["l_quantity", "const_col"])
    with pytest.raises(RankDeficient, match="dup"):
        ols(li.withColumn("dup", F.col("l_quantity") * 2), "l_extendedprice", ["l_quantity", "dup"])


def test_nan_and_null_dropped(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, float("nan")), (3.0, None), (4.0, 5.0), (5.0, 7.0)], "x double, y double")
    fit = ols(df, "y", ["x"])
    assert fit.n == 3
    assert any("fewer than three per coefficient" in w for w in fit.warnings)


def test_durbin_watson_rejects_duplicate_order_keys(spark, li):
    from statframe.operators.diagnostics import durbin_watson
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    with pytest.raises(ValueError, match="tie-break"):
        durbin_watson(li, fit, ["l_orderkey", "l_linenumber"])  # not unique in this table
    ev = load(spark, SF_SMALL, "events")
    efit = ols(ev, "value", ["user_id"])
    assert durbin_watson(ev, efit, ["ts", "event_id"])[0] == "durbin_watson"


def test_reset_detects_curvature(spark):
    from statframe.operators.diagnostics import reset
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, 2000)
    df = spark.createDataFrame([(float(a), float(a * a + rng.normal())) for a in x], "x double, y double")
    fit = ols(df, "y", ["x"])
    row = reset(df, fit)
    assert row[0] == "reset" and row[1] > 100 and row[4] == "FAIL"
    lin = spark.createDataFrame([(float(a), float(2 * a + rng.normal())) for a in x], "x double, y double")
    assert reset(lin, ols(lin, "y", ["x"]))[1] < 10


def test_lag_operators_reject_duplicate_order_keys(spark, li):
    from statframe.operators.diagnostics import breusch_godfrey
    from statframe.operators.series import acf
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    with pytest.raises(ValueError, match="tie-break"):
        breusch_godfrey(li, fit, ["l_orderkey", "l_linenumber"])
    with pytest.raises(ValueError, match="tie-break"):
        acf(li, "l_quantity", ["l_orderkey", "l_linenumber"], 2)
    with pytest.raises(ValueError, match="tie-break"):
        ols(li, "l_extendedprice", ["l_quantity"], se_type="hac", order_by=["l_orderkey", "l_linenumber"])


def test_running_sum_operators_reject_duplicate_order_keys(spark, li):
    from statframe.operators.series import cusum, kpss
    for fn in (cusum, kpss):
        with pytest.raises(ValueError, match="tie-break"):
            fn(li, "l_quantity", ["l_orderkey", "l_linenumber"])
