"""Discrete models against closed forms and Spark's GLR."""
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from statframe.operators import interpret as interp
from statframe.operators.discrete import grouped_logit, logit, ordered, poisson, probit
from statframe.operators.features import to_counts
from statframe.sources.scan import load
from tests.conftest import SF_MED, SF_SMALL


@pytest.fixture(scope="module")
def d(spark):
    li = load(spark, SF_MED, "lineitem")
    return li.select("l_quantity", "l_discount", (F.col("l_returnflag") == "R").cast("double").alias("y"),
                     (F.col("l_linestatus") == "F").cast("double").alias("x")).cache()


def test_logit_closed_form_and_grouped(d):
    fit = logit(d, "y", ["x"])
    c = {(r[0], r[1]): r[2] for r in d.groupBy("y", "x").count().collect()}
    b0 = math.log(c[(1.0, 0.0)] / c[(0.0, 0.0)])
    b1 = math.log(c[(1.0, 1.0)] / c[(0.0, 1.0)]) - b0
    assert fit.theta[0] == pytest.approx(b0, rel=1e-9)
    assert fit.theta[1] == pytest.approx(b1, rel=1e-7)
    assert fit.se[1] == pytest.approx(math.sqrt(sum(1 / v for v in c.values())), rel=1e-8)
    g = grouped_logit(to_counts(d, "y", ["x"]), "successes", "trials", ["x"])
    np.testing.assert_allclose(g.theta, fit.theta, rtol=1e-8)
    np.testing.assert_allclose(g.se, fit.se, rtol=1e-8)


@pytest.mark.parametrize("family,link,fn", [("binomial", "probit", probit), ("poisson", "log", poisson)])
def test_against_glr(spark, d, family, link, fn):
    data = d if family == "binomial" else d.withColumn("y", F.col("l_quantity"))
    fit = fn(data, "y", ["l_discount", "x"])
    va = VectorAssembler(inputCols=["l_discount", "x"], outputCol="f")
    glr = GeneralizedLinearRegression(family=family, link=link, featuresCol="f", labelCol="y", tol=1e-12,
                                      maxIter=100).fit(va.transform(data))
    np.testing.assert_allclose(fit.theta[1:], glr.coefficients.toArray(), rtol=1e-5)
    assert fit.theta[0] == pytest.approx(glr.intercept, rel=1e-6)


def test_ordered_null_model_and_level_effects(spark):
    o = load(spark, SF_SMALL, "orders")
    fit = ordered(o, "o_orderpriority", [], "logit")
    counts = sorted((r[0], r[1]) for r in o.groupBy("o_orderpriority").count().collect())
    n = sum(c for _, c in counts)
    cum = np.cumsum([c for _, c in counts])[:-1] / n
    np.testing.assert_allclose(fit.theta, np.log(cum / (1 - cum)), rtol=1e-8)
    fit2 = ordered(o, "o_orderpriority", ["o_totalprice"], "logit")
    eff = interp.effects_by_level(o, fit2)
    assert abs(sum(e[2] for e in eff)) < 1e-9


def test_perfect_separation_flags_not_overflow(spark):
    df = spark.createDataFrame([(float(i), 1.0 if i > 10 else 0.0) for i in range(21)], "x double, y double")
    fit = logit(df, "y", ["x"], max_iter=25)
    assert all(np.isfinite(fit.theta))


def test_one_class_is_error(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, y double")
    with pytest.raises(ValueError, match="one-class"):
        logit(df, "y", ["x"])
