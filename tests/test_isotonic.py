"""Distributed isotonic regression equals sequential pooling."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from statframe.operators import isotonic as I


def sequential(x, y, w):
    """(lo, hi, weight, value) blocks by plain pool-adjacent-violators."""
    out = []
    for v in sorted(set(x)):
        m = x == v
        out.append([v, v, w[m].sum(), (w[m] * y[m]).sum()])
        while len(out) > 1 and out[-2][3] / out[-2][2] >= out[-1][3] / out[-1][2]:
            b = out.pop()
            a = out.pop()
            out.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    return [(a, b, c, s / c) for a, b, c, s in out]


def cases(rng, n=900):
    x = np.round(rng.random(n) * 50, 1)
    return {"noise": (x, rng.integers(0, 2, n).astype(float)), "rising": (x, x * 2), "falling": (x, -x), "constant": (x, np.ones(n)),
            "wave": (x, np.sin(x / 4) + x / 30 + .3 * rng.normal(size=n)), "late drop": (x, np.where(x > 49, -1e6, x))}


@pytest.mark.parametrize("name", list(cases(np.random.default_rng(0))))
@pytest.mark.parametrize("buckets,ends", [(1, 16), (9, 1), (150, 2)])
def test_equals_sequential_pooling(spark, name, buckets, ends):
    rng = np.random.default_rng(2)
    x, y = cases(rng)[name]
    w = rng.integers(1, 4, len(x)).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), w.tolist())), "x double, y double, w double").repartition(3)
    fit = I.isotonic(df, "y", "x", "w", n_buckets=buckets, ends=ends, fan=4)  # several rounds of merging
    got = sorted(tuple(r) for r in fit.blocks.collect())
    np.testing.assert_allclose(np.array(got), np.array(sequential(x, y, w)), rtol=1e-9)


def test_prediction_equals_spark_ml_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.random(500), 2)
    y = (rng.random(500) < x).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "p double, label double")
    fit = I.isotonic(df, "label", "p", n_buckets=7)
    va = VectorAssembler(inputCols=["p"], outputCol="features")
    ml = IsotonicRegression().fit(va.transform(df))
    assert fit.knots().count() == len(ml.boundaries)
    new = spark.createDataFrame([(float(v),) for v in np.linspace(-.2, 1.2, 57)] + [(None,), (0.5,), (0.5,)], "p double")
    got = fit.predict(new, "p", "v")
    assert got.columns == ["p", "v"] and got.count() == 60
    want = {round(r["p"], 9): r["prediction"] for r in ml.transform(va.transform(new.dropna())).collect()}
    for r in got.collect():
        assert (r["v"] is None) if r["p"] is None else r["v"] == pytest.approx(want[round(r["p"], 9)], abs=1e-12)
    with_null = df.unionByName(spark.createDataFrame([(None, 1.0), (0.3, None)], df.schema))
    assert I.isotonic(with_null, "label", "p").blocks.agg(F.sum("weight")).first()[0] == 500
    with pytest.raises(ValueError, match="no complete rows"):
        I.isotonic(df.limit(0), "label", "p")
