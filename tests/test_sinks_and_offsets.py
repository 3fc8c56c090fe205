"""Offsets in scoring and the null model, the prediction sink, lineage columns, bootstrap of effects."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from statframe.operators import discrete as D
from statframe.operators import interpret as I
from statframe.operators import score
from statframe.sources import registry as R
from statframe.sources.scan import load, register_tables, scan
from statframe.streaming import stream
from tests.conftest import SF_SMALL


def test_offset_is_scored_and_survives_the_registry(spark):
    rng = np.random.default_rng(4)
    n = 500
    t, x = rng.integers(1, 20, n).astype(float), rng.normal(size=n)
    y = rng.poisson(t * np.exp(.2 + .5 * x)).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(np.log(c))) for a, b, c in zip(y, x, t)], "y double, x double, lt double")
    fit = D.poisson(df, "y", ["x"], offset="lt")
    assert fit.llnull < fit.llf
    null = D.poisson(df.withColumn("z", F.lit(0.0)), "y", [], offset="lt")
    assert null.llf == pytest.approx(fit.llnull, rel=1e-9) and np.exp(null.theta[0]) == pytest.approx(y.sum() / t.sum(), rel=1e-8)
    pred = [r["prediction"] for r in score.predict_discrete(fit, df, interval=True).collect()]
    np.testing.assert_allclose(sorted(pred), np.sort(t * np.exp(fit.theta[0] + fit.theta[1] * x)), rtol=1e-9)
    path = stream.scratch(spark, "offsets")
    R.save_model(spark, fit, "rate_poisson_20240101_abc123", {"hash": "h", "n_rows": n, "n_cols": 3}, path=path, retrained_from="rate_poisson_20230101_abc123",
                 data=df, transforms={"x": "z-score"}, ids=["y"])
    row = R.load_model(spark, "rate_poisson_20240101_abc123", path)
    again = [r[0] for r in df.select(R.score_expression(row)).collect()]
    np.testing.assert_allclose(sorted(again), sorted(pred), rtol=1e-9)
    assert row["retrained_from"] == "rate_poisson_20230101_abc123"
    assert [tuple(c) for c in row["columns"]] == [("x", "double", "feature", "z-score"), ("y", "double", "target", "none"), ("y", "double", "id", "none")]


def test_prediction_sink_schema(spark):
    pred = spark.createDataFrame([(1, "a", 2.0), (None, "b", 3.0)], "k long, s string, prediction double")
    t = R.prediction_table(pred, "m_ols_20240101_abc123", ["k", "s"])
    assert t.columns == [*R.PREDICTION_COLUMNS, "schema_version"]
    assert {r["row_id"]: (r["prediction"], r["se"]) for r in t.collect()} == {"1|a": (2.0, None), "|b": (3.0, None)}
    assert R.prediction_table(pred, "m", None).columns == [*R.PREDICTION_COLUMNS, "schema_version", "k", "s"]


def test_named_table_is_scanned(spark):
    register_tables(spark, SF_SMALL, ["nation"])
    assert scan(spark, "nation").count() == 25


def test_bootstrap_of_effects_agrees_with_the_delta_method(spark):
    li = load(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                                  (F.col("l_returnflag") == "R").cast("double").alias("r"), (F.col("l_discount") * 10).alias("d"))
    fit = D.logit(li, "r", ["d"])
    b = I.poisson_bootstrap_effects(li, fit, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], B=300).first()
    mem = I.effects_at(li, fit, "mean")[0]
    assert b["mean"] == pytest.approx(mem[1], abs=.3 * mem[2]) and b["se"] == pytest.approx(mem[2], rel=.2)
    assert b["ci_lower"] < mem[1] < b["ci_upper"]
