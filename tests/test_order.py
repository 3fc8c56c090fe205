"""GIDX global order equals a single-task brute force, for any bucket count."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from statframe.plans.order import CutTable, GlobalOrder, bucket_count
from statframe.sources.scan import load
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_lags_and_running_sums(spark, buckets):
    ev = load(spark, SF_SMALL, "events").select("ts", "event_id", "value")
    pdf = ev.toPandas().sort_values(["ts", "event_id"]).reset_index(drop=True)
    go = GlobalOrder(ev, ["ts", "event_id"], n_buckets=buckets)
    lag = go.with_lags(["value"], 3).toPandas().sort_values("_idx").reset_index(drop=True)
    assert list(lag["_idx"]) == list(range(1, len(pdf) + 1))
    for k in (1, 2, 3):
        np.testing.assert_array_equal(lag[f"value_lag{k}"].to_numpy(dtype=float),
                                      pdf["value"].shift(k).to_numpy(dtype=float))
    run = go.with_running_sums(["value"]).toPandas().sort_values("_idx")
    np.testing.assert_allclose(run["value_cum"].to_numpy(), pdf["value"].cumsum().to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("buckets", [700, 5000])
def test_two_levels_of_cuts(spark, buckets):
    """Beyond ONE_LEVEL buckets an Arrow function searches the cuts; keys of all types, a heavy leading key."""
    rows = [(5.0 if i % 3 == 0 else float(i % 400), f"s{i % 7}", i, float(i % 11)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k double, s string, t long, v double")
    go = GlobalOrder(df, ["k", "s", "t"], n_buckets=buckets)
    sizes = [r["count"] for r in go.bucketed.groupBy("_b").count().collect()]
    assert len(sizes) > buckets * .6 and max(sizes) < 6000 / buckets * 8 + 8
    pdf = df.toPandas().sort_values(["k", "s", "t"]).reset_index(drop=True)
    lag = go.with_lags(["v"], 2).toPandas().sort_values("_idx").reset_index(drop=True)
    np.testing.assert_array_equal(lag["t"].to_numpy(), pdf["t"].to_numpy())
    np.testing.assert_array_equal(lag["v_lag2"].to_numpy(dtype=float), pdf["v"].shift(2).to_numpy(dtype=float))
    run = go.with_running_sums(["v"]).toPandas().sort_values("_idx")
    np.testing.assert_allclose(run["v_cum"].to_numpy(), pdf["v"].cumsum().to_numpy(), rtol=1e-12)


def test_neighbours(spark):
    df = spark.createDataFrame([(float(i), float(i) if i % 3 == 0 else None) for i in range(50)], "k double, v double")
    out = GlobalOrder(df, ["k"], n_buckets=5).with_neighbors(["v"]).toPandas().sort_values("k")
    for _, r in out.iterrows():
        i = int(r["k"])
        assert r["v_prev"] == float(i - i % 3)
        nxt = i + (-i % 3)
        assert (r["v_next"] == float(nxt)) if nxt < 50 else np.isnan(r["v_next"])


def test_heavy_leading_key_is_split(spark):
    """A third of the rows share one leading key value: they must spread over several
    buckets (split by the second order column) and lags must stay exact."""
    rows = [(5.0 if i % 3 == 0 else float(i), float(i), float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k double, t double, v double")
    go = GlobalOrder(df, ["k", "t"], n_buckets=12)
    sizes = [r["c"] for r in go.bucketed.groupBy("_b").count().withColumnRenamed("count", "c").collect()]
    assert max(sizes) < 1000 / 2, sizes
    pdf = df.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    lag = go.with_lags(["v"], 2).toPandas().sort_values("_idx").reset_index(drop=True)
    np.testing.assert_array_equal(lag["v_lag2"].to_numpy(dtype=float), pdf["v"].shift(2).to_numpy(dtype=float))
    np.testing.assert_array_equal(lag["t"].to_numpy(), pdf["t"].to_numpy())


def test_key_heavy_in_two_columns_is_split(spark):
    """A third of the rows share the first two order columns; the third one splits them."""
    rows = [(5.0, "a", i, float(i % 7)) if i % 3 == 0 else (float(i), "b", i, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k double, s string, t long, v double")
    go = GlobalOrder(df, ["k", "s", "t"], n_buckets=12)
    assert max(r["count"] for r in go.bucketed.groupBy("_b").count().collect()) < 500
    pdf = df.toPandas().sort_values(["k", "s", "t"]).reset_index(drop=True)
    lag = go.with_lags(["v"], 3).toPandas().sort_values("_idx").reset_index(drop=True)
    np.testing.assert_array_equal(lag["v_lag3"].to_numpy(dtype=float), pdf["v"].shift(3).to_numpy(dtype=float))
    np.testing.assert_array_equal(lag["t"].to_numpy(), pdf["t"].to_numpy())


def test_bucket_count_follows_the_rows():
    assert bucket_count(10) == 8 and bucket_count(10**8) == 200 and 100_000 < bucket_count(6 * 10**11) < 200_000


def test_null_order_keys_are_refused_and_longs_stay_exact(spark):
    with pytest.raises(ValueError, match="null"):
        GlobalOrder(spark.createDataFrame([(1,), (None,)], "k long"), ["k"])
    big = 2**62
    df = spark.createDataFrame([(big + i, float(i)) for i in range(200)], "k long, v double")
    lag = GlobalOrder(df, ["k"], n_buckets=9).with_lags(["v"], 1).toPandas().sort_values("_idx")
    assert list(lag["v"]) == [float(i) for i in range(200)] and list(lag["v_lag1"])[1:] == [float(i) for i in range(199)]


def test_cut_table_equals_tuple_comparison():
    rng = np.random.default_rng(6)
    draw = lambda n: list(zip(rng.choice([0.0, 1.5, -2.0, np.inf, np.nan], n).tolist(), rng.choice(["", "a", "é", "zz"], n).tolist(), rng.integers(0, 5, n).tolist()))
    key = lambda t: (np.isnan(t[0]), 0.0 if np.isnan(t[0]) else t[0], t[1], t[2])
    cuts = sorted({key(t): t for t in draw(40)}.values(), key=key)
    rows = draw(500)
    cols = [np.array([r[j] for r in rows], dtype=d) for j, d in enumerate((float, object, np.int64))]
    want = [sum(key(c) <= key(r) for c in cuts) for r in rows]
    assert CutTable(cuts).buckets(cols).tolist() == want
