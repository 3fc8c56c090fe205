"""Plans whose work per task must not grow with the table (findings of round 3)."""
import numpy as np
from pyspark.sql import functions as F

from statframe.operators import interpret, panel, trees
from statframe.operators.linear import ols
from statframe.plans.order import GlobalOrder, series_lags


def _rows(spark, n=600):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i // 2, float(rng.integers(0, 9)) if i % 7 else None, float(rng.random()), float(rng.normal())) for i in range(n)],
                                 "id long, a double, b double, y double")


def test_forest_intervals_without_row_multiplication(spark, monkeypatch):
    monkeypatch.setattr(trees, "PASS_LEAVES", 20)  # several passes over the trees
    d = _rows(spark)
    m = trees.train_tree_model(d, "y", ["a", "b"], "forest", numTrees=5, maxDepth=4)
    iv = trees.forest_interval(m, d, d.select("id", "a", "b"), "y", ["a", "b"], 0.2, "id")
    plan = iv._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    got = {r["id"]: r["q"] for r in iv.collect()}
    # by hand: the values of all leaves of a key's rows, in order
    seen = m.transform(d.dropna()).select("id", "y", "_leaves").collect()
    values = {}
    for r in seen:
        for t, leaf in enumerate(r["_leaves"]):
            values.setdefault((t, leaf), []).append(r["y"])
    summary = {k: [sorted(v)[max(int(np.ceil(round(i / 20 * len(v), 9))) - 1, 0)] for i in range(21)] for k, v in values.items()}
    pooled = {}
    for r in seen:
        pooled.setdefault(r["id"], []).extend(v for t, leaf in enumerate(r["_leaves"]) for v in summary[t, leaf])
    want = {k: [sorted(v)[int(np.ceil(round(q * len(v), 9))) - 1] for q in (0.1, 0.5, 0.9)] for k, v in pooled.items()}
    assert got.keys() == want.keys() and len(got) < 600
    for k in want:
        np.testing.assert_allclose(got[k], want[k])


def test_training_partitions_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(trees, "TRAIN_ROWS", 100)
    d = _rows(spark).coalesce(1)
    dealt = trees._dealt(d)
    size = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert size <= 100 and dealt.exceptAll(d).count() == d.exceptAll(dealt).count() == 0
    few = d.limit(90)
    assert trees._dealt(few) is few


def test_edge_tables_start_no_python_workers(spark):
    d = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, F.col("id") * 1.5).alias("w"))
    go = GlobalOrder(d, "id", n_buckets=4)
    many = GlobalOrder(d, ["v", "id"], n_buckets=100)  # two levels of cuts
    for out in (go.with_running_sums(["v"]), go.with_lags(["v", "w"], 2), go.with_neighbors(["v", "w"]), many.bucketed):
        plan = out._jdf.queryExecution().toString()
        assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    got = {r["id"]: (r["v_cum"], r["_idx"]) for r in go.with_running_sums(["v"]).collect()}
    assert got == {i: (float(sum(k % 7 for k in range(i + 1))), i + 1) for i in range(300)}
    assert GlobalOrder(d.limit(0), "id").with_running_sums(["v"]).count() == 0
    with_y = d.withColumn("y", F.col("v") * 2 + F.col("id") % 5)
    assert [t for t, _ in interpret.permutation_importance(with_y, ols(with_y, "y", ["v"]), "id")] == ["v"]


def test_series_lags_over_bucket_edges(spark):
    # series of 1 to 40 rows and one of 300, in more buckets than most series have rows
    rows = [(s, t, float(s * 1000 + t)) for s in range(30) for t in range(300 if s == 4 else 1 + s * 7 % 40)]
    d = spark.createDataFrame(rows, "s long, t long, v double")
    for buckets in (1, 9, 40):
        out = series_lags(d, "s", "t", ["v"], 3, n_buckets=buckets)
        got = {(r["s"], r["t"]): (r["v_lag1"], r["v_lag2"], r["v_lag3"]) for r in out.collect()}
        assert got == {(s, t): tuple(float(s * 1000 + t - k) if t >= k else None for k in (1, 2, 3)) for s, t, _ in rows}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1  # all lags in one pass, edges joined after it


def test_wooldridge_sorts_its_rows_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(panel, "_written", lambda df, name, w=panel._written: calls.append((name, df)) or w(df, name))
    d = spark.createDataFrame([(i % 7, i, float((i * 37) % 11), float((i * 13) % 17 + (i * 37) % 11)) for i in range(300)], "g long, t long, x double, y double")
    r = panel.wooldridge_ac(d, "y", ["x"], "g", "t")
    assert [n for n, _ in calls] == ["wooldridge-differences", "wooldridge-sums"]
    assert "Window" not in calls[1][1]._jdf.queryExecution().optimizedPlan().toString()
    e, lag = [], []
    rows = sorted((x["g"], x["t"], x["y"], x["x"]) for x in d.collect())
    diffs = {g: np.diff(np.array([q[2:] for q in rows if q[0] == g]), axis=0) for g in range(7)}
    b = sum((v[:, 0] * v[:, 1]).sum() for v in diffs.values()) / sum((v[:, 1] ** 2).sum() for v in diffs.values())
    for v in diffs.values():
        u = v[:, 0] - b * v[:, 1]
        e.append(u[1:])
        lag.append(u[:-1])
    rho = sum((x * y).sum() for x, y in zip(e, lag)) / sum((y * y).sum() for y in lag)
    se = np.sqrt(sum(((y * (x - rho * y)).sum()) ** 2 for x, y in zip(e, lag))) / sum((y * y).sum() for y in lag)
    np.testing.assert_allclose([r["rho"], r["f_stat"]], [rho, ((rho + 0.5) / se) ** 2], rtol=1e-9)
