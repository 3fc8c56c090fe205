"""Exact tree attribution equals enumeration over all feature subsets."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statframe.operators import trees, treeshap as T


def value(leaves, covers, x, known):
    """Model value with the features in ``known`` given: walk down, split by cover elsewhere."""
    reach = {}
    for leaf, n in zip(leaves, covers):
        for d in range(len(leaf.steps) + 1):
            key = tuple(w for _, w in leaf.steps[:d])
            reach[key] = reach.get(key, 0) + n
    total = 0.0
    for leaf in leaves:
        w, turns = 1.0, tuple(t for _, t in leaf.steps)
        for d, (s, left) in enumerate(leaf.steps):
            if s.feature in known:
                w *= float(bool(T._goes_left(s, x[None, :])[0]) == left)
            else:
                w *= reach[turns[:d + 1]] / reach[turns[:d]] if reach[turns[:d]] else .5
        total += w * leaf.value
    return total


def enumerate_phi(trees_, covers, x):
    k = len(x)
    phi = np.zeros(k)
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        for size in range(k):
            for s in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                for (tw, leaves), n in zip(trees_, covers):
                    phi[i] += w * tw * (value(leaves, n, x, {*s, i}) - value(leaves, n, x, set(s)))
    return phi


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(400, 5)), 1)
    y = x[:, 0] * x[:, 1] + 2 * (x[:, 2] > 0) + x[:, 3] + .1 * rng.normal(size=400)
    rows = [(i, *map(float, v), float(t), float(t > 1)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, y double, yc double").cache()


FEATS = ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("kind,task", [("tree", "regression"), ("forest", "regression"), ("gbt", "regression"),
                                       ("forest", "classification"), ("tree", "classification"), ("gbt", "classification")])
def test_equals_subset_enumeration(spark, data, kind, task):
    params = {"tree": {"maxDepth": 5}, "forest": {"numTrees": 4, "maxDepth": 4}, "gbt": {"maxIter": 3, "maxDepth": 3}}[kind]
    m = trees.train_tree_model(data, "y" if task == "regression" else "yc", FEATS, kind, task, **params)
    ex = T.TreeExplainer(m, data, FEATS)
    got = {r["id"]: np.array(r["phi"]) for r in ex.attributions(data, ["id"]).collect()}
    assert len(got) == 400
    parts = T.model_trees(m)
    covers = T.leaf_covers(parts, data, FEATS)
    assert all(n.sum() == 400 for n in covers)
    rows = {r["id"]: r for r in m.transform(data).collect()}
    for i in range(0, 400, 57):
        x = np.array([rows[i][f] for f in FEATS])
        np.testing.assert_allclose(got[i], enumerate_phi(parts, covers, x), atol=1e-10)
    for i, phi in got.items():  # the values add up to the model's output
        r = rows[i]
        out = r["prediction"] if task == "regression" else r["rawPrediction"][1] if kind == "gbt" else r["probability"][1]
        assert phi.sum() + ex.expected == pytest.approx(out, abs=1e-9)


def test_tables_by_pattern_equal_the_row_by_row_values(spark, data):
    m = trees.train_tree_model(data, "y", FEATS, "forest", numTrees=3, maxDepth=5)
    paths = T.TreeExplainer(m, data, FEATS).paths
    x = np.array([[r[f] for f in FEATS] for r in data.limit(100).collect()])
    np.testing.assert_allclose(T.shapley_values(paths, x), T.shapley_values(paths, x, T.path_tables(paths, 1)), atol=1e-12)


def test_nulls_empty_cover_and_summary(spark, data):
    m = trees.train_tree_model(data, "y", FEATS, "forest", numTrees=3, maxDepth=5)
    ex = T.TreeExplainer(m, data, FEATS)
    odd = spark.createDataFrame([(1, None, 0.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0)], "id int, a double, b double, c double, d double, e double")
    got = {r["id"]: r["phi"] for r in ex.attributions(odd).collect()}
    assert got[1] is None and len(got[2]) == 5
    s = {r["feature"]: r for r in ex.mean_absolute(data).collect()}
    phi = np.array([r["phi"] for r in ex.attributions(data, ["id"]).collect()])
    np.testing.assert_allclose([s[f]["mean_abs_phi"] for f in FEATS], np.abs(phi).mean(axis=0), rtol=1e-9)
    # cover from a table that leaves whole branches empty
    few = T.TreeExplainer(m, data.limit(3), FEATS)
    r = m.transform(data.where("id = 77")).first()
    assert sum(few.attributions(data.where("id = 77")).first()["phi"]) + few.expected == pytest.approx(r["prediction"], abs=1e-9)
    assert ex.attributions(data.limit(0)).count() == 0
