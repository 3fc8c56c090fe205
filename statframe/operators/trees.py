"""Trees and recalibration (X1-X6) on pyspark.ml, with the attribution and
importance tables the specification asks trees to ship with (T13, X2)."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = {
    ("tree", "regression"): DecisionTreeRegressor, ("forest", "regression"): RandomForestRegressor,
    ("gbt", "regression"): GBTRegressor, ("tree", "classification"): DecisionTreeClassifier,
    ("forest", "classification"): RandomForestClassifier, ("gbt", "classification"): GBTClassifier,
}


#: Leaves aggregated in one pass: below 128 groups Spark's object aggregate keeps them in memory.
PASS_LEAVES = 100
#: Rows of a training partition at most (cached and read as a whole in each round of the fit).
TRAIN_ROWS = 500_000


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` itself, or dealt out anew by row number if a partition holds more than ``TRAIN_ROWS`` rows."""
    size = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (size[0] or 0) <= TRAIN_ROWS:
        return df
    return df.withColumn("_no", F.monotonically_increasing_id()).repartition(2 * size[1] // TRAIN_ROWS + 1, "_no").drop("_no")


def train_tree_model(df: DataFrame, y: str, features: list[str], kind: str = "forest", task: str = "regression",
                     seed: int = 42, validation_col: str | None = None, **params):
    """X1 (X6: ``validation_col`` enables GBT early stopping)."""
    est_cls = _KINDS[(kind, task)]
    kw = dict(featuresCol="_features", labelCol=y, **params)
    if kind != "tree":
        kw["seed"] = seed
    if kind == "gbt" and validation_col:
        kw["validationIndicatorCol"] = validation_col
    est = est_cls(**kw)
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    cols = [y] + list(features) + ([validation_col] if validation_col else [])
    return Pipeline(stages=[va, est]).fit(_dealt(df.select(*cols).dropna()))


def importance(model, features: list[str]) -> list[tuple]:
    """Impurity importance per feature."""
    imp = model.stages[-1].featureImportances
    return sorted(((f, float(imp[i])) for i, f in enumerate(features)), key=lambda t: -t[1])


def evaluate_tree(model, df: DataFrame, y: str, task: str = "regression") -> dict:
    pred = model.transform(df)
    if task == "regression":
        ev = RegressionEvaluator(labelCol=y, predictionCol="prediction")
        return {m: ev.setMetricName(m).evaluate(pred) for m in ("rmse", "mae", "r2")}
    ev = BinaryClassificationEvaluator(labelCol=y, rawPredictionCol="rawPrediction")
    return {"auc": ev.evaluate(pred)}


def grid_search(df: DataFrame, y: str, features: list[str], kind: str, task: str, grid: dict, folds: int = 3,
                seed: int = 42) -> dict:
    """Cross-validated grid search; returns the range, metric and chosen values."""
    est_cls = _KINDS[(kind, task)]
    est = est_cls(featuresCol="_features", labelCol=y)
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    pipe = Pipeline(stages=[va, est])
    pg = ParamGridBuilder()
    for k, vals in grid.items():
        pg = pg.addGrid(getattr(est, k), vals)
    ev = (RegressionEvaluator(labelCol=y, metricName="rmse") if task == "regression"
          else BinaryClassificationEvaluator(labelCol=y))
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=pg.build(), evaluator=ev, numFolds=folds, seed=seed)
    m = cv.fit(_dealt(df.select(y, *features).dropna()))
    best = m.bestModel.stages[-1]
    return {"metric": ev.getMetricName(), "scores": list(m.avgMetrics), "grid": grid,
            "chosen": {k: best.getOrDefault(getattr(best, k)) for k in grid}}


def recalibrate(df: DataFrame, y: str, p: str, how: str = "platt"):
    """Platt (logistic on the logit score, a fitted pipeline) or isotonic recalibration
    (an :class:`.isotonic.IsotonicFit`)."""
    if how == "isotonic":
        from .isotonic import isotonic
        return isotonic(df, y, p)
    d = df.select(F.col(y).cast("double").alias("label"), F.col(p).cast("double").alias("p")).dropna()
    if how == "platt":
        d = d.withColumn("z", F.log(F.col("p") / (F.lit(1.0) - F.col("p"))))
        va = VectorAssembler(inputCols=["z"], outputCol="features")
        return Pipeline(stages=[va, LogisticRegression(regParam=0.0)]).fit(d)
    raise ValueError(f"unknown recalibration {how!r}")


def _leaf_quantiles(rf, train: DataFrame, y: str, probs: list[float]) -> list[np.ndarray]:
    """Per tree a (leaves, points) array of the quantiles of ``y`` in each leaf (NaN: no training row). The trees
    are taken in passes of at most ``PASS_LEAVES`` leaves, so that each pass aggregates in memory and sorts no row."""
    leaves = [(t.numNodes + 1) // 2 for t in rf.trees]
    passes, room = [], 0
    for k, n in enumerate(leaves):
        if not passes or n > room:
            passes, room = [*passes, []], PASS_LEAVES
        passes[-1].append(k)
        room -= n
    table = [np.full((n, len(probs)), np.nan) for n in leaves]
    for ks in passes:
        got = (train.select(y, F.posexplode(F.slice(vector_to_array("_leaves"), ks[0] + 1, len(ks))).alias("tree", "leaf"))
               .groupBy("tree", "leaf").agg(F.percentile_approx(y, probs, 1000).alias("qs")))
        for r in got.collect():  # a row per leaf of the model
            table[ks[0] + r["tree"]][int(r["leaf"])] = [float(v) for v in r["qs"]]
    return table


def _pooled_udf(spark, table: list[np.ndarray], at: list[float]):
    """Arrow function: the leaf vectors of a key with their row counts -> the quantiles ``at`` of all their leaves' values."""
    flat = np.concatenate(table)
    first = np.cumsum([0, *map(len, table)])[:-1]
    shared = spark.sparkContext.broadcast((flat, first))

    def pick(values: np.ndarray) -> np.ndarray:
        n = np.sum(~np.isnan(values), axis=1)
        values = np.sort(values, axis=1)  # NaN last
        return np.stack([values[np.arange(len(values)), np.maximum(np.ceil(q * n).astype(np.int64) - 1, 0)] for q in at], axis=1)

    @F.arrow_udf("array<double>")
    def pooled(groups: pa.Array) -> pa.Array:
        flat, first = shared.value
        parts = groups.flatten()
        leaf = parts.field("_at").flatten().to_numpy(zero_copy_only=False).reshape(len(parts), len(first))
        weight = parts.field("_w").to_numpy(zero_copy_only=False)
        ends = np.cumsum(groups.value_lengths().to_numpy(zero_copy_only=False))
        out = np.empty((len(groups), len(at)))
        step = max(1, 4_000_000 // (len(first) * flat.shape[1]))
        size = np.diff(np.r_[0, ends])
        one = np.flatnonzero(size == 1)
        for lo in range(0, len(one), step):
            rows = one[lo:lo + step]
            out[rows] = pick(flat[leaf[ends[rows] - 1] + first].reshape(len(rows), -1))
        for i in np.flatnonzero(size > 1):
            mine = slice(ends[i] - size[i], ends[i])
            v = flat[leaf[mine] + first].reshape(size[i], -1)
            w = np.repeat(weight[mine], v.shape[1])
            v = v.ravel()
            order = np.argsort(v)
            order = order[~np.isnan(v[order])]
            cum = np.cumsum(w[order])
            out[i] = [v[order[min(np.searchsorted(cum, np.ceil(q * cum[-1])), len(order) - 1)]] if len(order) else np.nan for q in at]
        known = ~np.isnan(out).any(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(at), pa.int32()), pa.array(out.ravel()),
                                        mask=pa.array(~known)) if len(out) else pa.array([], pa.list_(pa.float64()))

    return pooled


def forest_interval(model, train: DataFrame, new: DataFrame, y: str, features: list[str],
                    alpha: float = 0.1, key: str | list[str] = "_row", points: int = 21) -> DataFrame:
    """Quantile-forest style interval. Each (tree, leaf) keeps a fixed-size quantile
    summary of its training targets (``points`` values, size-weighted); a new row pools
    the summaries of its T leaves (T x points values, independent of the data size)
    and takes the quantiles of these inside its task: rows are not multiplied, and what is shuffled is one leaf
    vector per row. ``key`` names the columns that identify a new row; rows equal in it are pooled."""
    key = [key] if isinstance(key, str) else list(key)
    rf = model.stages[-1]
    va = model.stages[0]
    rf.setLeafCol("_leaves")
    probs = [i / (points - 1) for i in range(points)]
    table = _leaf_quantiles(rf, rf.transform(va.transform(train.select(y, *features).dropna())), y, probs)
    pooled = _pooled_udf(new.sparkSession, table, [alpha / 2, 0.5, 1 - alpha / 2])
    nw = rf.transform(va.transform(new)).select(*key, vector_to_array("_leaves").cast("array<int>").alias("_at"))
    # one shuffle: the rows of a key meet, equal leaf vectors are counted, and the vectors of a key are listed
    vectors = nw.repartition(*key).groupBy(*key, "_at").agg(F.count(F.lit(1)).alias("_w"))
    kind = train.schema[y].dataType.simpleString()
    return (vectors.groupBy(*key).agg(F.collect_list(F.struct("_at", "_w")).alias("_v"))
            .select(*key, pooled("_v").cast(f"array<{kind}>").alias("q")).where("q is not null"))


def sampled_shapley(model, df: DataFrame, features: list[str], key_cols: list[str], samples: int = 8, seed: int = 7) -> DataFrame:
    """Monte Carlo Shapley values per row and feature with reference rows, for any fitted pipeline
    (:mod:`.treeshap` has the exact values of trees by cover).

    The reference points are all rows (without null features): rows are put in a hash-seeded
    global order, and sample m of row i takes row i + o_m of that order (cyclic, with distinct
    seeded offsets o_m) as its reference, one equi-join on the index. Every row is thus the
    reference of ``samples`` rows. Each row is expanded over ``samples`` hash-seeded feature
    orderings; for feature j the "with" point takes features ranked <= j from the row and the
    rest from the reference row, the "without" point the same with j from the reference.
    ``model.transform`` scores all points; phi_j is the mean difference. Rows with equal keys
    are attributed one by one. Work is rows x samples x 2p.
    """
    from ..plans.order import GlobalOrder
    keys = [F.col(c) for c in key_cols]
    data = df.select(*key_cols, *features).dropna(subset=features)
    hashed = data.withColumns({f"_h{k}": F.xxhash64(F.lit(seed + 3 + k), *keys, *[F.col(c) for c in features]) for k in (0, 1)})
    order = GlobalOrder(hashed, ["_h0", "_h1"])
    n = max(order.n_rows, 1)
    idx = order.with_running_sums([]).drop("_b", "_tie", "_h0", "_h1")
    rng = random.Random(seed)
    offsets: list[int] = []
    while len(offsets) < samples:
        offsets += rng.sample(range(n), min(n, samples - len(offsets)))
    at = F.pmod(F.col("_idx") + F.get(F.lit(offsets).cast("array<long>"), F.col("_m") - F.lit(1)), F.lit(n))
    ref = idx.select(F.pmod(F.col("_idx"), F.lit(n)).alias("_at"), *[F.col(c).cast("double").alias(f"_bg_{c}") for c in features])
    d = idx.withColumn("_m", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("_at", at).join(ref, "_at")
    for c in features:
        d = d.withColumn(f"_r_{c}", F.xxhash64(F.lit(seed + 2), F.col("_m"), F.lit(c), *keys))
    pts = []
    for j in features:
        for which in (1, 0):
            vals = []
            for c in features:
                take_row = (F.col(f"_r_{c}") < F.col(f"_r_{j}")) if c != j else F.lit(which == 1)
                vals.append(F.when(take_row, F.col(c).cast("double")).otherwise(F.col(f"_bg_{c}")).alias(c))
            pts.append(F.struct(F.lit(j).alias("_feat"), F.lit(which).alias("_with"), *vals))
    own = [F.col(c).alias(f"_key{k}") for k, c in enumerate(key_cols)]  # a key may be a feature as well
    e = d.select("_idx", *own, F.explode(F.array(*pts)).alias("_p")).select("_idx", *[f"_key{k}" for k in range(len(own))], "_p.*")
    scored = model.transform(e)
    sgn = F.when(F.col("_with") == 1, F.col("prediction")).otherwise(-F.col("prediction"))
    return (scored.groupBy("_idx", *[f"_key{k}" for k in range(len(own))], "_feat").agg((F.sum(sgn) / F.lit(float(samples))).alias("phi"))
            .select(*[F.col(f"_key{k}").alias(c) for k, c in enumerate(key_cols)], F.col("_feat").alias("feature"), "phi"))
