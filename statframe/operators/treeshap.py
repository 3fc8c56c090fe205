"""Exact Shapley values of fitted trees, forests and boosted trees.

The game of a row x: v(S) is the model's value when the features in S are known, a split on any
other feature sending the row both ways in proportion to the training rows at its children
(*cover*, counted by one pass). A leaf adds its value times a product over the d distinct
features on its path, factor j being 1 or 0 as x passes the path's splits on j where j is known and
the product z_j of its cover shares where it is not. The Shapley value of such a product is

    phi_i = value (o_i - z_i) * integral over y in [0, 1] of prod_{j != i} (o_j y + z_j (1 - y)),

a polynomial of degree d - 1, which Gauss-Legendre with ceil(d / 2) nodes integrates exactly. So a
row costs leaves x depth x nodes multiplications, whatever the number of feature subsets; as x enters by the
pattern of passed features only, short paths are tabled by pattern and a row looks its values up. Rows are
attributed where they are: none is repeated, joined or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows x features of one vectorised step, and the most features of a path whose values are tabled by pattern.
CELLS, TABLE_DEPTH = 2_000_000, 10


@dataclass
class Split:
    feature: int
    threshold: float | None          # left when x <= threshold
    left_values: frozenset | None    # or left when x is one of these categories


@dataclass
class Leaf:
    value: float
    steps: list[tuple[Split, bool]]  # (split, went left) from the root


def _split_of(node) -> Split:
    s = node.split()
    if "Categorical" in s.getClass().getSimpleName():
        return Split(int(s.featureIndex()), None, frozenset(float(v) for v in s.leftCategories()))
    return Split(int(s.featureIndex()), float(s.threshold()), None)


def tree_leaves(tree, class_index: int | None) -> list[Leaf]:
    """Leaves of a fitted tree, left to right. ``class_index`` None takes the prediction, else the share
    of that class."""
    out: list[Leaf] = []
    stack = [(tree._java_obj.rootNode(), [])]
    while stack:
        node, steps = stack.pop()
        if "Leaf" in node.getClass().getSimpleName():
            if class_index is None:
                value = float(node.prediction())
            else:
                stats = list(node.impurityStats().stats())
                value = stats[class_index] / sum(stats)
            out.append(Leaf(value, steps))
            continue
        s = _split_of(node)
        stack.append((node.rightChild(), steps + [(s, False)]))
        stack.append((node.leftChild(), steps + [(s, True)]))
    return out


def model_trees(model, class_index: int = 1) -> list[tuple[float, list[Leaf]]]:
    """(weight, leaves) of the trees of a fitted pipeline's last stage, such that the weighted sum of leaf values is
    what is attributed: the prediction (regression), the probability of class ``class_index``
    (tree and forest classifiers) or the margin (boosted classifiers)."""
    m = model.stages[-1]
    name = type(m).__name__
    if name.startswith("GBT"):
        return [(float(w), tree_leaves(t, None)) for w, t in zip(m.treeWeights, m.trees)]
    classes = class_index if "Classification" in name else None
    if name.startswith("RandomForest"):
        return [(1 / len(m.trees), tree_leaves(t, classes)) for t in m.trees]
    return [(1.0, tree_leaves(m, classes))]


def _goes_left(s: Split, x: np.ndarray) -> np.ndarray:
    v = x[:, s.feature]
    return v <= s.threshold if s.threshold is not None else np.isin(v, list(s.left_values))


def _matrix(batch: pa.RecordBatch, columns) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


def leaf_covers(trees: list, df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Rows of ``df`` in each leaf of each tree, by one pass; a task sends its counts alone."""
    sizes = [len(leaves) for _, leaves in trees]

    def count(batches):
        total = np.zeros(sum(sizes), np.int64)
        for batch in batches:
            x = _matrix(batch, range(len(features)))
            at = 0
            for _, leaves in trees:
                for leaf in leaves:
                    here = np.ones(len(x), bool)
                    for s, left in leaf.steps:
                        here &= _goes_left(s, x) == left
                    total[at] += here.sum()
                    at += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["leaf", "n"])

    rows = (df.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna()
            .mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect())
    flat = np.zeros(sum(sizes))
    for r in rows:
        flat[r["leaf"]] = r["n"]
    return np.split(flat, np.cumsum(sizes)[:-1])


@dataclass
class Path:
    """A leaf as attribution sees it: its weighted value and its distinct features with their
    splits and cover shares."""
    value: float
    features: list[int]
    steps: list[list[tuple[Split, bool]]]
    shares: np.ndarray


def leaf_paths(weight: float, leaves: list[Leaf], covers: np.ndarray) -> list[Path]:
    """Paths of a tree. A node without rows shares them equally between its children."""
    reach: dict[tuple, float] = {}
    for leaf, n in zip(leaves, covers):
        for depth in range(len(leaf.steps) + 1):
            key = tuple(left for _, left in leaf.steps[:depth])
            reach[key] = reach.get(key, 0.0) + float(n)
    out = []
    for leaf in leaves:
        turns = tuple(left for _, left in leaf.steps)
        by: dict[int, tuple[list, float]] = {}
        for depth, (s, left) in enumerate(leaf.steps):
            whole = reach[turns[:depth]]
            share = reach[turns[:depth + 1]] / whole if whole else 0.5
            steps, z = by.get(s.feature, ([], 1.0))
            by[s.feature] = (steps + [(s, left)], z * share)
        out.append(Path(weight * leaf.value, list(by), [s for s, _ in by.values()], np.array([z for _, z in by.values()])))
    return out


def _path_values(path: Path, passed: np.ndarray) -> np.ndarray:
    """Shapley values of one path's features for rows of ``passed`` (rows, features): 1 where x passes."""
    n, d = passed.shape
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    total = np.zeros((n, d))
    for node, w in zip((nodes + 1) / 2, weights / 2):
        factor = passed * node + path.shares * (1 - node)
        before, behind = np.ones((n, d)), np.ones((n, d))
        for j in range(1, d):
            before[:, j] = before[:, j - 1] * factor[:, j - 1]
            behind[:, d - 1 - j] = behind[:, d - j] * factor[:, d - j]
        total += w * before * behind
    return total * path.value * (passed - path.shares)


def path_tables(paths: list[Path], depth: int = TABLE_DEPTH) -> list[np.ndarray | None]:
    """Values of every pattern of passed features (bit j: feature j passes) of the paths with at most ``depth``
    features; None for longer ones, which are worked out row by row."""
    return [_path_values(p, (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)) if 0 < (d := len(p.features)) <= depth else None
            for p in paths]


def shapley_values(paths: list[Path], x: np.ndarray, tables: list | None = None) -> np.ndarray:
    """(rows, features) Shapley values of the summed paths. Each distinct split is compared once."""
    phi = np.zeros((x.shape[1], len(x)))
    left: dict = {}
    for path, table in zip(paths, path_tables(paths) if tables is None else tables):
        if not path.features or path.value == 0:
            continue
        passed = []
        for steps in path.steps:
            ok = None
            for s, went_left in steps:
                key = (s.feature, s.threshold, s.left_values)
                if key not in left:
                    left[key] = _goes_left(s, x)
                side = left[key] if went_left else ~left[key]
                ok = side if ok is None else ok & side
            passed.append(ok)
        if table is None:
            values = _path_values(path, np.column_stack(passed).astype(float)).T
        else:
            pattern = np.zeros(len(x), np.int64)
            for j, ok in enumerate(passed):
                pattern |= ok.astype(np.int64) << j
            values = (table[:, j].take(pattern) for j in range(len(passed)))
        for f, v in zip(path.features, values):
            phi[f] += v
    return phi.T


class TreeExplainer:
    """Shapley values of a fitted tree pipeline (:func:`..trees.train_tree_model`)."""

    def __init__(self, model, train: DataFrame, features: list[str], class_index: int = 1):
        self.features = list(features)
        trees = model_trees(model, class_index)
        covers = leaf_covers(trees, train, features)
        self.paths = [p for (w, leaves), n in zip(trees, covers) for p in leaf_paths(w, leaves, n)]
        #: the model's value with no feature known; a row's values add up to its prediction minus this
        self.expected = float(sum(p.value * np.prod(p.shares) for p in self.paths))

    def attributions(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` (default: all columns) and ``phi``, an array of values in the order of the features; rows
        with a null feature get a null."""
        keep = list(df.columns) if keep is None else list(keep)
        paths, tables, k = self.paths, path_tables(self.paths), len(self.features)

        @F.arrow_udf("array<double>")
        def phi(*columns: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
            null = np.isnan(x).any(axis=1)
            out = np.zeros(x.shape)
            step = max(1, CELLS // max(k, 1))
            for lo in range(0, len(x), step):
                out[lo:lo + step] = shapley_values(paths, x[lo:lo + step], tables)
            offsets = pa.array(np.arange(0, x.size + 1, k), pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(null))

        return df.select(*keep, phi(*[F.col(c).cast("double") for c in self.features]).alias("phi"))

    def mean_absolute(self, df: DataFrame) -> DataFrame:
        """(feature, mean_abs_phi, rows) over the rows without nulls, by one pass of partial sums."""
        a = self.attributions(df, []).where(F.col("phi").isNotNull())
        aggs = [F.avg(F.abs(F.get("phi", F.lit(j)))).alias(f"m{j}") for j in range(len(self.features))]
        total = a.agg(F.count(F.lit(1)).alias("rows"), *aggs)
        entries = [F.struct(F.lit(f).alias("feature"), F.col(f"m{j}").alias("mean_abs_phi"), "rows") for j, f in enumerate(self.features)]
        return total.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
