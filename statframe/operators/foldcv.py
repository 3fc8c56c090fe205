"""Cross-validation of discrete models with all folds fitted together.

Every fold's model leaves its own rows out, and all of them take their Newton steps side by side: one
pass per step evaluates score, Hessian and log-likelihood of each fold at that fold's parameters, on
Arrow batches, and a task sends one vector of sums. So the number of passes is that of a single fit,
whatever the number of folds; only the arithmetic grows with it. A last pass scores every row
with the model that has not seen it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .discrete import class_codes
from .evaluate import _collect_bounded

EPS = 1e-15


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Multinomial:
    """Class shares from exp(x'b); the first class is the base (two classes: binary logit)."""

    def __init__(self, classes: int, k: int):
        self.classes, self.k = classes, k + 1
        self.size = (classes - 1) * self.k

    def start(self, shares: np.ndarray) -> np.ndarray:
        t = np.zeros((self.classes - 1, self.k))
        t[:, 0] = np.log(shares[1:] / shares[0])
        return t.ravel()

    def probabilities(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.zeros(len(x)), np.column_stack([np.ones(len(x)), x]) @ theta.reshape(-1, self.k).T])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def sums(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p = self.probabilities(theta, x)
        X = np.column_stack([np.ones(len(x)), x])
        c, k = self.classes - 1, self.k
        d = (y[:, None] == np.arange(1, c + 1)) - p[:, 1:]
        h = np.empty((c, k, c, k))
        for a in range(c):
            for b in range(a, c):
                w = p[:, a + 1] * ((a == b) - p[:, b + 1])
                h[a, :, b] = h[b, :, a] = -(X * w[:, None]).T @ X
        return np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum(), (d.T @ X).ravel(), h.reshape(self.size, self.size)


class Ordered:
    """P(Y <= j) = logistic(cut_j - x'b); parameters are b and the cuts."""

    def __init__(self, classes: int, k: int):
        self.classes, self.k = classes, k
        self.size = k + classes - 1

    def start(self, shares: np.ndarray) -> np.ndarray:
        cum = np.cumsum(shares)[:-1]
        return np.concatenate([np.zeros(self.k), np.log(cum / (1 - cum))])

    def _ends(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        cuts = np.concatenate([[-np.inf], theta[self.k:], [np.inf]])
        return cuts[None, :] - (x @ theta[:self.k])[:, None]

    def probabilities(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.diff(_logistic(self._ends(theta, x)), axis=1), 0)

    def sums(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        ends = self._ends(theta, x)
        row = np.arange(len(y))
        f = [_logistic(ends[row, y + side]) for side in (0, 1)]
        p = np.maximum(f[1] - f[0], 1e-300)
        q, first, second = [], [], []
        for side in (0, 1):
            d = f[side] * (1 - f[side])
            m = np.zeros((len(y), self.size))
            m[:, :self.k] = -x
            cut = y + side - 1
            inner = (cut >= 0) & (cut < self.classes - 1)
            m[row[inner], self.k + cut[inner]] = 1
            q.append(m)
            first.append(d / p)
            second.append(d * (1 - 2 * f[side]) / p)
        s = q[1] * first[1][:, None] - q[0] * first[0][:, None]
        h = (q[1] * second[1][:, None]).T @ q[1] - (q[0] * second[0][:, None]).T @ q[0] - s.T @ s
        return np.log(p).sum(), s.sum(axis=0), h


FAMILIES = {"logit": Multinomial, "mnlogit": Multinomial, "ordered": Ordered}


def _totals(data: DataFrame, add, width: int) -> np.ndarray:
    """Sum over all tasks of the vector that ``add`` makes of a partition."""
    def run(batches):
        total = np.zeros(width)
        for pdf in batches:
            x = pdf.iloc[:, 2:].to_numpy(dtype=float)
            add(total, pdf["_y"].to_numpy(dtype=np.int64), pdf["_f"].to_numpy(dtype=np.int64), x)
        yield pd.DataFrame({"pos": np.arange(width), "v": total})

    out = np.zeros(width)
    for r in data.mapInPandas(run, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[r["pos"]] = r["v"]
    return out


def fit_folds(data: DataFrame, model, folds: int, start: np.ndarray, max_iter: int = 60, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(parameters of every fold, which converged) by Newton steps taken together; a fold whose
    likelihood would fall halves its own step."""
    p = model.size
    step_width = 1 + p + p * p

    def evaluate(theta):
        def add(total, y, f, x):
            t = total.reshape(folds, step_width)
            for k in range(folds):
                m = f != k
                ll, g, h = model.sums(theta[k], x[m], y[m])
                t[k, 0] += ll
                t[k, 1:1 + p] += g
                t[k, 1 + p:] += h.ravel()

        t = _totals(data, add, folds * step_width).reshape(folds, step_width)
        return t[:, 0], t[:, 1:1 + p], t[:, 1 + p:].reshape(folds, p, p)

    theta = np.tile(start, (folds, 1))
    ll, g, h = evaluate(theta)
    done = np.zeros(folds, bool)
    for _ in range(max_iter):
        step = np.stack([np.linalg.lstsq(-h[k], g[k], rcond=None)[0] for k in range(folds)])
        step *= np.minimum(1, 5 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300))
        small = np.abs(step).max(axis=1) < tol * (1 + np.abs(theta).max(axis=1))
        theta = np.where((small & ~done)[:, None], theta + step, theta)
        done |= small
        if done.all():
            break
        scale = np.where(done, 0.0, 1.0)
        while True:
            cand = theta + scale[:, None] * step
            ll2, g2, h2 = evaluate(cand)
            worse = ~done & ~(ll2 >= ll - 1e-10 * np.abs(ll)) & (scale > 1e-8)
            if not worse.any():
                break
            scale = np.where(worse, scale / 2, scale)
        theta, ll, g, h = cand, ll2, g2, h2
    return theta, done


def cross_validate_discrete(df: DataFrame, y: str, features: list[str], fold: Column, family: str = "mnlogit", max_iter: int = 60) -> list[dict]:
    """Out-of-fold log loss, accuracy and Brier score (summed over classes) per fold for ``family`` logit,
    mnlogit or ordered. Rows with a null are left out; a class that a fold's training rows lack makes that
    fold not converge (reported, not dropped)."""
    code, labels = class_codes(df, y)
    if len(labels) < 2:
        raise ValueError(f"target {y!r} has fewer than two classes")
    if family == "logit" and len(labels) > 2:
        raise ValueError(f"target {y!r} has {len(labels)} classes: use mnlogit")
    data = df.select(code.alias("_y"), fold.alias("_fold"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)]).dropna()
    counts = _collect_bounded(data.groupBy("_fold").pivot("_y", list(range(len(labels)))).count().fillna(0), "folds")
    names = sorted(r["_fold"] for r in counts)
    if len(names) < 2:
        raise ValueError("cross-validation needs at least two folds")
    number = data.sparkSession.createDataFrame([(f, i) for i, f in enumerate(names)], data.select(F.col("_fold").alias("_n")).schema.add("_f", "integer"))
    coded = (data.join(F.broadcast(number), F.col("_fold") == F.col("_n")).select("_y", "_f", *[f"_x{j}" for j in range(len(features))])
             .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        model = FAMILIES[family](len(labels), len(features))
        total = np.array([[r[str(c)] for c in range(len(labels))] for r in counts], dtype=float).sum(axis=0)
        theta, done = fit_folds(coded, model, len(names), model.start(total / total.sum()), max_iter)

        def score(out, y, f, x):
            t = out.reshape(len(names), 4)
            for k in np.unique(f):
                m = f == k
                p = model.probabilities(theta[k], x[m])
                own = p[np.arange(m.sum()), y[m]]
                t[k] += [m.sum(), -np.log(np.clip(own, EPS, 1 - EPS)).sum(), (p.argmax(axis=1) == y[m]).sum(),
                         ((p - (y[m][:, None] == np.arange(len(labels)))) ** 2).sum()]

        t = _totals(coded, score, len(names) * 4).reshape(len(names), 4)
        return [{"fold": f, "n": int(a[0]), "log_loss": a[1] / a[0], "accuracy": a[2] / a[0], "brier": a[3] / a[0], "converged": bool(d)}
                for f, a, d in zip(names, t, done)]
    finally:
        coded.unpersist()
