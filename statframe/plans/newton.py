"""IRLS / Newton driver: each iteration is ONE aggregate over the cached
projection with the parameters inlined as literals (no growing lineage).

``build(theta)`` returns (llf_expr, [grad_exprs], [[hess_exprs]]) as Spark
aggregate-ready row expressions, optionally preceded by a list of projection
layers ({name: expr}) so that the linear index and link values are computed
once per row instead of being inlined into every sum (Catalyst keeps such
projections apart rather than duplicate expensive expressions). This module
sums them in one ``agg`` and takes a damped Newton step on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class NewtonResult:
    theta: np.ndarray
    llf: float
    grad: np.ndarray
    hess: np.ndarray
    n: int
    iterations: int
    converged: bool


def evaluate(df: DataFrame, build, theta: np.ndarray):
    out = build(theta)
    if len(out) == 4:
        layers, llf, grad, hess = out
        for layer in layers:
            df = df.withColumns(layer)
    else:
        llf, grad, hess = out
    p = len(grad)
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(llf).alias("_l")]
    aggs += [F.sum(g).alias(f"_g{i}") for i, g in enumerate(grad)]
    aggs += [F.sum(hess[i][j]).alias(f"_h{i}_{j}") for i in range(p) for j in range(i, p)]
    r = df.agg(*aggs).collect()[0]
    g = np.array([r[f"_g{i}"] or 0.0 for i in range(p)], dtype=float)
    h = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            h[i, j] = h[j, i] = r[f"_h{i}_{j}"] or 0.0
    return float(r["_l"]) if r["_l"] is not None else float("-inf"), g, h, int(r["_n"])


def newton(df: DataFrame, build, theta0, max_iter: int = 100, tol: float = 1e-10,
           max_step: float = 10.0) -> NewtonResult:
    """Maximise sum(llf) with analytic gradient/Hessian; step halving; capped steps.

    The Hessian returned by ``build`` is the second derivative of the
    log-likelihood (negative definite at a maximum).
    """
    theta = np.asarray(theta0, dtype=float)
    llf, g, h, n = evaluate(df, build, theta)
    converged = False
    it = 0
    for it in range(1, max_iter + 1):
        try:
            step = np.linalg.solve(-h, g)
        except np.linalg.LinAlgError:
            step = np.linalg.lstsq(-h, g, rcond=None)[0]
        big = np.max(np.abs(step)) if step.size else 0.0
        if big > max_step:
            step = step * (max_step / big)
        if big < tol * (1.0 + np.max(np.abs(theta))):
            # converged: take the (tiny) step without another pass; the Hessian at theta
            # differs from the one at theta + step by O(step), far below reported precision
            theta = theta + step
            converged = True
            break
        t = 1.0
        while True:
            cand = theta + t * step
            l2, g2, h2, _ = evaluate(df, build, cand)
            if (np.isfinite(l2) and l2 >= llf - 1e-12 * max(1.0, abs(llf))) or t < 1e-8:
                break
            t *= 0.5
        delta = np.max(np.abs(cand - theta)) if step.size else 0.0
        theta, llf, g, h = cand, l2, g2, h2
        if delta < tol * (1.0 + np.max(np.abs(theta))):
            converged = True
            break
    return NewtonResult(theta, llf, g, h, n, it, converged)


def lit_dot(theta, cols: list[Column]) -> Column:
    out = F.lit(0.0)
    for b, c in zip(theta, cols):
        out = out + F.lit(float(b)) * c
    return out
