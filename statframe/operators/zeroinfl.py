"""Zero-inflated Poisson and negative binomial models with standard errors.

A row is a structural zero with probability p (logit in the inflation features), else a count
(log mean in the count features; NB2 dispersion exp(t)). After a few EM rounds from
:func:`.discrete.zip_poisson`, Newton's method runs on all parameters jointly. Score and
Hessian of the mixture come from those of its two complete-data parts by Louis' identity: with
the posterior share d of structural zeros,

    score   = E[complete score]
    Hessian = E[complete Hessian] + Var[complete score],

one aggregate over both parts per step, GRAM-shaped in the two designs. The observed information at the
optimum gives the covariance of all coefficients and of the dispersion.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import logistic
from ..plans.newton import lit_dot, newton
from .discrete import CONST, DiscreteFit, _project, lgamma_col, zip_poisson

#: EM rounds before the joint Newton steps.
EM_ROUNDS = 2


def digamma_col(z: Column) -> Column:
    """Derivative of log Gamma for z > 0: shift by 6, asymptotic series."""
    s = z + F.lit(6.0)
    i2 = F.lit(1.0) / (s * s)
    series = i2 * (F.lit(1 / 12) - i2 * (F.lit(1 / 120) - i2 * (F.lit(1 / 252) - i2 * (F.lit(1 / 240) - i2 * F.lit(1 / 132)))))
    low = F.lit(0.0)
    for k in range(6):
        low = low + F.lit(1.0) / (z + F.lit(float(k)))
    return F.log(s) - F.lit(0.5) / s - series - low


def trigamma_col(z: Column) -> Column:
    """Second derivative of log Gamma for z > 0."""
    s = z + F.lit(6.0)
    i2 = F.lit(1.0) / (s * s)
    series = (F.lit(1 / 6) - i2 * (F.lit(1 / 30) - i2 * (F.lit(1 / 42) - i2 * (F.lit(1 / 30) - i2 * F.lit(5 / 66))))) * i2 / s
    low = F.lit(0.0)
    for k in range(6):
        low = low + F.lit(1.0) / ((z + F.lit(float(k))) * (z + F.lit(float(k))))
    return F.lit(1.0) / s + i2 / F.lit(2.0) + series + low


def _poisson_layers(y: Column) -> list[dict]:
    mu = F.col("_mu")
    return [{"_lf": y * F.col("_b") - mu - lgamma_col(y + F.lit(1.0)), "_sb": y - mu, "_hbb": -mu}]


def _negbin_layers(y: Column, t: float) -> list[dict]:
    """log density of NB2 and its derivatives by log mean and log dispersion; r = exp(-t)."""
    mu, r = F.col("_mu"), F.lit(math.exp(-t))
    q = r + mu
    lf = (lgamma_col(y + r) - lgamma_col(r) - lgamma_col(y + F.lit(1.0)) + r * F.log(r / q) + y * F.log(mu / q))
    g = digamma_col(y + r) - digamma_col(r) + F.log(r / q) + F.lit(1.0) - (r + y) / q
    dg = trigamma_col(y + r) - trigamma_col(r) + F.lit(1.0) / r - F.lit(1.0) / q - (mu - y) / (q * q)
    return [{"_lf": lf, "_sb": r * (y - mu) / q, "_hbb": -(r + y) * mu * r / (q * q), "_g": g, "_dg": dg},
            {"_st": -r * F.col("_g"), "_hbt": -r * (y - mu) * mu / (q * q), "_htt": r * F.col("_g") + r * r * F.col("_dg")}]


def zero_inflated(df: DataFrame, y: str, features: list[str], inflate: list[str], family: str = "poisson", max_iter: int = 100,
                  tol: float = 1e-10) -> DiscreteFit:
    """Joint maximum likelihood. Terms are ``inflate:*``, ``count:*`` and, for ``family`` negbin,
    ``log_dispersion``. ``llnull`` is that of the model with the two constants (and the dispersion)."""
    if family not in ("poisson", "negbin"):
        raise ValueError(f"unknown family {family!r}")
    data = _project(df, y, list(dict.fromkeys(list(features) + list(inflate)))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yc = F.col(y).cast("double")
        zs = [F.lit(1.0)] + [F.col(c).cast("double") for c in inflate]
        xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
        kz, kx, nb = len(zs), len(xs), family == "negbin"
        start = zip_poisson(data, y, list(features), list(inflate), max_em=EM_ROUNDS)
        theta0 = np.concatenate([start["inflate_coef"], start["count_coef"], [0.0] * nb])
        if nb:
            mu = F.exp(lit_dot(start["count_coef"], xs))
            over = data.where(yc > 0).agg(F.avg(((yc - mu) ** 2 - yc) / (mu * mu))).first()[0]
            theta0[-1] = math.log(min(max(over or 0.0, 0.02), 5.0))

        def build(theta):
            parts = _negbin_layers(yc, float(theta[-1])) if nb else _poisson_layers(yc)
            p, lf = F.col("_p"), F.col("_lf")
            zero = yc == 0
            layers = [{"_a": lit_dot(theta[:kz], zs), "_b": lit_dot(theta[kz:kz + kx], xs)}, {"_p": logistic("_a"), "_mu": F.exp("_b")}, *parts]
            layers.append({"_l0": p + (F.lit(1.0) - p) * F.exp(lf)})
            layers.append({"_d": F.when(zero, p / F.col("_l0")).otherwise(0.0)})
            d, sb = F.col("_d"), F.col("_sb")
            n, v = F.lit(1.0) - d, d * (F.lit(1.0) - d)
            own = {"_ll": F.when(zero, F.log("_l0")).otherwise(F.log1p(-p) + lf), "_ga": d - p, "_gb": n * sb, "_haa": v - p * (F.lit(1.0) - p),
                   "_hab": -v * sb, "_hb2": n * F.col("_hbb") + v * sb * sb}
            if nb:
                st = F.col("_st")
                own.update({"_gt": n * st, "_hat": -v * st, "_hb_t": n * F.col("_hbt") + v * sb * st, "_ht2": n * F.col("_htt") + v * st * st})
            layers.append(own)
            c = F.col
            grad = [c("_ga") * z for z in zs] + [c("_gb") * x for x in xs] + ([c("_gt")] if nb else [])
            hess = [[c("_haa") * a * b for b in zs] + [c("_hab") * a * x for x in xs] + ([c("_hat") * a] if nb else []) for a in zs]
            hess += [[c("_hab") * a * z for z in zs] + [c("_hb2") * a * x for x in xs] + ([c("_hb_t") * a] if nb else []) for a in xs]
            if nb:
                hess.append([c("_hat") * z for z in zs] + [c("_hb_t") * x for x in xs] + [c("_ht2")])
            return layers, c("_ll"), grad, hess

        res = newton(data, build, theta0, max_iter=max_iter, tol=tol, max_step=2.0)
        terms = [f"inflate:{t}" for t in [CONST, *inflate]] + [f"count:{t}" for t in [CONST, *features]] + ["log_dispersion"] * nb
        null = res.llf if not features and not inflate else zero_inflated(data, y, [], [], family, max_iter, tol).llf
        fit = DiscreteFit(f"zero_inflated_{family}", terms, res.theta, np.linalg.inv(-res.hess), res.llf, null, res.n, 0, res.converged,
                          res.iterations, [], y, extra={"null_k": 2 + nb, "inflate_terms": kz})
        if nb:
            fit.extra["alpha"] = math.exp(float(res.theta[-1]))
        if not res.converged:
            fit.warnings.append("did not converge (no excess zeros, or no overdispersion)")
        return fit
    finally:
        data.unpersist()
