"""Causal designs (C1-C7): 2SLS, difference-in-differences, propensity
matching (as-of neighbours, no pair enumeration), covariate balance / IPW,
regression discontinuity, pre-trend check, T-learner uplift."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import sym_inv
from ..plans.gram import gram
from ..plans.order import GlobalOrder
from .discrete import logit, probability
from .linear import design, ols


def iv2sls(df: DataFrame, y: str, exog: list[str], endog: list[str], instruments: list[str]) -> dict:
    """2SLS from ONE GRAM over [exog, endog, instruments, y]; projection algebra on the driver."""
    cols = list(dict.fromkeys(list(exog) + list(endog) + list(instruments) + [y]))
    data = design(df, y, [c for c in cols if c != y])
    mom = gram(data, cols)
    xs = ["_1"] + list(exog) + list(endog)
    zs = ["_1"] + list(exog) + list(instruments)
    full = ["_1"] + cols
    raw = mom.raw(cols)

    def blk(a, b):
        return raw[np.ix_([full.index(c) for c in a], [full.index(c) for c in b])]
    zz_inv = sym_inv(blk(zs, zs), zs)
    xz = blk(xs, zs)
    a = xz @ zz_inv @ xz.T
    a_inv = sym_inv(a, xs)
    beta = a_inv @ (xz @ zz_inv @ blk(zs, [y])[:, 0])
    xx = blk(xs, xs)
    xy = blk(xs, [y])[:, 0]
    yy = blk([y], [y])[0, 0]
    ssr = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    n, k = mom.n, len(xs)
    s2 = ssr / (n - k)
    cov = s2 * a_inv
    se = np.sqrt(np.diag(cov))
    terms = ["const"] + list(exog) + list(endog)
    return {"terms": terms, "beta": beta, "se": se, "cov": cov, "n": n, "ssr": ssr,
            "t": beta / se, "p": [dist.t_two_sided_p(t, n - k) for t in beta / se]}


def did(df: DataFrame, y: str, treat: str, post: str, controls: list[str] | None = None) -> dict:
    """OLS of y on treat, post, treat x post (+ controls); effect = interaction."""
    d = df.withColumn("_tp", F.col(treat).cast("double") * F.col(post).cast("double"))
    fit = ols(d, y, [treat, post, "_tp"] + list(controls or []))
    i = fit.terms.index("_tp")
    return {"did": fit.beta[i], "se": fit.se[i], "fit": fit}


def pre_trends(df: DataFrame, y: str, treat: str, time: str, pre: Column) -> dict:
    """In the pre-period, slope difference of y on time between groups (= 0 under parallel trends)."""
    d = df.where(pre).withColumn("_t", F.col(time).cast("double")).withColumn(
        "_tt", F.col(treat).cast("double") * F.col("_t"))
    fit = ols(d, y, [treat, "_t", "_tt"])
    i = fit.terms.index("_tt")
    t = fit.beta[i] / fit.se[i]
    return {"trend_diff": fit.beta[i], "se": fit.se[i], "t": t, "p_value": dist.t_two_sided_p(t, fit.df_resid)}


def balance(df: DataFrame, treat: str, covariates: list[str], weight: str | None = None) -> DataFrame:
    """C4: standardised mean difference per covariate, optionally weighted (IPW)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t = F.col(treat).cast("double")
    aggs = []
    for c in covariates:
        x = F.col(c).cast("double")
        for g, gv in (("1", t), ("0", F.lit(1.0) - t)):
            aggs += [F.sum(w * gv).alias(f"w{g}_{c}"), F.sum(w * gv * x).alias(f"s{g}_{c}"),
                     F.sum(w * gv * x * x).alias(f"q{g}_{c}")]
    r = df.dropna(subset=[treat] + list(covariates)).agg(*aggs).collect()[0]
    rows = []
    for c in covariates:
        m1, m0 = r[f"s1_{c}"] / r[f"w1_{c}"], r[f"s0_{c}"] / r[f"w0_{c}"]
        v1 = r[f"q1_{c}"] / r[f"w1_{c}"] - m1 * m1
        v0 = r[f"q0_{c}"] / r[f"w0_{c}"] - m0 * m0
        smd = (m1 - m0) / math.sqrt((v1 + v0) / 2) if v1 + v0 > 0 else math.nan
        rows.append((c, m1, m0, smd))
    return df.sparkSession.createDataFrame(rows, "covariate string, mean_treated double, mean_control double, smd double")


def ipw_weights(treat: str, ps: Column) -> Column:
    t = F.col(treat).cast("double")
    return t / ps + (F.lit(1.0) - t) / (F.lit(1.0) - ps)


def ipw_ate(df: DataFrame, y: str, treat: str, ps: Column) -> float:
    """C4: Hajek IPW estimate of the ATE."""
    t = F.col(treat).cast("double")
    yc = F.col(y).cast("double")
    r = df.select(t.alias("t"), yc.alias("y"), ps.alias("ps")).dropna().agg(
        F.sum(F.col("t") * F.col("y") / F.col("ps")).alias("a"), F.sum(F.col("t") / F.col("ps")).alias("b"),
        F.sum((1 - F.col("t")) * F.col("y") / (1 - F.col("ps"))).alias("c"),
        F.sum((1 - F.col("t")) / (1 - F.col("ps"))).alias("d")).collect()[0]
    return r["a"] / r["b"] - r["c"] / r["d"]


def psm_att(df: DataFrame, treat: str, y: str, covariates: list[str], key, caliper: float = 0.05,
            ps_col: str | None = None) -> dict:
    """1-nearest-neighbour matching with replacement on the propensity score.

    Treated and control rows are put in one global score order; each treated row
    reads the nearest control below and above it as as-of neighbours (no pairs
    are enumerated, so a dense score region costs no more than a sparse one).
    """
    keys = [key] if isinstance(key, str) else list(key)
    d = df.select(*dict.fromkeys(keys + [treat, y] + list(covariates))).dropna()
    if ps_col is None:
        fit = logit(d, treat, covariates)
        d = d.withColumn("_ps", probability(fit))
    else:
        d = df.select(*dict.fromkeys(keys + [treat, y]), F.col(ps_col).alias("_ps")).dropna()
    is_t = F.col(treat).cast("double") == 1.0
    d = (d.withColumn("_t", is_t.cast("int"))
         .withColumn("_cps", F.when(~is_t, F.col("_ps"))).withColumn("_cy", F.when(~is_t, F.col(y).cast("double"))))
    # a heavily tied score (few covariate patterns) is split by the row key
    nb = GlobalOrder(d, ["_ps", "_t"] + keys).with_neighbors(["_cps", "_cy"])
    tr = nb.where(F.col("_t") == 1)
    dl = F.col("_ps") - F.col("_cps_prev")
    du = F.col("_cps_next") - F.col("_ps")
    use_prev = F.col("_cps_prev").isNotNull() & (F.col("_cps_next").isNull() | (dl <= du))
    m = tr.withColumn("_dist", F.when(use_prev, dl).otherwise(du)).withColumn(
        "_ym", F.when(use_prev, F.col("_cy_prev")).otherwise(F.col("_cy_next")))
    ok = F.col("_dist").isNotNull() & (F.col("_dist") <= F.lit(caliper))
    r = m.agg(F.count(F.when(ok, 1)).alias("matched"), F.count(F.when(~ok | F.col("_dist").isNull(), 1)).alias("unmatched"),
              F.avg(F.when(ok, F.col(y).cast("double") - F.col("_ym"))).alias("att"),
              F.stddev_samp(F.when(ok, F.col(y).cast("double") - F.col("_ym"))).alias("sd")).collect()[0]
    se = r["sd"] / math.sqrt(r["matched"]) if r["matched"] else math.nan
    return {"att": r["att"], "se": se, "matched": r["matched"], "unmatched": r["unmatched"]}


def rdd(df: DataFrame, y: str, running: str, cutoff: float, bandwidth: float) -> dict:
    """Local linear regression on each side with triangular kernel weights; jump at the cutoff."""
    r = F.col(running).cast("double") - F.lit(cutoff)
    w = F.lit(1.0) - F.abs(r) / F.lit(bandwidth)
    base = df.select(F.col(y).cast("double").alias("_y"), r.alias("_r"), w.alias("_w")).dropna().where(
        F.abs(F.col("_r")) < F.lit(bandwidth))
    out = {}
    for side, cond in (("right", F.col("_r") >= 0), ("left", F.col("_r") < 0)):
        fit = ols(base.where(cond), "_y", ["_r"], weight="_w")
        out[side] = (fit.beta[0], fit.se[0], fit.n)
    jump = out["right"][0] - out["left"][0]
    se = math.sqrt(out["right"][1] ** 2 + out["left"][1] ** 2)
    return {"jump": jump, "se": se, "n_left": out["left"][2], "n_right": out["right"][2],
            "intercept_left": out["left"][0], "intercept_right": out["right"][0]}


def t_learner(df: DataFrame, y: str, treat: str, features: list[str]) -> tuple[Column, dict]:
    """Separate outcome models per arm; uplift = difference of the two SCORE columns."""
    t = F.col(treat).cast("double") == 1.0
    f1 = ols(df.where(t), y, features)
    f0 = ols(df.where(~t), y, features)
    return f1.linear_predictor() - f0.linear_predictor(), {"treated": f1, "control": f0}
