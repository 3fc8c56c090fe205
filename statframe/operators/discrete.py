"""Discrete choice and GLMs (D1-D20) on the Newton plan.

Binary logit/probit, Poisson, gamma, inverse Gaussian, negative binomial,
grouped (count) logit, ordered logit/probit, multinomial logit. Each
iteration is one aggregate; only k x k matrices reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.columns import logistic, norm_cdf, norm_pdf, norm_tail, sig
from ..plans.newton import lit_dot, newton
from ..sources.scan import check_nonempty, require, require_numeric

CONST = "const"
MAX_CLASSES = 1000

COEF_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("coefficient", T.DoubleType()),
    T.StructField("se", T.DoubleType()), T.StructField("z_stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("ci_lower", T.DoubleType()),
    T.StructField("ci_upper", T.DoubleType())])
STAT_SCHEMA = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


def lgamma_col(z: Column) -> Column:
    """log Gamma(z) for z > 0: shift by 6, Stirling series (abs err < 1e-13)."""
    s = z + F.lit(6.0)
    inv = F.lit(1.0) / s
    inv2 = inv * inv
    series = inv * (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * F.lit(1 / 1680))))
    st = (s - F.lit(0.5)) * F.log(s) - s + F.lit(0.5 * math.log(2 * math.pi)) + series
    prod = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5)
    return st - F.log(prod)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


@dataclass
class DiscreteFit:
    family: str
    terms: list[str]
    theta: np.ndarray
    cov: np.ndarray
    llf: float
    llnull: float
    n: int
    n_classes: int
    converged: bool
    iterations: int
    features: list[str] = field(default_factory=list)
    target: str = ""
    classes: list = field(default_factory=list)
    scale: float = 1.0
    link: str = ""
    extra: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @property
    def k(self) -> int:
        """Estimated parameters, with those outside ``theta`` (the NB dispersion)."""
        return len(self.theta) + self.extra.get("more_params", 0)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    @property
    def aic(self) -> float:
        return -2 * self.llf + 2 * self.k

    @property
    def bic(self) -> float:
        return -2 * self.llf + self.k * math.log(self.n)

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.llf / self.llnull if self.llnull else math.nan

    def lr_test(self) -> tuple[float, float, int]:
        df = self.k - self.extra.get("null_k", 1)
        stat = 2 * (self.llf - self.llnull)
        return stat, dist.chi2_sf(stat, df) if df > 0 else math.nan, df

    def coef_rows(self, alpha: float = 0.05) -> list[tuple]:
        z = dist.norm_ppf(1 - alpha / 2)
        out = []
        for t, b, s in zip(self.terms, self.theta, self.se):
            zs = b / s if s > 0 else math.nan
            p = 2 * dist.norm_sf(abs(zs)) if not math.isnan(zs) else math.nan
            out.append((t, sig(b), sig(s), sig(zs), sig(p), sig(b - z * s), sig(b + z * s)))
        return out

    def coefficients(self, spark: SparkSession, alpha: float = 0.05) -> DataFrame:
        return spark.createDataFrame(self.coef_rows(alpha), COEF_SCHEMA)

    def stat_rows(self) -> list[tuple]:
        lr, lrp, _ = self.lr_test()
        conf = 0.5 + min(0.20, 0.05 * self.n ** 0.3) + min(0.15, 0.20 * max(self.pseudo_r2, 0.0))
        vals = [("log_likelihood", self.llf), ("ll_null", self.llnull), ("aic", self.aic), ("bic", self.bic),
                ("pseudo_r2", self.pseudo_r2), ("lr_stat", lr), ("lr_pvalue", lrp), ("n_obs", self.n),
                ("n_params", self.k), ("n_classes", self.n_classes), ("converged", float(self.converged)),
                ("iterations", self.iterations), ("scale", self.scale),
                ("confidence", round(min(1.0, max(0.0, conf)), 4))]
        vals += [(k, v) for k, v in self.extra.items() if isinstance(v, (int, float)) and k not in ("null_k", "more_params")]
        return [(m, sig(v)) for m, v in vals]

    def fit_stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stat_rows(), STAT_SCHEMA)

    def odds_ratios(self, spark: SparkSession, alpha: float = 0.05) -> DataFrame:
        """exp(beta) with exp-transformed CI."""
        z = dist.norm_ppf(1 - alpha / 2)
        rows = [(t, sig(math.exp(b)), sig(math.exp(b - z * s)), sig(math.exp(b + z * s)))
                for t, b, s in zip(self.terms, self.theta, self.se) if t != CONST]
        schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("ratio", T.DoubleType()),
                               T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType())])
        return spark.createDataFrame(rows, schema)

    def linear_predictor(self) -> Column:
        """x'b, plus the offset column the model was fitted with."""
        b = self.theta[:len(self.features) + 1]
        eta = lit_dot(b, [F.lit(1.0)] + [F.col(c).cast("double") for c in self.features])
        offset = self.extra.get("offset")
        return eta + F.col(offset).cast("double") if offset else eta


# --------------------------------------------------------- helpers
def _project(df: DataFrame, y: str, features: list[str], extra: list[str] | None = None) -> DataFrame:
    require(df, [y] + list(features) + list(extra or []), "training data")
    require_numeric(df, features, "training data")
    cols = [y] + list(features) + [c for c in (extra or []) if c not in features and c != y]
    return df.select(*cols).dropna(subset=[y] + list(features) + list(extra or []))


def binarize(df: DataFrame, y: str) -> tuple[DataFrame, list]:
    """second sorted label is 1, every other label 0 (warns if > 2 labels). Only the
    first three sorted labels are needed."""
    labels = [r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().orderBy(y).limit(3).collect()]
    if len(labels) < 2:
        raise ValueError(f"target {y!r} has fewer than two classes")
    if len(labels) > 2:
        import warnings
        warnings.warn(f"target {y!r} has more than two classes: {labels[1]!r} (second sorted label) is coded 1, "
                      "every other label 0", stacklevel=2)
    return df.withColumn(y, (F.col(y) == F.lit(labels[1])).cast("double")), labels


def class_codes(df: DataFrame, y: str) -> tuple[Column, list]:
    """sorted distinct labels -> 0-based code (small code table, bounded)."""
    labels = [r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct()
              .orderBy(y).limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"target {y!r} has more than {MAX_CLASSES} classes")
    code = F.lit(None).cast("int")
    for i, lab in reversed(list(enumerate(labels))):
        code = F.when(F.col(y) == F.lit(lab), F.lit(i)).otherwise(code)
    return code, labels


# --------------------------------------------------------------- GLM
LINKS = ("logit", "probit", "log", "identity", "inverse", "cloglog")


def _glm_parts(family: str, link: str, y: Column, eta: Column, alpha: float = 1.0):
    """(mu, u, W, llf_row) with u = dl/deta, W = -d2l/deta2 (observed where canonical)."""
    if family == "binomial":
        if link == "logit":
            mu = logistic(eta)
            return mu, y - mu, mu * (F.lit(1.0) - mu), y * eta - softplus(eta)
        if link == "probit":
            tail = norm_tail(eta)
            cdf_pos = F.when(eta > 0, F.lit(1.0) - tail).otherwise(tail)
            cdf_neg = F.when(eta > 0, tail).otherwise(F.lit(1.0) - tail)
            pdf = norm_pdf(eta)
            l1 = pdf / cdf_pos
            l0 = pdf / cdf_neg
            u = y * l1 - (F.lit(1.0) - y) * l0
            w = y * l1 * (l1 + eta) + (F.lit(1.0) - y) * l0 * (l0 - eta)
            ll = y * F.log(cdf_pos) + (F.lit(1.0) - y) * F.log(cdf_neg)
            return cdf_pos, u, w, ll
        if link == "cloglog":
            mu = F.lit(1.0) - F.exp(-F.exp(eta))
            d = F.exp(eta - F.exp(eta))
            u = d * (y - mu) / (mu * (F.lit(1.0) - mu))
            w = d * d / (mu * (F.lit(1.0) - mu))
            ll = y * F.log(mu) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - mu)
            return mu, u, w, ll
    if family == "poisson" and link == "log":
        mu = F.exp(eta)
        return mu, y - mu, mu, y * eta - mu - lgamma_col(y + F.lit(1.0))
    if family == "negbin" and link == "log":
        mu = F.exp(eta)
        a = F.lit(alpha)
        u = (y - mu) / (F.lit(1.0) + a * mu)
        w = mu * (F.lit(1.0) + a * y) / ((F.lit(1.0) + a * mu) * (F.lit(1.0) + a * mu))
        r = F.lit(1.0 / alpha)
        ll = (lgamma_col(y + r) - lgamma_col(r) - lgamma_col(y + F.lit(1.0))
              + r * F.log(r / (r + mu)) + y * F.log(mu / (r + mu)))
        return mu, u, w, ll
    if family in ("gamma", "inverse_gaussian", "gaussian"):
        # quasi-likelihood Fisher scoring; llf from deviance and Pearson scale later
        if link == "log":
            mu = F.exp(eta)
            dmu = mu
        elif link == "identity":
            mu = eta
            dmu = F.lit(1.0)
        elif link == "inverse":
            mu = F.lit(1.0) / eta
            dmu = -mu * mu
        else:
            raise ValueError(link)
        var = {"gamma": mu * mu, "inverse_gaussian": mu * mu * mu, "gaussian": F.lit(1.0)}[family]
        u = (y - mu) * dmu / var
        w = dmu * dmu / var
        quasi = {"gamma": -y / mu - F.log(mu), "inverse_gaussian": -y / (F.lit(2.0) * mu * mu) + F.lit(1.0) / mu,
                 "gaussian": -(y - mu) * (y - mu) / F.lit(2.0)}[family]
        return mu, u, w, quasi
    raise ValueError(f"unsupported family/link {family}/{link}")


def glm(df: DataFrame, y: str, features: list[str], family: str = "binomial", link: str | None = None,
        weight: str | None = None, offset: str | None = None, alpha: float = 1.0,
        max_iter: int = 100, tol: float = 1e-10, scale: str | None = None,
        theta0: np.ndarray | None = None, null_model: bool = True, persist: bool = True) -> DiscreteFit:
    """GLM by Newton / Fisher scoring."""
    link = link or {"binomial": "logit", "poisson": "log", "negbin": "log", "gamma": "log",
                    "inverse_gaussian": "log", "gaussian": "identity"}[family]
    extra = [c for c in (weight, offset) if c]
    labels: list = []
    if family == "binomial" and not isinstance(df.schema[y].dataType, (T.NumericType, T.BooleanType)):
        df, labels = binarize(df, y)
    data = _project(df, y, features, extra)
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
        yc = F.col(y).cast("double")
        wc = F.col(weight).cast("double") if weight else None
        oc = F.col(offset).cast("double") if offset else F.lit(0.0)
        # null model moments / start values in one pass
        agg = data.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(wc if wc is not None else F.lit(1.0)).alias("sw"),
                       F.sum(yc * (wc if wc is not None else F.lit(1.0))).alias("sy")).collect()[0]
        check_nonempty(agg["n"], "training data after dropping NA")
        ybar = agg["sy"] / agg["sw"]
        if family == "binomial":
            if not 0 < ybar < 1:
                raise ValueError("one-class target: cannot fit a binary model")
            start0 = {"logit": math.log(ybar / (1 - ybar)), "probit": dist.norm_ppf(ybar),
                      "cloglog": math.log(-math.log(1 - ybar))}[link]
        elif link == "log":
            start0 = math.log(ybar) if ybar > 0 else 0.0
        elif link == "inverse":
            start0 = 1.0 / ybar
        else:
            start0 = ybar
        k = len(xs)

        def build(theta):
            eta = lit_dot(theta, xs) + oc
            _, u, w, ll = _glm_parts(family, link, yc, F.col("_eta"), alpha)
            if wc is not None:
                u, w, ll = u * wc, w * wc, ll * wc
            layers = [{"_eta": eta}, {"_u": u, "_w": w, "_ll": ll}]
            uc, wcol = F.col("_u"), F.col("_w")
            grad = [uc * x for x in xs]
            hess = [[-(wcol * xs[i] * xs[j]) for j in range(k)] for i in range(k)]
            return layers, F.col("_ll"), grad, hess

        if theta0 is None:
            theta0 = np.zeros(k)
            theta0[0] = start0
        res = newton(data, build, np.asarray(theta0, dtype=float), max_iter=max_iter, tol=tol)
        info = -res.hess
        cov = np.linalg.inv(info)
        # null log-likelihood: intercept-only model at the closed-form optimum
        if family == "binomial" and not offset:
            # closed form: sum w [y ln ybar + (1 - y) ln(1 - ybar)]
            sy, sw = agg["sy"], agg["sw"]
            ll_null = sy * math.log(ybar) + (sw - sy) * math.log(1 - ybar)
        elif not null_model:
            ll_null = float("nan")
        else:
            ll_null = _null_llf(data, family, link, yc, wc, oc if offset else None, start0, alpha)
        fit = DiscreteFit(family if family != "binomial" else link, [CONST] + list(features), res.theta, cov,
                          res.llf, ll_null, res.n, 2 if family == "binomial" else 0, res.converged,
                          res.iterations, list(features), y, labels[:2], link=link)
        if offset:
            fit.extra["offset"] = offset
        if len(labels) > 2:
            fit.warnings.append(f"more than two classes: {labels[1]!r} is coded 1, every other label 0 (D12)")
        if family in ("gamma", "inverse_gaussian", "gaussian") or scale == "pearson":
            eta = lit_dot(res.theta, xs) + oc
            mu, *_ = _glm_parts(family if family != "binomial" else "binomial", link, yc, eta, alpha)
            var = {"gamma": mu * mu, "inverse_gaussian": mu * mu * mu, "gaussian": F.lit(1.0),
                   "poisson": mu, "binomial": mu * (F.lit(1.0) - mu), "negbin": mu + F.lit(alpha) * mu * mu}[family]
            r = data.agg(F.sum((yc - mu) * (yc - mu) / var).alias("x2")).collect()[0]
            phi = r["x2"] / (res.n - k)
            fit.scale = phi
            fit.cov = cov * phi
            fit.extra["pearson_chi2"] = r["x2"]
        if not res.converged:
            fit.warnings.append("did not converge (possible separation)")
        return fit
    finally:
        if persist:
            data.unpersist()


def _null_llf(data, family, link, yc, wc, oc, start0, alpha) -> float:
    w = wc if wc is not None else F.lit(1.0)
    if oc is None:
        _, _, _, ll = _glm_parts(family, link, yc, F.lit(float(start0)), alpha)
        return float(data.agg(F.sum(ll * w)).collect()[0][0])

    def build(theta):  # with an offset the constant has no closed form
        _, u, v, ll = _glm_parts(family, link, yc, F.col("_eta"), alpha)
        return [{"_eta": F.lit(float(theta[0])) + oc}, {"_u": u * w, "_w": v * w, "_ll": ll * w}], F.col("_ll"), [F.col("_u")], [[-F.col("_w")]]

    return newton(data, build, np.array([float(start0)])).llf


def logit(df, y, features, **kw) -> DiscreteFit:
    return glm(df, y, features, "binomial", "logit", **kw)


def probit(df, y, features, **kw) -> DiscreteFit:
    return glm(df, y, features, "binomial", "probit", **kw)


def poisson(df, y, features, **kw) -> DiscreteFit:
    return glm(df, y, features, "poisson", "log", **kw)


def negbin(df: DataFrame, y: str, features: list[str], max_outer: int = 50, tol: float = 1e-7,
           null_model: bool = True) -> DiscreteFit:
    """NB2 by profile likelihood: warm-started Newton for beta at fixed alpha, then a
    1-D Newton step in log(alpha) from one aggregate of the llf at three points; the
    start is the moment estimate of alpha from a Poisson fit. alpha counts as a parameter,
    and the null model has its own alpha; ``converged`` is false after ``max_outer`` rounds."""
    data = _project(df, y, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yc = F.col(y).cast("double")
        pois = glm(data, y, features, "poisson", "log", null_model=False, persist=False)
        mu0 = F.exp(pois.linear_predictor())
        mom_a = data.agg(F.avg(((yc - mu0) ** 2 - yc) / (mu0 * mu0))).collect()[0][0]
        theta = pois.theta
        fit = None
        prev_ll = -math.inf
        settled = False
        alpha = float(mom_a) if (mom_a or 0.0) > 1e-8 else 1e-3
        if (mom_a or 0.0) <= 1e-8:
            # no overdispersion by moments: confirm with the sign of the profile score in
            # log(alpha) at a small alpha (one aggregate); if it falls, alpha -> 0 is the MLE
            mu = F.exp(pois.linear_predictor())
            vals = []
            for a in (1e-3 * math.exp(-1e-3), 1e-3 * math.exp(1e-3)):
                r = F.lit(1.0 / a)
                vals.append(F.sum(lgamma_col(yc + r) - lgamma_col(r) + r * F.log(r / (r + mu))
                                  + yc * F.log(mu / (r + mu))))
            lo_ll, hi_ll = data.agg(*vals).collect()[0]
            if hi_ll <= lo_ll:
                alpha = 1e-6
                max_outer = 0
                settled = True
        for _ in range(max_outer):
            fit = glm(data, y, features, "negbin", "log", alpha=alpha, theta0=theta, null_model=False, persist=False)
            theta = fit.theta
            mu = F.exp(fit.linear_predictor())
            vals = []
            h = 1e-3
            for a in (alpha * math.exp(-h), alpha, alpha * math.exp(h)):
                r = F.lit(1.0 / a)
                ll = (lgamma_col(yc + r) - lgamma_col(r) - lgamma_col(yc + F.lit(1.0))
                      + r * F.log(r / (r + mu)) + yc * F.log(mu / (r + mu)))
                vals.append(F.sum(ll))
            l0, l1, l2 = data.agg(*vals).collect()[0]
            d1 = (l2 - l0) / (2 * h)
            d2 = (l2 - 2 * l1 + l0) / (h * h)
            step = -d1 / d2 if d2 < 0 else (0.5 if d1 > 0 else -0.5)
            step = max(min(step, 2.0), -2.0)
            alpha = alpha * math.exp(step)
            if abs(step) < tol or abs(l1 - prev_ll) < 1e-10 * (1 + abs(l1)):
                settled = True
                break
            if alpha < 1e-6:  # boundary: no overdispersion, the Poisson limit
                alpha = 1e-6
                settled = True
                break
            prev_ll = l1
        fit = glm(data, y, features, "negbin", "log", alpha=alpha, theta0=theta, null_model=False, persist=False)
        fit.extra.update(alpha=alpha, more_params=1, null_k=2)
        fit.converged = fit.converged and settled
        fit.family = "negbin"
        if null_model:
            fit.llnull = negbin(data, y, [], max_outer or 50, tol, null_model=False).llf if features else fit.llf
        return fit
    finally:
        data.unpersist()


def grouped_logit(df: DataFrame, successes: str, trials: str, features: list[str], link: str = "logit") -> DiscreteFit:
    """Binomial GLM on aggregated counts (share weighted by trials)."""
    d = df.where(F.col(trials) > 0).withColumn("_share", F.col(successes).cast("double") / F.col(trials))
    fit = glm(d, "_share", features, "binomial", link, weight=trials)
    fit.target = successes
    return fit


def prior_correct(fit: DiscreteFit, sample_share: float, pop_share: float) -> DiscreteFit:
    """Rare-event intercept correction by the log prior odds ratio."""
    th = fit.theta.copy()
    th[0] -= math.log((sample_share / (1 - sample_share)) * ((1 - pop_share) / pop_share))
    out = DiscreteFit(**{**fit.__dict__, "theta": th})
    return out


# ------------------------------------------------------------ ordered
def ordered(df: DataFrame, y: str, features: list[str], link: str = "logit",
            max_iter: int = 200, tol: float = 1e-10) -> DiscreteFit:
    """Ordered logit / probit, P(Y <= j) = F(tau_j - x'beta), no constant."""
    require(df, [y] + list(features))
    code, labels = class_codes(df, y)
    J = len(labels)
    if J < 2:
        raise ValueError("ordered model needs at least two levels")
    data = (_project(df, y, features).withColumn("_y", code).select("_y", *features)
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        counts = {r["_y"]: r["c"] for r in data.groupBy("_y").agg(F.count(F.lit(1)).alias("c")).collect()}
        n = sum(counts.values())
        check_nonempty(n, "training data after dropping NA")
        cum = np.cumsum([counts.get(j, 0) for j in range(J)]) / n
        if link == "logit":
            cdf, pdf = logistic, (lambda z: logistic(z) * (F.lit(1.0) - logistic(z)))

            def dpdf(z):
                p = logistic(z)
                return p * (F.lit(1.0) - p) * (F.lit(1.0) - F.lit(2.0) * p)
            tau0 = [math.log(c / (1 - c)) for c in cum[:-1]]
        else:
            cdf, pdf = norm_cdf, norm_pdf

            def dpdf(z):
                return -z * norm_pdf(z)
            tau0 = [dist.norm_ppf(c) for c in cum[:-1]]
        kx = len(features)
        xs = [F.col(c).cast("double") for c in features]
        yv = F.col("_y")
        P = kx + J - 1

        def build(theta):
            beta, tau = theta[:kx], theta[kx:]
            xb = lit_dot(beta, xs) if kx else F.lit(0.0)
            top = yv == F.lit(J - 1)
            bot = yv == F.lit(0)
            up_tau = F.lit(0.0)
            lo_tau = F.lit(0.0)
            for j in range(J - 1):
                up_tau = F.when(yv == F.lit(j), F.lit(float(tau[j]))).otherwise(up_tau)
                lo_tau = F.when(yv == F.lit(j + 1), F.lit(float(tau[j]))).otherwise(lo_tau)
            a, b = F.col("_a"), F.col("_b")
            l1 = {"_a": up_tau - xb, "_b": lo_tau - xb}
            l2 = {"_cdfa": F.when(top, F.lit(1.0)).otherwise(cdf(a)),
                  "_cdfb": F.when(bot, F.lit(0.0)).otherwise(cdf(b)),
                  "_fa": F.when(top, F.lit(0.0)).otherwise(pdf(a)),
                  "_fb": F.when(bot, F.lit(0.0)).otherwise(pdf(b)),
                  "_dfa": F.when(top, F.lit(0.0)).otherwise(dpdf(a)),
                  "_dfb": F.when(bot, F.lit(0.0)).otherwise(dpdf(b))}
            l3 = {"_p": F.greatest(F.col("_cdfa") - F.col("_cdfb"), F.lit(1e-300))}
            fa, fb, dfa, dfb, prob = (F.col(c) for c in ("_fa", "_fb", "_dfa", "_dfb", "_p"))
            ga = [-x for x in xs] + [(yv == F.lit(j)).cast("double") for j in range(J - 1)]
            gb = [-x for x in xs] + [(yv == F.lit(j + 1)).cast("double") for j in range(J - 1)]
            dP = [fa * ga[p] - fb * gb[p] for p in range(P)]
            grad = [dP[p] / prob for p in range(P)]
            hess = [[(dfa * ga[p] * ga[q] - dfb * gb[p] * gb[q]) / prob - dP[p] * dP[q] / (prob * prob)
                     for q in range(P)] for p in range(P)]
            return [l1, l2, l3], F.log(prob), grad, hess

        theta0 = np.array([0.0] * kx + tau0)
        res = newton(data, build, theta0, max_iter=max_iter, tol=tol)
        cov = np.linalg.inv(-res.hess)
        llnull = float(sum(c * math.log(c / n) for c in counts.values() if c > 0))
        terms = list(features) + [f"cut_{labels[j]}|{labels[j + 1]}" for j in range(J - 1)]
        fit = DiscreteFit(f"ordered_{link}", terms, res.theta, cov, res.llf, llnull, res.n, J,
                          res.converged, res.iterations, list(features), y, labels,
                          extra={"null_k": J - 1})
        if J > 20:
            fit.warnings.append(f"{J} classes (> 20)")
        return fit
    finally:
        data.unpersist()


# -------------------------------------------------------- multinomial
def mnlogit(df: DataFrame, y: str, features: list[str], max_iter: int = 100, tol: float = 1e-10) -> DiscreteFit:
    """Multinomial logit, first sorted class is the base; K-1 coefficient blocks."""
    require(df, [y] + list(features))
    code, labels = class_codes(df, y)
    K = len(labels)
    if K < 2:
        raise ValueError("multinomial model needs at least two classes")
    if (K - 1) * (len(features) + 1) > 2000:
        raise ValueError("too many parameters for the multinomial Hessian")
    data = (_project(df, y, features).withColumn("_y", code).select("_y", *features)
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        counts = {r["_y"]: r["c"] for r in data.groupBy("_y").agg(F.count(F.lit(1)).alias("c")).collect()}
        n = sum(counts.values())
        check_nonempty(n, "training data after dropping NA")
        xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
        k = len(xs)
        yv = F.col("_y")
        M = K - 1

        def build(theta):
            B = theta.reshape(M, k)
            l1 = {f"_e{c}": lit_dot(B[c], xs) for c in range(M)}
            etas = [F.col(f"_e{c}") for c in range(M)]
            l2 = {"_mx": F.greatest(F.lit(0.0), *etas) if M > 1 else F.greatest(F.lit(0.0), etas[0])}
            mx = F.col("_mx")
            l3 = {f"_x{c}": F.exp(etas[c] - mx) for c in range(M)}
            ex = [F.col(f"_x{c}") for c in range(M)]
            den = F.exp(-mx)
            for e in ex:
                den = den + e
            l4 = {"_den": den}
            den = F.col("_den")
            l5 = {f"_q{c}": ex[c] / den for c in range(M)}
            probs = [F.col(f"_q{c}") for c in range(M)]
            ind = [(yv == F.lit(c + 1)).cast("double") for c in range(M)]
            eta_y = F.lit(0.0)
            for c in range(M):
                eta_y = F.when(yv == F.lit(c + 1), etas[c]).otherwise(eta_y)
            ll = eta_y - (mx + F.log(den))
            grad = [(ind[c] - probs[c]) * xs[j] for c in range(M) for j in range(k)]
            hess = []
            for c in range(M):
                for i in range(k):
                    row = []
                    for d in range(M):
                        pcd = probs[c] * ((F.lit(1.0) if c == d else F.lit(0.0)) - probs[d])
                        for j in range(k):
                            row.append(-(pcd * xs[i] * xs[j]))
                    hess.append(row)
            return [l1, l2, l3, l4, l5], ll, grad, hess

        theta0 = np.zeros(M * k)
        base = counts.get(0, 0)
        for c in range(M):
            if counts.get(c + 1, 0) > 0 and base > 0:
                theta0[c * k] = math.log(counts[c + 1] / base)
        res = newton(data, build, theta0, max_iter=max_iter, tol=tol)
        cov = np.linalg.inv(-res.hess)
        llnull = float(sum(c * math.log(c / n) for c in counts.values() if c > 0))
        terms = [f"{labels[c + 1]}:{t}" for c in range(M) for t in [CONST] + list(features)]
        fit = DiscreteFit("mnlogit", terms, res.theta, cov, res.llf, llnull, res.n, K, res.converged,
                          res.iterations, list(features), y, labels, extra={"null_k": M})
        if K > 20:
            fit.warnings.append(f"{K} classes (> 20)")
        return fit
    finally:
        data.unpersist()


def class_probabilities(fit: DiscreteFit) -> Column:
    """Array column of K class probabilities for ordered / multinomial fits."""
    feats = fit.features
    xs = [F.col(c).cast("double") for c in feats]
    if fit.family.startswith("ordered"):
        cdf = logistic if fit.family.endswith("logit") else norm_cdf
        kx = len(feats)
        xb = lit_dot(fit.theta[:kx], xs) if kx else F.lit(0.0)
        cum = [cdf(F.lit(float(t)) - xb) for t in fit.theta[kx:]]
        probs = [cum[0]] + [cum[j] - cum[j - 1] for j in range(1, len(cum))] + [F.lit(1.0) - cum[-1]]
        return F.array(*probs)
    if fit.family == "mnlogit":
        k = len(feats) + 1
        M = fit.n_classes - 1
        B = fit.theta.reshape(M, k)
        etas = [lit_dot(B[c], [F.lit(1.0)] + xs) for c in range(M)]
        # p_k = 1 / sum_j exp(eta_j - eta_k): an overflowing term makes the share 0, never NaN
        etas = [F.lit(0.0)] + etas
        probs = []
        for k_ in etas:
            den = F.lit(0.0)
            for e in etas:
                den = den + (F.lit(1.0) if e is k_ else F.exp(e - k_))
            probs.append(F.lit(1.0) / den)
        return F.array(*probs)
    p = probability(fit)
    return F.array(F.lit(1.0) - p, p)


def probability(fit: DiscreteFit) -> Column:
    """Mean response of a single-index model (link inverse of x'beta)."""
    return inverse_link(fit)(fit.linear_predictor())


def inverse_link(fit: DiscreteFit):
    """The fit's inverse link as a function of a column (by family where no link is kept)."""
    link = fit.link or (fit.family if fit.family in ("logit", "probit", "cloglog") else
                        "log" if fit.family in ("poisson", "negbin", "gamma", "inverse_gaussian") else "identity")
    return {"logit": logistic, "probit": norm_cdf, "cloglog": lambda e: F.lit(1.0) - F.exp(-F.exp(e)), "log": F.exp,
            "inverse": lambda e: F.lit(1.0) / e, "identity": lambda e: e}[link]



# ------------------------------------------------------- conditional logit
def clogit(df: DataFrame, y: str, features: list[str], strata: str, max_iter: int = 50, tol: float = 1e-10) -> DiscreteFit:
    """Conditional logit on matched strata by the exact conditional likelihood, with any number
    of cases per stratum (:mod:`.condlogit`). Strata without contrast (no case, or only cases)
    carry no information and are left out."""
    from .condlogit import fit_exact
    r = fit_exact(_project(df, y, features, [strata]), y, features, strata, max_iter, tol)
    return DiscreteFit("clogit", list(features), r["theta"], r["cov"], r["llf"], r["ll0"], r["strata"], 2, r["converged"], r["iterations"],
                       list(features), y, extra={"null_k": 0, "strata": r["strata"]})


def clogit_breslow(df: DataFrame, y: str, features: list[str], strata: str, max_iter: int = 50, tol: float = 1e-10) -> DiscreteFit:
    """Conditional logit with Breslow's approximation for strata with several cases (exact for one),
    by grouped sums alone. Features are centred at their means, which changes nothing but the
    size of the exponentials.

    Each iteration: per-stratum sums of exp(x'b), exp(x'b) x, exp(x'b) x x' and of the
    case rows (``groupBy(strata)``, partial aggregation, so a large stratum costs no
    more than many small ones), then one aggregate of the stratum contributions.
    """
    data = _project(df, y, features, [strata]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        k = len(features)
        mean = data.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(features)]).first()
        xs = [F.col(c).cast("double") - F.lit(float(mean[f"_m{i}"] or 0.0)) for i, c in enumerate(features)]
        yc = F.col(y).cast("double")

        def step(theta):
            eta = lit_dot(theta, xs)
            d = data.withColumn("_e", F.exp(eta)).withColumn("_eta", eta)
            g = d.groupBy(strata).agg(
                F.sum("_e").alias("_cl_S"), F.sum(yc).alias("_cl_ncase"), F.count(F.lit(1)).alias("_cl_n"), F.sum(yc * F.col("_eta")).alias("_cl_ceta"),
                *[F.sum(F.col("_e") * x).alias(f"_cl_S{i}") for i, x in enumerate(xs)],
                *[F.sum(yc * x).alias(f"_cl_C{i}") for i, x in enumerate(xs)],
                *[F.sum(F.col("_e") * xs[i] * xs[j]).alias(f"_cl_S{i}_{j}") for i in range(k) for j in range(i, k)])
            S = F.col("_cl_S")
            aggs = [F.count(F.lit(1)).alias("_n"), F.sum(F.col("_cl_ceta") - F.col("_cl_ncase") * F.log(S)).alias("_l")]
            aggs += [F.sum(F.col(f"_cl_C{i}") - F.col("_cl_ncase") * F.col(f"_cl_S{i}") / S).alias(f"_g{i}") for i in range(k)]
            aggs += [F.sum(-F.col("_cl_ncase") * (F.col(f"_cl_S{i}_{j}") / S - F.col(f"_cl_S{i}") * F.col(f"_cl_S{j}") / (S * S))
                           ).alias(f"_h{i}_{j}") for i in range(k) for j in range(i, k)]
            r = g.where((F.col("_cl_ncase") > 0) & (F.col("_cl_ncase") < F.col("_cl_n"))).agg(*aggs).collect()[0]
            gr = np.array([r[f"_g{i}"] for i in range(k)], dtype=float)
            h = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    h[i, j] = h[j, i] = r[f"_h{i}_{j}"]
            return float(r["_l"]), gr, h, int(r["_n"])

        theta = np.zeros(k)
        llf, g, h, ns = step(theta)
        ll0 = llf
        converged, it = False, 0
        for it in range(1, max_iter + 1):
            st = np.linalg.solve(-h, g)
            t = 1.0
            while True:
                cand = theta + t * st
                l2, g2, h2, _ = step(cand)
                if l2 >= llf - 1e-12 * abs(llf) or t < 1e-8:
                    break
                t /= 2
            delta = np.max(np.abs(cand - theta))
            theta, llf, g, h = cand, l2, g2, h2
            if delta < tol * (1 + np.max(np.abs(theta))):
                converged = True
                break
        cov = np.linalg.inv(-h)
        return DiscreteFit("clogit", list(features), theta, cov, llf, ll0, ns, 2, converged, it, list(features), y,
                           extra={"null_k": 0, "strata": ns})
    finally:
        data.unpersist()


# ------------------------------------------------------- Tobit / Heckman
def tobit(df: DataFrame, y: str, features: list[str], lower: float | None = 0.0, upper: float | None = None,
          max_iter: int = 100, tol: float = 1e-10) -> DiscreteFit:
    """Censored-normal regression by Newton on (beta, log sigma); one aggregate per step."""
    data = _project(df, y, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
        k = len(xs)
        yc = F.col(y).cast("double")
        lo = yc <= F.lit(lower) if lower is not None else F.lit(False)
        hi = yc >= F.lit(upper) if upper is not None else F.lit(False)
        from .linear import ols
        start = ols(data, y, list(features))
        theta0 = np.concatenate([start.beta, [0.5 * math.log(start.sigma2)]])

        def build(theta):
            b, ls = theta[:k], theta[k]
            s = math.exp(ls)
            xb = lit_dot(b, xs)
            l1 = {"_xb": xb}
            xbc = F.col("_xb")
            zl = (F.lit(lower if lower is not None else 0.0) - xbc) / F.lit(s)
            zu = (xbc - F.lit(upper if upper is not None else 0.0)) / F.lit(s)
            zo = (yc - xbc) / F.lit(s)
            # d l / d xb (u), -d2 l / d xb2 (w), d l / d log s (v) and second derivatives by case
            lam_l = norm_pdf(zl) / norm_cdf(zl)
            lam_u = norm_pdf(zu) / norm_cdf(zu)
            l2 = {"_case": F.when(lo, 0).when(hi, 2).otherwise(1),
                  "_z": F.when(lo, zl).when(hi, zu).otherwise(zo),
                  "_lam": F.when(lo, lam_l).when(hi, lam_u).otherwise(F.lit(0.0)),
                  "_ll": F.when(lo, F.log(norm_cdf(zl))).when(hi, F.log(norm_cdf(zu)))
                  .otherwise(-F.lit(0.5 * math.log(2 * math.pi)) - zo * zo / 2 - F.lit(ls))}
            z, lam, case = F.col("_z"), F.col("_lam"), F.col("_case")
            sl = F.lit(s)
            # censored below: l = ln Phi(z), z = (lo - xb)/s; censored above: z = (xb - up)/s
            dz_dxb = F.when(case == 0, -F.lit(1.0) / sl).when(case == 2, F.lit(1.0) / sl).otherwise(-F.lit(1.0) / sl)
            u = F.when(case == 1, z / sl).otherwise(lam * dz_dxb)
            v = F.when(case == 1, z * z - F.lit(1.0)).otherwise(-lam * z)
            # second derivatives: dlam/dz = -lam (z + lam)
            dl = -lam * (z + lam)
            uu = F.when(case == 1, -F.lit(1.0) / (sl * sl)).otherwise(dl / (sl * sl))
            uv = F.when(case == 1, -F.lit(2.0) * z / sl).otherwise((lam * F.lit(1.0) + dl * z) * dz_dxb * F.lit(-1.0))
            vv = F.when(case == 1, -F.lit(2.0) * z * z).otherwise(lam * z + dl * z * z)
            l3 = {"_u": u, "_v": v, "_uu": uu, "_uv": uv, "_vv": vv}
            U, V, UU, UV, VV = (F.col(c) for c in ("_u", "_v", "_uu", "_uv", "_vv"))
            grad = [U * x for x in xs] + [V]
            hess = [[UU * xs[i] * xs[j] for j in range(k)] + [UV * xs[i]] for i in range(k)]
            hess.append([UV * xs[j] for j in range(k)] + [VV])
            return [l1, l2, l3], F.col("_ll"), grad, hess

        res = newton(data, build, theta0, max_iter=max_iter, tol=tol)
        cov = np.linalg.inv(-res.hess)
        fit = DiscreteFit("tobit", [CONST] + list(features) + ["log_sigma"], res.theta, cov, res.llf, float("nan"),
                          res.n, 0, res.converged, res.iterations, list(features), y)
        fit.extra["sigma"] = math.exp(res.theta[-1])
        return fit
    finally:
        data.unpersist()


def heckman(df: DataFrame, y: str, features: list[str], selected: str, sel_features: list[str]) -> dict:
    """Heckman two-step: probit for selection, inverse Mills ratio as a column, OLS on the
    selected rows. The covariance of the second step counts the estimation of the first: the scores of
    both steps are stacked, their Gram and the cross Jacobian come from one aggregate over all rows, and the
    sandwich A^-1 B A^-T has the block-triangular A of a two-step estimate. ``y`` and the outcome
    features may be null where a row is not selected."""
    from .linear import ols
    sel = probit(df, selected, sel_features)
    ws = [F.lit(1.0)] + [F.col(c).cast("double") for c in sel_features]
    pick = F.col(selected).cast("double") == 1.0
    rows = df.dropna(subset=[selected, *sel_features]).withColumn("_z", lit_dot(sel.theta, ws))
    rows = rows.withColumn("_imr", norm_pdf("_z") / norm_cdf("_z"))
    out = ols(rows.where(pick), y, list(features) + ["_imr"])

    complete = pick & F.col(y).isNotNull()
    for c in features:
        complete = complete & F.col(c).isNotNull()
    xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in features] + [F.col("_imr")]
    slope = float(out.beta[-1])
    d = rows.withColumns({"_s": F.when(pick, F.col("_imr")).otherwise(-norm_pdf("_z") / norm_cdf(-F.col("_z"))),
                          "_e": F.when(complete, F.col(y).cast("double") - lit_dot(out.beta, xs)).otherwise(0.0),
                          "_delta": F.when(complete, F.col("_imr") * (F.col("_imr") + F.col("_z"))).otherwise(0.0)})
    kw, kx = len(ws), len(xs)
    psi = [F.col("_s") * w for w in ws] + [F.when(complete, F.col("_e") * x).otherwise(0.0) for x in xs]
    n = kw + kx
    aggs = [F.sum(psi[i] * psi[j]).alias(f"b{i}_{j}") for i in range(n) for j in range(i, n)]
    # derivative of the outcome scores by the selection coefficients: the Mills ratio moves by -delta w
    own = [F.when(complete, F.lit(slope) * x).otherwise(0.0) * F.col("_delta") for x in xs]
    own[-1] = own[-1] - F.col("_e") * F.col("_delta")
    aggs += [F.sum(own[i] * ws[j]).alias(f"c{i}_{j}") for i in range(kx) for j in range(kw)]
    r = d.agg(*aggs, F.sum("_delta").alias("delta")).first()
    b = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            b[i, j] = b[j, i] = r[f"b{i}_{j}"]
    a = np.zeros((n, n))
    a[:kw, :kw] = np.linalg.inv(sel.cov)
    a[kw:, kw:] = np.linalg.inv(out.bread)
    a[kw:, :kw] = -np.array([[r[f"c{i}_{j}"] for j in range(kw)] for i in range(kx)])
    inv = np.linalg.inv(a)
    out.cov = (inv @ b @ inv.T)[kw:, kw:]
    out.se_type = "two-step"
    sigma = math.sqrt(max((out.ssr + slope * slope * r["delta"]) / out.n, 0.0))
    return {"selection": sel, "outcome": out, "lambda": slope, "lambda_se": out.se[-1], "sigma": sigma, "rho": slope / sigma if sigma else math.nan}


# ------------------------------------------------- generalised ordered logit
def gologit(df: DataFrame, y: str, features: list[str], free: list[str], link: str = "logit",
            max_iter: int = 200, tol: float = 1e-10) -> DiscreteFit:
    """Partial proportional odds -- features in ``free`` get one coefficient per cutpoint;
    P(Y <= j) = F(tau_j - x_c'b_c - x_f'b_{f,j})."""
    code, labels = class_codes(df, y)
    J = len(labels)
    common = [c for c in features if c not in free]
    data = (_project(df, y, features).withColumn("_y", code).select("_y", *features)
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        counts = {r["_y"]: r["c"] for r in data.groupBy("_y").agg(F.count(F.lit(1)).alias("c")).collect()}
        n = sum(counts.values())
        cum = np.cumsum([counts.get(j, 0) for j in range(J)]) / n
        cdf = logistic if link == "logit" else norm_cdf
        if link == "logit":
            def pdf(z):
                p = logistic(z)
                return p * (F.lit(1.0) - p)

            def dpdf(z):
                p = logistic(z)
                return p * (F.lit(1.0) - p) * (F.lit(1.0) - F.lit(2.0) * p)
            tau0 = [math.log(c / (1 - c)) for c in cum[:-1]]
        else:
            pdf = norm_pdf

            def dpdf(z):
                return -z * norm_pdf(z)
            tau0 = [dist.norm_ppf(c) for c in cum[:-1]]
        xc = [F.col(c).cast("double") for c in common]
        xf = [F.col(c).cast("double") for c in free]
        kc, kf = len(xc), len(xf)
        yv = F.col("_y")
        P = kc + kf * (J - 1) + (J - 1)

        def build(theta):
            bc = theta[:kc]
            bf = theta[kc:kc + kf * (J - 1)].reshape(J - 1, kf) if kf else np.zeros((J - 1, 0))
            tau = theta[kc + kf * (J - 1):]
            xbc = lit_dot(bc, xc) if kc else F.lit(0.0)
            up = F.lit(0.0)
            lo = F.lit(0.0)
            for j in range(J - 1):
                idx_j = F.lit(float(tau[j])) - (lit_dot(bf[j], xf) if kf else F.lit(0.0))
                up = F.when(yv == F.lit(j), idx_j).otherwise(up)
                lo = F.when(yv == F.lit(j + 1), idx_j).otherwise(lo)
            top, bot = yv == F.lit(J - 1), yv == F.lit(0)
            l1 = {"_a": up - xbc, "_b": lo - xbc}
            a, b = F.col("_a"), F.col("_b")
            l2 = {"_cdfa": F.when(top, F.lit(1.0)).otherwise(cdf(a)), "_cdfb": F.when(bot, F.lit(0.0)).otherwise(cdf(b)),
                  "_fa": F.when(top, F.lit(0.0)).otherwise(pdf(a)), "_fb": F.when(bot, F.lit(0.0)).otherwise(pdf(b)),
                  "_dfa": F.when(top, F.lit(0.0)).otherwise(dpdf(a)), "_dfb": F.when(bot, F.lit(0.0)).otherwise(dpdf(b))}
            l3 = {"_p": F.greatest(F.col("_cdfa") - F.col("_cdfb"), F.lit(1e-300))}
            fa, fb, dfa, dfb, prob = (F.col(c) for c in ("_fa", "_fb", "_dfa", "_dfb", "_p"))
            ga = [-x for x in xc]
            gb = [-x for x in xc]
            for j in range(J - 1):
                ga += [F.when(yv == F.lit(j), -x).otherwise(F.lit(0.0)) for x in xf]
                gb += [F.when(yv == F.lit(j + 1), -x).otherwise(F.lit(0.0)) for x in xf]
            ga += [(yv == F.lit(j)).cast("double") for j in range(J - 1)]
            gb += [(yv == F.lit(j + 1)).cast("double") for j in range(J - 1)]
            dP = [fa * ga[p] - fb * gb[p] for p in range(P)]
            grad = [dP[p] / prob for p in range(P)]
            hess = [[(dfa * ga[p] * ga[q] - dfb * gb[p] * gb[q]) / prob - dP[p] * dP[q] / (prob * prob)
                     for q in range(P)] for p in range(P)]
            return [l1, l2, l3], F.log(prob), grad, hess

        theta0 = np.array([0.0] * (kc + kf * (J - 1)) + tau0)
        res = newton(data, build, theta0, max_iter=max_iter, tol=tol)
        cov = np.linalg.inv(-res.hess)
        llnull = float(sum(c * math.log(c / n) for c in counts.values() if c > 0))
        terms = list(common) + [f"{c}@{labels[j]}|{labels[j + 1]}" for j in range(J - 1) for c in free] + \
            [f"cut_{labels[j]}|{labels[j + 1]}" for j in range(J - 1)]
        return DiscreteFit(f"gologit_{link}", terms, res.theta, cov, res.llf, llnull, res.n, J, res.converged,
                           res.iterations, list(features), y, labels, extra={"null_k": J - 1})
    finally:
        data.unpersist()


# ------------------------------------------------------- zero-inflated Poisson
def zip_poisson(df: DataFrame, y: str, features: list[str], inflate: list[str], max_em: int = 200,
                tol: float = 1e-9) -> dict:
    """Zero-inflated Poisson by EM. E-step: posterior structural-zero share as a
    column; M-step: fractional logit on the inflation design and weighted Poisson on
    the count design (each a Newton fit of one aggregate per step)."""
    data = _project(df, y, list(dict.fromkeys(list(features) + list(inflate)))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yc = F.col(y).cast("double")
        pz = glm(data, y, features, "poisson", "log", null_model=False, persist=False)
        share0 = data.agg(F.avg((yc == 0).cast("double"))).collect()[0][0]
        gam = np.zeros(len(inflate) + 1)
        gam[0] = math.log(max(share0, 1e-6) / max(1 - share0, 1e-6)) - 1.0
        beta = pz.theta
        prev = -math.inf
        llf = prev
        for it in range(1, max_em + 1):
            mu = F.exp(lit_dot(beta, [F.lit(1.0)] + [F.col(c).cast("double") for c in features]))
            pi = logistic(lit_dot(gam, [F.lit(1.0)] + [F.col(c).cast("double") for c in inflate]))
            tau = F.when(yc == 0, pi / (pi + (F.lit(1.0) - pi) * F.exp(-mu))).otherwise(F.lit(0.0))
            ll = F.when(yc == 0, F.log(pi + (F.lit(1.0) - pi) * F.exp(-mu))).otherwise(
                F.log(F.lit(1.0) - pi) + yc * F.log(mu) - mu - lgamma_col(yc + F.lit(1.0)))
            e = data.withColumn("_tau", tau).withColumn("_w", F.lit(1.0) - F.col("_tau"))
            llf = float(e.agg(F.sum(ll)).collect()[0][0])
            if abs(llf - prev) < tol * (1 + abs(llf)):
                break
            prev = llf
            gfit = glm(e.withColumn("_tau", F.least(F.greatest("_tau", F.lit(1e-12)), F.lit(1 - 1e-12))),
                       "_tau", list(inflate), "binomial", "logit", theta0=gam, persist=False)
            pfit = glm(e.where(F.col("_w") > 1e-12), y, list(features), "poisson", "log", weight="_w",
                       theta0=beta, null_model=False, persist=False)
            gam, beta = gfit.theta, pfit.theta
        return {"count_terms": [CONST] + list(features), "count_coef": beta, "inflate_terms": [CONST] + list(inflate),
                "inflate_coef": gam, "llf": llf, "iterations": it}
    finally:
        data.unpersist()
