"""Linear models on the GRAM pattern: OLS, WLS, GLS-AR(1), robust and
clustered inference, segmented fits (R1-R12)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.columns import sig
from ..functions.linalg import sym_inv
from ..plans.autocov import bartlett, weighted_products
from ..plans.gram import Moments, gram, group_shrunk_moments, grouped_gram, moments_from_row
from ..plans.order import GlobalOrder, check_unique, series_lags
from ..sources.scan import check_nonempty, require_numeric

CONST = "const"

COEF_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("coefficient", T.DoubleType()),
    T.StructField("se", T.DoubleType()), T.StructField("t_stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("ci_lower", T.DoubleType()),
    T.StructField("ci_upper", T.DoubleType())])

STAT_SCHEMA = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


@dataclass
class LinearFit:
    target: str
    features: list[str]
    beta: np.ndarray
    bread: np.ndarray           # (X'WX)^-1 over [const] + features
    cov: np.ndarray
    n: int
    ssr: float
    sst: float
    se_type: str = "nonrobust"
    algorithm: str = "ols"
    weight: str | None = None
    slogw: float = 0.0
    moments: Moments | None = None
    rho: float | None = None
    warnings: list[str] = field(default_factory=list)

    # -------------------------------------------------------- basics
    @property
    def terms(self) -> list[str]:
        return [CONST] + list(self.features)

    @property
    def k(self) -> int:
        return len(self.beta)

    @property
    def df_resid(self) -> int:
        return self.n - self.k

    @property
    def use_t(self) -> bool:
        return self.se_type == "nonrobust"

    @property
    def sigma2(self) -> float:
        return self.ssr / self.df_resid if self.df_resid > 0 else math.nan

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    @property
    def r2(self) -> float:
        return 1.0 - self.ssr / self.sst if self.sst > 0 else math.nan

    @property
    def adj_r2(self) -> float:
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / self.df_resid if self.df_resid > 0 else math.nan

    @property
    def llf(self) -> float:
        n = self.n
        return -n / 2.0 * (math.log(2 * math.pi) + math.log(self.ssr / n) + 1.0) + 0.5 * self.slogw

    @property
    def aic(self) -> float:
        return -2 * self.llf + 2 * self.k

    @property
    def bic(self) -> float:
        return -2 * self.llf + self.k * math.log(self.n)

    def f_test(self) -> tuple[float, float]:
        q = self.k - 1
        if q <= 0 or self.df_resid <= 0:
            return math.nan, math.nan
        if self.use_t:
            r2 = self.r2
            f = (r2 / q) / ((1 - r2) / self.df_resid) if r2 < 1 else math.inf
        else:
            b = self.beta[1:]
            v = self.cov[1:, 1:]
            f = float(b @ np.linalg.solve(v, b)) / q
        return f, dist.f_sf(f, q, self.df_resid)

    @property
    def confidence(self) -> float:
        c = 0.5 + min(0.20, 0.05 * self.n ** 0.3) + min(0.15, 0.15 * max(self.r2, 0.0))
        return round(min(1.0, max(0.0, c)), 4)

    # --------------------------------------------------------- tables
    def coef_rows(self, alpha: float = 0.05) -> list[tuple]:
        crit = dist.t_ppf(1 - alpha / 2, self.df_resid) if self.use_t else dist.norm_ppf(1 - alpha / 2)
        rows = []
        for name, b, s in zip(self.terms, self.beta, self.se):
            t = b / s if s > 0 else math.nan
            p = dist.t_two_sided_p(t, self.df_resid) if self.use_t else 2 * dist.norm_sf(abs(t))
            rows.append((name, sig(b), sig(s), sig(t), sig(p), sig(b - crit * s), sig(b + crit * s)))
        return rows

    def coefficients(self, spark: SparkSession, alpha: float = 0.05) -> DataFrame:
        return spark.createDataFrame(self.coef_rows(alpha), COEF_SCHEMA)

    def stat_rows(self) -> list[tuple]:
        f, fp = self.f_test()
        vals = [("r_squared", self.r2), ("adj_r_squared", self.adj_r2), ("f_stat", f),
                ("f_pvalue", fp), ("aic", self.aic), ("bic", self.bic),
                ("log_likelihood", self.llf), ("n_obs", float(self.n)),
                ("n_features", float(self.k)), ("sigma2", self.sigma2),
                ("confidence", self.confidence)]
        if self.rho is not None:
            vals.append(("rho", self.rho))
        return [(m, sig(v)) for m, v in vals]

    def fit_stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stat_rows(), STAT_SCHEMA)

    # ---------------------------------------------------- scoring
    def linear_predictor(self, features: list[str] | None = None) -> Column:
        """SCORE: const + sum beta_j * x_j as a pure column expression."""
        feats = features or self.features
        out = F.lit(float(self.beta[0]))
        for b, c in zip(self.beta[1:], feats):
            out = out + F.lit(float(b)) * F.col(c).cast("double")
        return out

    def residual(self) -> Column:
        return F.col(self.target).cast("double") - self.linear_predictor()

    def leverage(self, weight: Column | None = None) -> Column:
        """h = w x'(X'WX)^-1 x as a quadratic form with literal coefficients."""
        x = [F.lit(1.0)] + [F.col(c).cast("double") for c in self.features]
        h = None
        for i in range(self.k):
            for j in range(i, self.k):
                coef = self.bread[i, j] * (1 if i == j else 2)
                term = F.lit(float(coef)) * x[i] * x[j]
                h = term if h is None else h + term
        return h * weight if weight is not None else h

    def mean_se(self) -> Column:
        """sqrt(x' V x) for a new row (prediction of the mean)."""
        x = [F.lit(1.0)] + [F.col(c).cast("double") for c in self.features]
        q = None
        for i in range(self.k):
            for j in range(i, self.k):
                coef = self.cov[i, j] * (1 if i == j else 2)
                term = F.lit(float(coef)) * x[i] * x[j]
                q = term if q is None else q + term
        return F.sqrt(F.greatest(q, F.lit(0.0)))


# ------------------------------------------------------------ fitting
def design(df: DataFrame, target: str, features: list[str], weight: str | None = None,
           extra: list[str] | None = None) -> DataFrame:
    """F1 + F3: project target, features (and weight/extra) and drop rows with null/NaN."""
    cols = [target] + list(features) + ([weight] if weight else [])
    require_numeric(df, cols, "training data")
    keep = cols + [c for c in (extra or []) if c not in cols]
    return df.select(*keep).dropna(subset=cols)


def solve_moments(mom: Moments, target: str, features: list[str]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Beta, bread (X'WX)^-1, SSR, centred SST from centred moments."""
    ybar = mom.mean([target])[0]
    cyy = mom.centered([target])[0, 0]
    if features:
        cxx = mom.centered(features)
        cxy = mom.centered(features, [target])[:, 0]
        ci = sym_inv(cxx, features)
        b = ci @ cxy
        xbar = mom.mean(features)
        b0 = ybar - xbar @ b
        k = len(features) + 1
        bread = np.empty((k, k))
        cix = ci @ xbar
        bread[0, 0] = 1.0 / mom.sw + xbar @ cix
        bread[0, 1:] = bread[1:, 0] = -cix
        bread[1:, 1:] = ci
        beta = np.concatenate([[b0], b])
        ssr = cyy - b @ cxy
    else:
        beta = np.array([ybar])
        bread = np.array([[1.0 / mom.sw]])
        ssr = cyy
    return beta, bread, max(float(ssr), 0.0), float(cyy)


def ols(df: DataFrame, target: str, features: list[str], weight: str | None = None,
        se_type: str = "nonrobust", cluster: str | None = None, order_by=None,
        maxlags: int = 1) -> LinearFit:
    """OLS or WLS with classical, HC0-3, HAC or cluster SE."""
    se_type = {"huber-white": "HC1", "robust": "HC1", "homoskedastic": "nonrobust"}.get(se_type, se_type)
    extra = ([cluster] if cluster else []) + (list(order_by) if isinstance(order_by, (list, tuple))
                                              else [order_by] if order_by else [])
    data = design(df, target, features, weight, extra)
    if weight:
        data = data.where(F.col(weight) > 0)
    mom = gram(data, list(features) + [target], weight=weight)
    check_nonempty(mom.n, "training data after dropping NA")
    beta, bread, ssr, sst = solve_moments(mom, target, features)
    fit = LinearFit(target, list(features), beta, bread, bread * 0, mom.n, ssr, sst,
                    se_type=se_type, algorithm="wls" if weight else "ols", weight=weight,
                    slogw=mom.slogw, moments=mom)
    if fit.n < 3 * fit.k:
        fit.warnings.append(f"{fit.n} rows for {fit.k} coefficients: fewer than three per coefficient.")
    fit.cov = fit.sigma2 * bread
    if se_type != "nonrobust":
        fit.cov = robust_cov(data, fit, se_type, cluster=cluster, order_by=order_by, maxlags=maxlags)
    return fit


def _score_parts(fit: LinearFit) -> tuple[list[Column], Column]:
    """Whitened regressors and residual: sqrt(w) x, sqrt(w) e."""
    sw = F.sqrt(F.col(fit.weight).cast("double")) if fit.weight else F.lit(1.0)
    x = [sw] + [sw * F.col(c).cast("double") for c in fit.features]
    return x, sw * fit.residual()


def _meat_from(m: Moments, k: int) -> np.ndarray:
    return m.m[:k, :k]


def robust_cov(data: DataFrame, fit: LinearFit, se_type: str, cluster: str | None = None,
               order_by=None, maxlags: int = 1) -> np.ndarray:
    """SANDWICH: one more GRAM-shaped pass over weighted residual products."""
    x, e = _score_parts(fit)
    k, n = fit.k, fit.n
    st = se_type.upper()
    if st in ("HC0", "HC1", "HC2", "HC3"):
        e2 = e * e
        if st in ("HC2", "HC3"):
            h = fit.leverage(F.col(fit.weight).cast("double") if fit.weight else None)
            e2 = e2 / (F.lit(1.0) - h) if st == "HC2" else e2 / ((F.lit(1.0) - h) * (F.lit(1.0) - h))
        m = gram(data, x, weight=e2, logw=False)
        meat = _meat_from(m, k)
        cov = fit.bread @ meat @ fit.bread
        return cov * (n / (n - k)) if st == "HC1" else cov
    if st == "CLUSTER":
        if not cluster:
            raise ValueError("cluster-robust SE needs a cluster column")
        scores = data.groupBy(cluster).agg(*[F.sum(xi * e).alias(f"u{j}") for j, xi in enumerate(x)])
        m = gram(scores, [f"u{j}" for j in range(k)])
        g = m.n
        meat = m.m
        corr = g / (g - 1) * (n - 1) / (n - k) if g > 1 else math.nan
        return corr * fit.bread @ meat @ fit.bread
    if st == "HAC":
        if not order_by:
            raise ValueError("HAC SE needs order_by (row order is not defined in Spark)")
        L = int(maxlags)
        sc = data.select(*[(xi * e).alias(f"u{j}") for j, xi in enumerate(x)],
                         *[F.col(c) for c in ([order_by] if isinstance(order_by, str) else order_by)])
        ordered = GlobalOrder(sc, order_by).with_running_sums([])
        check_unique(ordered.agg(F.sum("_tie")).first()[0], [order_by] if isinstance(order_by, str) else order_by)
        meat = weighted_products(ordered, [f"u{j}" for j in range(k)], bartlett(L))
        return fit.bread @ meat @ fit.bread
    raise ValueError(f"unknown se_type {se_type!r}")


def gls_ar1(df: DataFrame, target: str, features: list[str], order_by) -> LinearFit:
    """Feasible GLS with AR(1) errors (two-step Prais-Winsten)."""
    ob = [order_by] if isinstance(order_by, str) else list(order_by)
    data = design(df, target, features, extra=ob)
    first = ols(data, target, features)
    cols = [target] + list(features)
    lagged = GlobalOrder(data, ob).with_lags(cols, 1).persist()
    try:
        e = first.residual()
        b = first.beta
        e_lag = F.col(f"{target}_lag1") - (F.lit(float(b[0])) + sum(
            (F.lit(float(bj)) * F.col(f"{c}_lag1") for bj, c in zip(b[1:], features)), F.lit(0.0)))
        r = lagged.agg(F.sum(e * e_lag).alias("num"), F.sum(e_lag * e_lag).alias("den"), F.sum("_tie").alias("ties")).collect()[0]
        check_unique(r["ties"], ob)
        rho = float(r["num"] / r["den"]) if r["den"] else 0.0
        rho = max(min(rho, 0.999999), -0.999999)
        first_row = F.col(f"{target}_lag1").isNull()
        a = F.lit(math.sqrt(1 - rho * rho))

        def tr(c, lagc):
            return F.when(first_row, a * c).otherwise(c - F.lit(rho) * lagc)

        zc = [tr(F.lit(1.0), F.lit(1.0)).alias("_c")] + [
            tr(F.col(c).cast("double"), F.col(f"{c}_lag1")).alias(c) for c in cols]
        names = ["_c"] + cols
        mom = gram(lagged.select(*zc), names)
    finally:
        lagged.unpersist()
    xs = ["_c"] + list(features)
    xtx = mom.m[np.ix_(mom.idx(xs), mom.idx(xs))]
    xty = mom.m[np.ix_(mom.idx(xs), mom.idx([target]))][:, 0]
    bread = sym_inv(xtx, [CONST] + list(features))
    beta = bread @ xty
    yty = mom.m[mom.idx([target])[0], mom.idx([target])[0]]
    ssr = max(float(yty - beta @ xty), 0.0)
    fit = LinearFit(target, list(features), beta, bread, bread * 0, mom.n, ssr, first.sst,
                    algorithm="gls_ar1", moments=mom, rho=rho)
    fit.cov = fit.sigma2 * bread
    return fit


# --------------------------------------------------------- segmented
SEG_OUT = ["term", "coefficient", "se", "t_stat", "p_value", "n_obs"]


def segmented_ols(df: DataFrame, target: str, features: list[str], by: list[str]) -> DataFrame:
    """One OLS per key -- grouped GRAM, then a per-segment solve on statistics.

    Only one Gram row per segment crosses the shuffle (map-side partial
    aggregation), so a key holding a third of the rows costs nothing extra.
    """
    by = [by] if isinstance(by, str) else list(by)
    data = design(df, target, features, extra=by)
    g = grouped_gram(data, by, list(features) + [target])
    return _solve_segments(g, [data.schema[c] for c in by], target, features)


def segmented_ols_sets(df: DataFrame, target: str, features: list[str], by: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """OLS per key of every grouping set (default: the roll-up ``by``, ``by[:-1]``, ..., all rows), from one
    scan: the finest Gram rows are added up along the sets. A key that a set sums over is null, and
    ``level`` has a bit per such key (the last key is bit 0). Rows with a null key are left out, so a
    null key always means a sum."""
    by = [by] if isinstance(by, str) else list(by)
    sets = [by[:i] for i in range(len(by), -1, -1)] if sets is None else sets
    data = design(df, target, features, extra=by).dropna(subset=by)
    fine = grouped_gram(data, by, list(features) + [target])
    sums = [c for c in fine.columns if c not in by]
    merged = fine.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(
        *[F.sum(c).alias(c) for c in sums], F.grouping_id().cast("int").alias("level"))
    keys = [T.StructField(data.schema[c].name, data.schema[c].dataType, True) for c in by] + [T.StructField("level", T.IntegerType())]
    return _solve_segments(merged, keys, target, features)


def _solve_segments(g: DataFrame, key_fields: list, target: str, features: list[str]) -> DataFrame:
    """Coefficient rows of the OLS of every Gram row of ``g``."""
    by = [f.name for f in key_fields]
    names = list(features) + [target]
    schema = T.StructType(key_fields + [
        T.StructField("term", T.StringType()), T.StructField("coefficient", T.DoubleType()),
        T.StructField("se", T.DoubleType()), T.StructField("t_stat", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()), T.StructField("n_obs", T.LongType())])

    def solve(it):
        for pdf in it:
            out = []
            for _, row in pdf.iterrows():
                mom = moments_from_row(row.to_dict(), names)
                keys = [row[c] for c in by]
                try:
                    beta, bread, ssr, _ = solve_moments(mom, target, features)
                except Exception:  # noqa: BLE001 - rank-deficient segment
                    for t in [CONST] + list(features):
                        out.append(keys + [t, None, None, None, None, mom.n])
                    continue
                dfr = mom.n - len(beta)
                s2 = ssr / dfr if dfr > 0 else math.nan
                se = np.sqrt(np.clip(np.diag(bread) * s2, 0, None))
                for t, b, s in zip([CONST] + list(features), beta, se):
                    tv = b / s if s > 0 else math.nan
                    pv = dist.t_two_sided_p(tv, dfr) if dfr > 0 else math.nan
                    out.append(keys + [t, sig(b), sig(s), sig(tv), sig(pv), mom.n])
            yield pd.DataFrame(out, columns=by + SEG_OUT)

    return g.mapInPandas(solve, schema)


def ar_whitening(phi: list[float]) -> list[np.ndarray]:
    """Whitening weights of a stationary AR(p) with unit innovation variance: entry i (i < p) are the weights
    of the i-th row of a block and those before it, newest first; entry p are those of all later rows."""
    p = len(phi)
    roots = np.linalg.eigvals(np.vstack([phi, np.eye(p - 1, p)])) if p else np.zeros(0)
    if p and np.abs(roots).max() >= 1:
        raise ValueError(f"AR coefficients {phi} are not stationary")
    # autocovariances 0..p from the Yule-Walker equations
    a, rhs = np.eye(p + 1), np.zeros(p + 1)
    rhs[0] = 1.0
    for k in range(p + 1):
        for j, f in enumerate(phi, start=1):
            a[k, abs(k - j)] -= f
    gamma = np.linalg.solve(a, rhs)
    inv = np.linalg.inv(np.linalg.cholesky(gamma[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))])) if p else np.zeros((0, 0))
    return [inv[i, :i + 1][::-1] for i in range(p)] + [np.r_[1.0, -np.asarray(phi, dtype=float)]]


def gls_block_ar(df: DataFrame, target: str, features: list[str], block: str | list[str], order_by, phi: list[float]) -> LinearFit:
    """GLS with a known block-diagonal Omega whose blocks are stationary AR(p) covariances in the order
    ``order_by``. The inverse Cholesky factor of such a block is banded: every row is whitened with the p
    rows before it, the first p of a block by the factor of their own covariance. Lags come from
    the block-led global order, so a block of any size is split over tasks."""
    block = [block] if isinstance(block, str) else list(block)
    ob = [order_by] if isinstance(order_by, str) else list(order_by)
    p, cols = len(phi), [target] + list(features)
    data = design(df, target, features, extra=block + ob)
    lagged = series_lags(data.withColumn("_c", F.lit(1.0)), block, ob, ["_c"] + cols, p) if p else data.withColumn("_c", F.lit(1.0))
    weights = ar_whitening(phi)

    def white(c: str):
        past = [F.col(c).cast("double")] + [F.col(f"{c}_lag{i}") for i in range(1, p + 1)]
        rows = [sum((F.lit(float(w)) * x for w, x in zip(ws, past)), F.lit(0.0)) for ws in weights]
        out = rows[p]
        for i in range(p - 1, -1, -1):  # the i-th row of a block has i rows before it
            out = F.when(F.col(f"_c_lag{i + 1}").isNull(), rows[i]).otherwise(out)
        return out

    names = ["_c"] + cols
    mom = gram(lagged, [white(c) for c in names], names=names)
    check_nonempty(mom.n, "training data after dropping NA")
    xs = ["_c"] + list(features)
    bread = sym_inv(mom.m[np.ix_(mom.idx(xs), mom.idx(xs))], [CONST] + list(features))
    beta = bread @ mom.m[np.ix_(mom.idx(xs), mom.idx([target]))][:, 0]
    yty = mom.m[mom.idx([target])[0], mom.idx([target])[0]]
    ssr = max(float(yty - beta @ mom.m[np.ix_(mom.idx(xs), mom.idx([target]))][:, 0]), 0.0)
    fit = LinearFit(target, list(features), beta, bread, bread * 0, mom.n, ssr, float("nan"), algorithm="gls_block_ar", moments=mom)
    fit.cov = fit.sigma2 * bread
    return fit


def gls_equicorrelated(df: DataFrame, target: str, features: list[str], group: str, rho: float) -> LinearFit:
    """GLS with a known block-diagonal Omega, equicorrelated within ``group``
    (Omega_g = (1 - rho) I + rho J). Whitening is quasi-demeaning by
    theta_g = 1 - sqrt((1 - rho) / (1 - rho + n_g rho)), whose moments follow from the
    groups' Gram rows: no n x n matrix, no join of the group means."""
    data = design(df, target, features, extra=[group])
    cols = [target] + list(features)
    theta = F.lit(1.0) - F.sqrt(F.lit(1.0 - rho) / (F.lit(1.0 - rho) + F.col("_n") * F.lit(rho)))
    mom, _ = group_shrunk_moments(grouped_gram(data, [group], cols), cols, theta, const=True)
    xs = ["_c"] + list(features)
    xtx = mom.m[np.ix_(mom.idx(xs), mom.idx(xs))]
    xty = mom.m[np.ix_(mom.idx(xs), mom.idx([target]))][:, 0]
    bread = sym_inv(xtx, [CONST] + list(features))
    beta = bread @ xty
    yty = mom.m[mom.idx([target])[0], mom.idx([target])[0]]
    ssr = max(float(yty - beta @ xty), 0.0)
    fit = LinearFit(target, list(features), beta, bread, bread * 0, mom.n, ssr, float("nan"), algorithm="gls_block",
                    moments=mom, rho=rho)
    fit.cov = fit.sigma2 * bread
    return fit
