"""Assumption diagnostics (A1-A25) as tidy test rows.

One residual pass serves Breusch-Pagan, White, Jarque-Bera, RESET; one
GIDX lag pass serves Durbin-Watson and Breusch-Godfrey; VIF and screening
read the fit's own Gram.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.columns import logistic, sig
from ..functions.linalg import pivoted_dependents, sym_inv
from ..plans.gram import Moments, gram
from ..plans.order import GlobalOrder, bucket_reduce, check_unique
from ..session import shared_folder
from .linear import LinearFit, design, solve_moments

TEST_SCHEMA = T.StructType([
    T.StructField("test", T.StringType()), T.StructField("statistic", T.DoubleType()),
    T.StructField("df", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("flag", T.StringType())])


def flag_p(p: float, alpha: float = 0.05) -> str:
    """PASS p >= alpha; WARN alpha/2 <= p < alpha; FAIL below."""
    if p is None or math.isnan(p):
        return "UNKNOWN"
    if p >= alpha:
        return "PASS"
    if p >= alpha / 2:
        return "WARN"
    return "FAIL"


def flag_dw(dw: float) -> str:
    if 1.5 <= dw <= 2.5:
        return "PASS"
    if 1.0 <= dw < 1.5 or 2.5 < dw <= 3.0:
        return "WARN"
    return "FAIL"


def flag_vif(v: float) -> str:
    return "FAIL" if v > 10 else "WARN" if v > 5 else "PASS"


def _row(test, stat, df, p, flag=None):
    return (test, sig(stat), float(df) if df is not None else None, sig(p), flag or flag_p(p))


def _r2(mom: Moments, target: str, feats: list[str]) -> float:
    _, _, ssr, sst = solve_moments(mom, target, feats)
    return 1 - ssr / sst if sst > 0 else math.nan


def _fit_data(df: DataFrame, fit: LinearFit, extra=None) -> DataFrame:
    return design(df, fit.target, fit.features, fit.weight, extra)


# ------------------------------------------------------ shared moments
@dataclass
class MomentTest:
    """A test that is a function of moments: the columns it needs and what it makes of them."""
    columns: dict[str, Column]
    finish: Callable[[Moments], tuple]


def run_tests(df: DataFrame, fit: LinearFit, tests: list[MomentTest]) -> list[tuple]:
    """All tests from one aggregate over the union of their columns."""
    columns: dict[str, Column] = {}
    for t in tests:
        columns.update(t.columns)
    names = list(columns)
    m = gram(_fit_data(df, fit), list(columns.values()), names=names)

    def part(wanted):
        i = m.idx(wanted)
        return Moments(list(wanted), m.n, m.sw, m.s[i], m.m[np.ix_(i, i)], m.slogw)

    return [t.finish(part(list(t.columns))) for t in tests]


def _levels(fit: LinearFit) -> dict[str, Column]:
    return {c: F.col(c).cast("double") for c in fit.features}


# ------------------------------------------------------ heteroskedasticity
def breusch_pagan_test(fit: LinearFit) -> MomentTest:
    def finish(mom: Moments) -> tuple:
        lm = mom.n * _r2(mom, "_e2", fit.features)
        d = len(fit.features)
        return _row("breusch_pagan", lm, d, dist.chi2_sf(lm, d))

    return MomentTest({**_levels(fit), "_e2": fit.residual() ** 2}, finish)


def breusch_pagan(df: DataFrame, fit: LinearFit) -> tuple:
    """A1: Koenker LM = n R^2 of e^2 on X; df = k - 1."""
    return run_tests(df, fit, [breusch_pagan_test(fit)])[0]


def white_test(fit: LinearFit) -> MomentTest:
    f = list(fit.features)
    terms = _levels(fit)
    for i, a in enumerate(f):
        for b in f[i:]:
            terms[f"{a}*{b}"] = F.col(a).cast("double") * F.col(b).cast("double")
    names = list(terms)

    def finish(mom: Moments) -> tuple:
        c = mom.centered(names)
        d = np.sqrt(np.clip(np.diag(c), 0, None))
        keep_idx = [i for i in range(len(names)) if d[i] > 0]
        s = c[np.ix_(keep_idx, keep_idx)] / np.outer(d[keep_idx], d[keep_idx])
        dep = set(pivoted_dependents(s, 1e-9))
        kept = [names[keep_idx[i]] for i in range(len(keep_idx)) if i not in dep]
        lm = mom.n * _r2(mom, "_e2", kept)
        return _row("white", lm, len(kept), dist.chi2_sf(lm, len(kept)))

    return MomentTest({**terms, "_e2": fit.residual() ** 2}, finish)


def white(df: DataFrame, fit: LinearFit) -> tuple:
    """A2: e^2 on levels, squares and cross products; duplicate columns dropped."""
    return run_tests(df, fit, [white_test(fit)])[0]


# ------------------------------------------------------------ normality
def jarque_bera_test(fit: LinearFit) -> MomentTest:
    def finish(mom: Moments) -> tuple:  # power sums of e from the moments of (e, e^2)
        jb, _, _ = jb_from_sums(mom.n, mom.s[0], mom.s[1], mom.m[0, 1], mom.m[1, 1])
        return _row("jarque_bera", jb, 2, math.exp(-jb / 2))

    return MomentTest({"_e": fit.residual(), "_e2": fit.residual() ** 2}, finish)


def jarque_bera(df: DataFrame, fit: LinearFit) -> tuple:
    """n/6 (S^2 + (K-3)^2/4) from power sums of the residual; chi2(2)."""
    return run_tests(df, fit, [jarque_bera_test(fit)])[0]


def jb_from_sums(n, s1, s2, s3, s4):
    m = s1 / n
    c2 = s2 / n - m * m
    c3 = s3 / n - 3 * m * s2 / n + 2 * m ** 3
    c4 = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m ** 4
    skew = c3 / c2 ** 1.5
    kurt = c4 / c2 ** 2
    return n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4), skew, kurt


# ------------------------------------------------------ serial correlation
def durbin_watson(df: DataFrame, fit: LinearFit, order_by) -> tuple:
    """A3: sum (e_t - e_{t-1})^2 / sum e_t^2 over the global order (GIDX)."""
    ob = [order_by] if isinstance(order_by, str) else list(order_by)
    data = _fit_data(df, fit, ob).withColumn("_e", fit.residual())
    go = GlobalOrder(data, ob)
    okey = F.struct(*[F.col(c) for c in ob])
    # within-bucket differences in the windowed pass; the one boundary pair per bucket is
    # stitched on the driver from the bucket's first and last residual
    tie = F.lit(True)
    for c in ob:
        tie = tie & (F.col(c) == F.lag(c).over(go.window))
    rows = bucket_reduce(go, {"_el": F.lag("_e").over(go.window), "_tie": tie},
                         [F.sum((F.col("_e") - F.col("_el")) ** 2).alias("num"), F.sum(F.col("_e") ** 2).alias("den"),
                          F.min_by("_e", okey).alias("first"), F.max_by("_e", okey).alias("last"),
                          F.sum(F.when(F.col("_tie"), 1).otherwise(0)).alias("ties")])
    ties = sum(r["ties"] or 0 for r in rows)
    if ties:
        raise ValueError(f"order_by {ob} has {ties} duplicate keys: add a tie-break column so the order is unique")
    num = sum(r["num"] or 0.0 for r in rows)
    den = sum(r["den"] for r in rows)
    for prev, cur in zip(rows, rows[1:]):
        num += (cur["first"] - prev["last"]) ** 2
    dw = num / den
    return ("durbin_watson", sig(dw), None, None, flag_dw(dw))


def breusch_godfrey(df: DataFrame, fit: LinearFit, order_by, n_lags: int = 1) -> tuple:
    """A4: LM = n R^2 of e on X and zero-padded lags of e; df = n_lags."""
    ob = [order_by] if isinstance(order_by, str) else list(order_by)
    data = _fit_data(df, fit, ob).withColumn("_e", fit.residual())
    lagged = GlobalOrder(data, ob).with_lags(["_e"], n_lags)
    lag_cols = [F.coalesce(F.col(f"_e_lag{i}"), F.lit(0.0)) for i in range(1, n_lags + 1)]
    names = list(fit.features) + [f"_l{i}" for i in range(1, n_lags + 1)] + ["_e", "_tie"]
    mom = gram(lagged, [F.col(c) for c in fit.features] + lag_cols + [F.col("_e"), F.col("_tie")], names=names)
    check_unique(int(round(mom.s[-1])), ob)
    names = names[:-1]
    lm = mom.n * _r2(mom, "_e", names[:-1])
    return _row("breusch_godfrey", lm, n_lags, dist.chi2_sf(lm, n_lags))


# ------------------------------------------------------ collinearity
def vif(fit: LinearFit) -> list[tuple]:
    """A5: centred VIF = diagonal of the inverse correlation matrix (no extra pass)."""
    f = fit.features
    if len(f) < 2:
        return [(c, 1.0, "PASS") for c in f]
    c = fit.moments.centered(f)
    d = np.sqrt(np.diag(c))
    r = c / np.outer(d, d)
    inv = sym_inv(r, f)
    return [(name, sig(float(v)), flag_vif(float(v))) for name, v in zip(f, np.diag(inv))]


def correlation_screen(fit: LinearFit) -> list[tuple]:
    """Per-feature r with the target, univariate F = r^2 (n-2)/(1-r^2), p."""
    mom, y = fit.moments, fit.target
    out = []
    for c in fit.features:
        cc = mom.centered([c, y])
        r = cc[0, 1] / math.sqrt(cc[0, 0] * cc[1, 1])
        fstat = r * r * (mom.n - 2) / (1 - r * r)
        out.append((c, sig(r), sig(fstat), sig(dist.f_sf(fstat, 1, mom.n - 2))))
    return out


# ------------------------------------------------------ specification
def reset_test(fit: LinearFit, powers=(2, 3)) -> MomentTest:
    # powers of the standardised fitted value: the same column span as powers of yhat (the
    # test is invariant to an affine change of yhat) but well conditioned; mean and variance of
    # yhat come from the fit's own Gram (mean = ybar, var = b' Cxx b / n), so no extra pass
    mom = fit.moments
    b = np.asarray(fit.beta[1:])
    mu = float(fit.beta[0] + mom.mean(fit.features) @ b) if len(b) else float(fit.beta[0])
    var = float(b @ mom.centered(fit.features) @ b / mom.sw) if len(b) else 0.0
    z = (fit.linear_predictor() - F.lit(mu)) / F.lit(math.sqrt(var) if var > 0 else 1.0)
    extra = {f"_yhat{p}": z ** p for p in powers}

    def finish(m: Moments) -> tuple:
        _, _, ssr_u, _ = solve_moments(m, fit.target, [*fit.features, *extra])
        q = len(powers)
        dfd = m.n - fit.k - q
        fstat = ((fit.ssr - ssr_u) / q) / (ssr_u / dfd)
        return _row("reset", fstat, q, dist.f_sf(fstat, q, dfd))

    return MomentTest({**_levels(fit), **extra, fit.target: F.col(fit.target).cast("double")}, finish)


def reset(df: DataFrame, fit: LinearFit, powers=(2, 3)) -> tuple:
    """Ramsey RESET -- add powers of the fitted value, F test on them."""
    return run_tests(df, fit, [reset_test(fit, powers)])[0]


def influence(df: DataFrame, fit: LinearFit, keep: list[str] | None = None) -> DataFrame:
    """Leverage, studentised residual, Cook's D as columns (alerts 4/n, 1); after
    WLS those of the whitened rows (sqrt(w) x, sqrt(w) e)."""
    s2 = fit.sigma2
    w = F.col(fit.weight).cast("double") if fit.weight else None
    h = fit.leverage(w)
    e = fit.residual() * F.sqrt(w) if fit.weight else fit.residual()
    keep = [*(keep or []), *([fit.weight] if fit.weight and fit.weight not in (keep or []) else [])]
    data = _fit_data(df, fit, keep)
    out = data.select(*(keep or []), e.alias("resid"), h.alias("leverage"))
    out = out.withColumn("student_resid", F.col("resid") / F.sqrt(F.lit(s2) * (F.lit(1.0) - F.col("leverage"))))
    out = out.withColumn("cooks_d", F.col("student_resid") ** 2 / F.lit(float(fit.k))
                         * F.col("leverage") / (F.lit(1.0) - F.col("leverage")))
    out = out.withColumn("high_leverage", F.col("leverage") > F.lit(2.0 * fit.k / fit.n))
    out = out.withColumn("influential", (F.col("cooks_d") > F.lit(4.0 / fit.n)) | (F.col("cooks_d") > 1))
    return out


def sparse_cells(df: DataFrame, y: str, min_share: float = 0.05) -> DataFrame:
    """Class counts and shares, flagged below ``min_share``."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = df.where(F.col(y).isNotNull()).count()
    out = counts.withColumn("share", F.col("n") / F.lit(float(total)))
    return out.withColumn("sparse", F.col("share") < F.lit(min_share))


def sample_size_check(n: int, k: int, n_events: int | None = None, min_class: int | None = None) -> list[tuple]:
    """50 + 8k rule; 10 / 20 events per variable; >= 50/100 per category."""
    rows = [("n_ge_50_plus_8k", float(n), float(50 + 8 * k), "PASS" if n >= 50 + 8 * k else "WARN")]
    if n_events is not None:
        epv = n_events / max(k, 1)
        rows.append(("events_per_variable", float(epv), 10.0, "PASS" if epv >= 20 else "WARN" if epv >= 10 else "FAIL"))
    if min_class is not None:
        rows.append(("min_class_count", float(min_class), 50.0,
                     "PASS" if min_class >= 100 else "WARN" if min_class >= 50 else "FAIL"))
    return rows


def ljung_box(df: DataFrame, col: str, order_by, lags: int = 10) -> tuple:
    """Q = n(n+2) sum rho_k^2/(n-k) from the ACF."""
    from .series import acf
    rho, n = acf(df, col, order_by, lags, return_n=True)
    q = n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(rho[1:], start=1))
    return _row("ljung_box", q, lags, dist.chi2_sf(q, lags))


def cutpoints_monotone(theta: list[float]) -> bool:
    """Ordered-model cutpoints strictly increasing."""
    return all(b > a for a, b in zip(theta, theta[1:]))


def vuong(df: DataFrame, ll1: Column, ll2: Column) -> tuple:
    """Mean and sd of the per-row log-likelihood difference; z ~ N(0,1)."""
    r = df.select((ll1 - ll2).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"),
                                              F.stddev_pop("d").alias("s")).collect()[0]
    z = math.sqrt(r["n"]) * r["m"] / r["s"]
    return ("vuong", sig(z), None, sig(2 * dist.norm_sf(abs(z))), "MODEL1" if z > 1.96 else "MODEL2" if z < -1.96 else "TIE")


def overdispersion(df: DataFrame, y: str, mu: Column, k: int) -> list[tuple]:
    """Pearson chi2/df and the Cameron-Trivedi auxiliary regression (no constant)."""
    yc = F.col(y).cast("double")
    d = df.select(((yc - mu) ** 2 / mu).alias("p"), (((yc - mu) ** 2 - yc) / mu).alias("z"), mu.alias("mu"))
    r = d.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("x2"), F.sum(F.col("z") * F.col("mu")).alias("zm"),
              F.sum(F.col("mu") ** 2).alias("mm"), F.sum(F.col("z") ** 2).alias("zz")).collect()[0]
    n = r["n"]
    disp = r["x2"] / (n - k)
    a = r["zm"] / r["mm"]
    resid = r["zz"] - a * r["zm"]
    se = math.sqrt(resid / (n - 1) / r["mm"])
    t = a / se
    return [("pearson_dispersion", sig(disp), float(n - k), None, "WARN" if disp > 1.5 else "PASS"),
            _row("cameron_trivedi", t, n - 1, dist.t_two_sided_p(t, n - 1))]


def summary(tests: list[tuple]) -> dict:
    """Counts of flags, overall flag and the confidence adjustment."""
    flags = [t[-1] for t in tests]
    nf, nw = flags.count("FAIL"), flags.count("WARN")
    overall = "FAIL" if nf else "WARN" if nw else "PASS"
    return {"n_tests": len(tests), "n_pass": flags.count("PASS"), "n_warn": nw, "n_fail": nf,
            "overall": overall, "confidence_adjustment": min(0.5, 0.05 * nf + 0.02 * nw)}


def serial_tests(df: DataFrame, fit: LinearFit, order_by, n_lags: int = 1) -> list[tuple]:
    """A3 and A4 (:func:`durbin_watson`, :func:`breusch_godfrey`) from one ordered pass."""
    ob = [order_by] if isinstance(order_by, str) else list(order_by)
    data = _fit_data(df, fit, ob).withColumn("_e", fit.residual())
    lagged = GlobalOrder(data, ob).with_lags(["_e"], n_lags)
    cols = {**_levels(fit), **{f"_l{i}": F.coalesce(F.col(f"_e_lag{i}"), F.lit(0.0)) for i in range(1, n_lags + 1)}, "_e": F.col("_e"),
            "_step": F.coalesce(F.col("_e") - F.col("_e_lag1"), F.lit(0.0)), "_tie": F.col("_tie")}
    m = gram(lagged, list(cols.values()), names=list(cols))
    check_unique(int(round(m.s[-1])), ob)
    e, step = m.idx(["_e", "_step"])
    dw = m.m[step, step] / m.m[e, e]
    lm = m.n * _r2(m, "_e", [c for c in cols if c not in ("_e", "_step", "_tie")])
    return [("durbin_watson", sig(dw), None, None, flag_dw(dw)), _row("breusch_godfrey", lm, n_lags, dist.chi2_sf(lm, n_lags))]


def validate_assumptions(spark: SparkSession, df: DataFrame, fit: LinearFit, order_by=None, normality: bool = True) -> DataFrame:
    """All linear-model tests and their summary as one tidy table (A1-A9, A11): one scan for the moment
    tests together, one ordered pass for the serial tests (with ``order_by``), and one ranking of the
    residuals for Shapiro-Wilk (``normality``). The last rows are the summary of A9."""
    rows = run_tests(df, fit, [breusch_pagan_test(fit), white_test(fit), jarque_bera_test(fit), reset_test(fit)])
    if normality:
        e = _fit_data(df, fit).select(F.lit("residual").alias("_g"), fit.residual().alias("_e"))
        w = shapiro_wilk(e, "_e", "_g").first()
        rows.append(("shapiro_wilk", sig(w["W"]), float(w["n"]), sig(w["p_value"]), flag_p(w["p_value"])))
    if order_by:
        rows += serial_tests(df, fit, order_by)
    for name, v, fl in vif(fit):
        rows.append((f"vif:{name}", v, None, None, fl))
    s = summary(rows)
    rows += [(f"summary:{k}", float(s[k]), None, None, s["overall"]) for k in ("n_tests", "n_pass", "n_warn", "n_fail", "confidence_adjustment")]
    return spark.createDataFrame(rows, TEST_SCHEMA)


# ---------------------------------------------------------- A12, A24
def linktest(df: DataFrame, fit, family: str = "linear") -> tuple:
    """Refit the outcome on the fitted index and its square; a significant square
    term signals misspecification. Returns the z (or t) row of the squared term."""
    if family == "linear":
        xb = fit.linear_predictor()
        d = _fit_data(df, fit).select(F.col(fit.target).alias("_y"), xb.alias("_hat"), (xb * xb).alias("_hat2"))
        from .linear import ols
        f2 = ols(d, "_y", ["_hat", "_hat2"])
        t = f2.beta[2] / f2.se[2]
        return _row("linktest", t, f2.df_resid, dist.t_two_sided_p(t, f2.df_resid))
    from .discrete import glm
    xb = fit.linear_predictor()
    base = df.dropna(subset=list(fit.features) + [fit.target])
    # the square-term test is invariant to an affine change of the index: standardise it
    mu, sd = base.agg(F.avg(xb), F.stddev_pop(xb)).collect()[0]
    z = (xb - F.lit(mu)) / F.lit(sd if sd else 1.0)
    d = base.select(F.col(fit.target).cast("double").alias("_y"), z.alias("_hat"), (z * z).alias("_hat2"))
    f2 = glm(d, "_y", ["_hat", "_hat2"], "binomial", fit.family)
    z = f2.theta[2] / f2.se[2]
    return _row("linktest", z, 1, 2 * dist.norm_sf(abs(z)))


def deviance_table(df: DataFrame, y: str, mu: Column, family: str, by: list[str] | None = None) -> DataFrame:
    """Deviance and Pearson chi2 (optionally per group) from column expressions."""
    yc = F.col(y).cast("double")
    if family == "binomial":
        dev = F.lit(-2.0) * (yc * F.log(mu) + (F.lit(1.0) - yc) * F.log(F.lit(1.0) - mu))
        var = mu * (F.lit(1.0) - mu)
    elif family == "poisson":
        dev = F.lit(2.0) * (F.when(yc > 0, yc * F.log(yc / mu)).otherwise(F.lit(0.0)) - (yc - mu))
        var = mu
    else:
        dev = (yc - mu) * (yc - mu)
        var = F.lit(1.0)
    d = df.select(*(by or []), dev.alias("_dev"), ((yc - mu) * (yc - mu) / var).alias("_p"),
                  (F.signum(yc - mu) * F.sqrt(F.greatest(dev, F.lit(0.0)))).alias("_dres"))
    g = d.groupBy(*(by or [])) if by else d
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("_dev").alias("deviance"), F.sum("_p").alias("pearson_chi2"),
                 F.max(F.abs("_dres")).alias("max_abs_deviance_resid"))


def deviance_residuals(df: DataFrame, y: str, mu: Column, family: str = "binomial") -> Column:
    yc = F.col(y).cast("double")
    if family == "binomial":
        dev = F.lit(-2.0) * (yc * F.log(mu) + (F.lit(1.0) - yc) * F.log(F.lit(1.0) - mu))
    else:
        dev = F.lit(2.0) * (F.when(yc > 0, yc * F.log(yc / mu)).otherwise(F.lit(0.0)) - (yc - mu))
    return F.signum(yc - mu) * F.sqrt(F.greatest(dev, F.lit(0.0)))


# ------------------------------------------------------------------ A13
def brant(df: DataFrame, y: str, features: list[str]) -> dict:
    """Brant test of parallel lines -- J-1 binary logits 1[y > j], their joint
    covariance from ONE cross-moment aggregate, Wald test that slopes are equal."""
    from .discrete import class_codes, logit
    code, labels = class_codes(df, y)
    J = len(labels)
    d = df.dropna(subset=[y] + list(features)).withColumn("_y", code)
    fits = []
    for j in range(J - 1):
        dj = d.withColumn(f"_b{j}", (F.col("_y") > F.lit(j)).cast("double"))
        fits.append(logit(dj, f"_b{j}", list(features)))
    k = len(features) + 1
    xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
    pis = [logistic(f.linear_predictor()) for f in fits]
    aggs = []
    for a in range(J - 1):
        for b in range(a, J - 1):
            w = pis[b] - pis[a] * pis[b]  # Var cross term for a <= b
            aggs += [F.sum(w * xs[i] * xs[jj]).alias(f"c{a}_{b}_{i}_{jj}") for i in range(k) for jj in range(k)]
    r = d.agg(*aggs).collect()[0]
    M = J - 1
    big = np.zeros((M * k, M * k))
    for a in range(M):
        for b in range(a, M):
            c = np.array([[r[f"c{a}_{b}_{i}_{jj}"] for jj in range(k)] for i in range(k)])
            va, vb = fits[a].cov, fits[b].cov
            blk = va @ c @ vb
            big[a * k:(a + 1) * k, b * k:(b + 1) * k] = blk
            big[b * k:(b + 1) * k, a * k:(a + 1) * k] = blk.T
    # slopes only (drop intercepts), contrasts beta_1 - beta_m for m = 2..M
    sl = [i for i in range(k) if i > 0]
    beta = np.concatenate([f.theta[sl] for f in fits])
    idx = [a * k + i for a in range(M) for i in sl]
    V = big[np.ix_(idx, idx)]
    ks = len(sl)
    D = np.zeros(((M - 1) * ks, M * ks))
    for m in range(1, M):
        D[(m - 1) * ks:m * ks, 0:ks] = np.eye(ks)
        D[(m - 1) * ks:m * ks, m * ks:(m + 1) * ks] = -np.eye(ks)
    db = D @ beta
    stat = float(db @ np.linalg.solve(D @ V @ D.T, db))
    dfree = ks * (M - 1)
    return {"brant_stat": stat, "df": dfree, "p_value": dist.chi2_sf(stat, dfree)}


# ------------------------------------------------------------------- A7
def shapiro_wilk(df: DataFrame, col: str, by: list[str] | str) -> DataFrame:
    """Shapiro-Wilk W per segment with Royston's approximation for the weights and
    the p-value (published for n up to 5000; beyond, ``p_value`` extrapolates it). Ranks come
    from the segment-led global order, so a hot segment is sorted by many tasks. Segments
    of fewer than four rows get a null W."""
    from ..functions.columns import norm_cdf
    by = [by] if isinstance(by, str) else list(by)
    d = df.select(*by, F.col(col).cast("double").alias("_x")).dropna()
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # the ranks are read three times: written once, so that the rows are ordered once
    path = shared_folder(df.sparkSession, "shapiro-ranks")
    GlobalOrder(d.withColumn("_sh", F.xxhash64(*by)).dropna(subset=by), ["_sh", *by, "_x"]).with_running_sums([]).select(
        *by, "_x", "_idx").write.parquet(path)
    ranked = df.sparkSession.read.parquet(path)
    seg = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_lo")).where(F.col("_n") >= 4)
    small = ranked.select(*by, "_x", "_idx").join(seg, by).withColumn("_i", F.col("_idx") - F.col("_lo") + 1)
    p = (F.col("_i") - F.lit(0.375)) / (F.col("_n") + F.lit(0.25))
    small = small.withColumn("_m", _norm_ppf_col(p))
    # one refinement step of the inverse normal with the column cdf
    e = norm_cdf(F.col("_m")) - p
    small = small.withColumn("_m", F.col("_m") - e * F.lit(math.sqrt(2 * math.pi)) * F.exp(F.col("_m") ** 2 / 2))
    seg = small.groupBy(*by).agg(F.first("_n").alias("_n"), F.sum(F.col("_m") ** 2).alias("_ssq"),
                                 F.max_by("_m", "_i").alias("_mn"),
                                 F.max_by(F.when(F.col("_i") == F.col("_n") - 1, F.col("_m")),
                                          F.when(F.col("_i") == F.col("_n") - 1, F.col("_i"))).alias("_mn1"))
    n = F.col("_n").cast("double")
    u = F.lit(1.0) / F.sqrt(n)
    # fixed values: Royston (1992) polynomial corrections for the two extreme weights
    an = F.col("_mn") / F.sqrt(F.col("_ssq")) + F.lit(0.221157) * u - F.lit(0.147981) * u ** 2 \
        - F.lit(2.071190) * u ** 3 + F.lit(4.434685) * u ** 4 - F.lit(2.706056) * u ** 5
    an1 = F.col("_mn1") / F.sqrt(F.col("_ssq")) + F.lit(0.042981) * u - F.lit(0.293762) * u ** 2 \
        - F.lit(1.752461) * u ** 3 + F.lit(5.682633) * u ** 4 - F.lit(3.582633) * u ** 5
    seg = seg.withColumn("_an", an).withColumn("_an1", an1)
    phi = F.when(n > 5, (F.col("_ssq") - F.lit(2.0) * F.col("_mn") ** 2 - F.lit(2.0) * F.col("_mn1") ** 2)
                 / (F.lit(1.0) - F.lit(2.0) * F.col("_an") ** 2 - F.lit(2.0) * F.col("_an1") ** 2)).otherwise(
        (F.col("_ssq") - F.lit(2.0) * F.col("_mn") ** 2) / (F.lit(1.0) - F.lit(2.0) * F.col("_an") ** 2))
    seg = seg.withColumn("_phi", phi)
    j = small.join(seg.select(*by, "_an", "_an1", "_phi"), by)
    i, nn = F.col("_i"), F.col("_n")
    a = (F.when(i == nn, F.col("_an")).when(i == 1, -F.col("_an"))
         .when((i == nn - 1) & (nn > 5), F.col("_an1")).when((i == 2) & (nn > 5), -F.col("_an1"))
         .otherwise(F.col("_m") / F.sqrt(F.col("_phi"))))
    stats = j.groupBy(*by).agg(F.first("_n").alias("n"), F.sum(a * F.col("_x")).alias("_num"),
                               F.var_pop("_x").alias("_v"))
    W = F.least(F.col("_num") ** 2 / (F.col("_v") * F.col("n")), F.lit(1.0))
    stats = stats.withColumn("W", W)
    ln = F.log(F.col("n").cast("double"))
    # fixed values: Royston (1995) normalising transformation of W (n >= 12; 4 <= n <= 11)
    mu_big = F.lit(0.0038915) * ln ** 3 - F.lit(0.083751) * ln ** 2 - F.lit(0.31082) * ln - F.lit(1.5861)
    sd_big = F.exp(F.lit(0.0030302) * ln ** 2 - F.lit(0.082676) * ln - F.lit(0.4803))
    nd = F.col("n").cast("double")
    gam = F.lit(-2.273) + F.lit(0.459) * nd
    mu_small = F.lit(0.5440) - F.lit(0.39978) * nd + F.lit(0.025054) * nd ** 2 - F.lit(0.0006714) * nd ** 3
    sd_small = F.exp(F.lit(1.3822) - F.lit(0.77857) * nd + F.lit(0.062767) * nd ** 2 - F.lit(0.0020322) * nd ** 3)
    z = F.when(nd >= 12, (F.log(F.lit(1.0) - F.col("W")) - mu_big) / sd_big).otherwise(
        (-F.log(gam - F.log(F.lit(1.0) - F.col("W"))) - mu_small) / sd_small)
    from ..functions.columns import norm_tail
    stats = stats.withColumn("p_value", F.when(z > 0, norm_tail(z)).otherwise(F.lit(1.0) - norm_tail(z)))
    skipped = sizes.where(F.col("_n") < 4).select(
        *by, F.col("_n").alias("n"), F.lit(None).cast("double").alias("W"), F.lit(None).cast("double").alias("p_value"))
    return stats.select(*by, "n", "W", "p_value").unionByName(skipped)


def _norm_ppf_col(p: Column) -> Column:
    """Inverse normal cdf as a column (rational start, refined by the caller)."""
    # fixed values: Acklam's rational approximation (same constants as dist.norm_ppf)
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00)

    def poly(cs, x):
        acc = F.lit(cs[0])
        for v in cs[1:]:
            acc = acc * x + F.lit(v)
        return acc
    q = p - F.lit(0.5)
    r = q * q
    central = poly(a, r) * q / (poly(b, r) * r + F.lit(1.0))
    ql = F.sqrt(F.lit(-2.0) * F.log(p))
    low = poly(c, ql) / (poly(d, ql) * ql + F.lit(1.0))
    qh = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    high = -poly(c, qh) / (poly(d, qh) * qh + F.lit(1.0))
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(central)
