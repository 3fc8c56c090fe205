"""Evaluation and selection (E1-E23): metrics as one aggregate each, exact
AUC / KS / quantile cuts through the global-order prefix sums, Gram-based
cross-validation (one grouped GRAM by fold; train = total - fold)."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.columns import sig
from ..plans.gram import gram, grouped_gram, moments_from_row, poisson_grams
from ..plans.order import GlobalOrder, bucket_reduce
from .linear import LinearFit, design, solve_moments

MAX_FOLDS = 10_000  # fold / period Gram rows collected to the driver (k x k each)


MAX_BINARY_FOLDS = 50  # each fold is an iterative fit


def _collect_bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_FOLDS + 1).collect()
    if len(rows) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} {what}: use a coarser grouping")
    return rows


METRIC_SCHEMA = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------ E1, E3
def regression_metrics(df: DataFrame, y, pred, k: int | None = None) -> dict:
    """RMSE (n or n-k denominator), MAE, R^2, n in one aggregate."""
    e = _c(y).cast("double") - _c(pred).cast("double")
    r = df.select(e.alias("e"), _c(y).cast("double").alias("y")).dropna().agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("e") ** 2).alias("sse"), F.sum(F.abs("e")).alias("sae"),
        F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy")).collect()[0]
    n = r["n"]
    sst = r["syy"] - r["sy"] ** 2 / n
    den = n - k if k else n
    return {"n": n, "rmse": math.sqrt(r["sse"] / den), "mae": r["sae"] / n,
            "r_squared": 1 - r["sse"] / sst if sst > 0 else math.nan}


def in_sample_linear(fit: LinearFit) -> dict:
    """E1 from the fit itself: RMSE = sqrt(mse_resid), R^2, adj R^2."""
    return {"rmse": math.sqrt(fit.sigma2), "r_squared": fit.r2, "adj_r_squared": fit.adj_r2, "n": fit.n}


# ------------------------------------------------------------ E4, V6
def auc(df: DataFrame, y, score) -> float:
    """Exact ROC AUC (ties count one half): counts by distinct score, global
    prefix sum of negatives over the score order, one final sum."""
    g = (df.select(_c(y).cast("double").alias("y"), _c(score).cast("double").alias("s")).dropna()
         .groupBy("s").agg(F.sum("y").alias("pos"), F.sum(F.lit(1.0) - F.col("y")).alias("neg")))
    # the per-score table feeds three GIDX passes (cuts, bucket summary, window): shuffle it once
    g = g.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        go = GlobalOrder(g, ["s"])
        run = go.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # per bucket: P_b, N_b and the within-bucket U part; stitched with the offsets of N
        rows = bucket_reduce(go, {"_cn": F.sum("neg").over(run)},
                             [F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                              F.sum(F.col("pos") * (F.col("_cn") - F.lit(0.5) * F.col("neg"))).alias("U")])
    finally:
        g.unpersist()
    u, off, P, N = 0.0, 0.0, 0.0, 0.0
    for r in rows:
        u += r["U"] + r["P"] * off
        off += r["N"]
        P += r["P"]
        N += r["N"]
    return u / (P * N) if P and N else math.nan  # one class only: not defined


def roc_points(df: DataFrame, y, score) -> DataFrame:
    """V6: (threshold, fpr, tpr) for every distinct score, descending threshold."""
    g = (df.select(_c(y).cast("double").alias("y"), (-_c(score).cast("double")).alias("ns")).dropna()
         .groupBy("ns").agg(F.sum("y").alias("pos"), F.sum(F.lit(1.0) - F.col("y")).alias("neg")))
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()[0]
    cum = GlobalOrder(g, ["ns"]).with_running_sums(["pos", "neg"])
    return cum.select((-F.col("ns")).alias("threshold"), (F.col("neg_cum") / F.lit(tot["N"])).alias("fpr"),
                      (F.col("pos_cum") / F.lit(tot["P"])).alias("tpr"))


# ------------------------------------------------------ E5-E8, E18
def probability_metrics(df: DataFrame, y, p, threshold: float = 0.5) -> dict:
    yc, pc = _c(y).cast("double"), _c(p).cast("double")
    eps = 1e-15
    pcl = F.least(F.greatest(pc, F.lit(eps)), F.lit(1 - eps))
    r = df.select(yc.alias("y"), pcl.alias("p")).dropna().agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(-(F.col("y") * F.log("p") + (F.lit(1.0) - F.col("y")) * F.log(F.lit(1.0) - F.col("p")))).alias("ll"),
        F.sum((F.col("p") - F.col("y")) ** 2).alias("bs"),
        F.sum(((F.col("p") >= threshold).cast("double") == F.col("y")).cast("double")).alias("acc")).collect()[0]
    n = r["n"]
    return {"n": n, "log_loss": r["ll"] / n, "brier": r["bs"] / n, "accuracy": r["acc"] / n}


def confusion(df: DataFrame, y, yhat) -> DataFrame:
    """Counts by (actual, predicted)."""
    return (df.select(_c(y).alias("actual"), _c(yhat).alias("predicted")).dropna()
            .groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")))


def class_report(df: DataFrame, y, yhat) -> DataFrame:
    """Precision / recall / F1 / support per class (zero_division = 0)."""
    cm = confusion(df, y, yhat)
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("npred"))
    t = sup.join(pred, "cls", "full").join(tp, "cls", "left").fillna(0, ["tp", "support", "npred"])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    return t.withColumn("f1", f1).select("cls", "precision", "recall", "f1", "support")


# --------------------------------------------------- exact quantile cuts
def exact_cuts(df: DataFrame, col, g: int) -> list[float]:
    """Lower empirical quantiles i/g, i = 1..g-1: smallest v with cum(v) * g >= i * n.

    Distributed: counts per distinct value, GIDX prefix sums, then one small
    aggregate per cut -- no sort of all rows into one task.
    """
    v = (df.select(_c(col).cast("double").alias("v")).dropna().groupBy("v")
         .agg(F.count(F.lit(1)).cast("double").alias("c"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cum = GlobalOrder(v, ["v"]).with_running_sums(["c"])
        n = v.agg(F.sum("c")).collect()[0][0]
        aggs = [F.min(F.when(F.col("c_cum") * F.lit(g) >= F.lit(i * n), F.col("v"))).alias(f"q{i}")
                for i in range(1, g)]
        r = cum.agg(*aggs).collect()[0]
    finally:
        v.unpersist()
    return [r[f"q{i}"] for i in range(1, g)]


def bin_column(col, cuts: list[float]) -> Column:
    """Bin index = number of distinct cuts <= value (0-based)."""
    out = F.lit(0)
    for c in sorted(set(cuts)):
        out = out + (_c(col) >= F.lit(float(c))).cast("int")
    return out


def calibration(df: DataFrame, y, p, bins: int = 10) -> DataFrame:
    """Per score-decile mean predicted vs observed rate."""
    cuts = exact_cuts(df, p, bins)
    d = df.select(_c(y).cast("double").alias("y"), _c(p).cast("double").alias("p")).dropna()
    return (d.withColumn("bin", bin_column("p", cuts)).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pred"), F.avg("y").alias("obs_rate")))


def hosmer_lemeshow(df: DataFrame, y, p, g: int = 10) -> dict:
    """Sum over score groups of (O - E)^2 / (E (1 - E / n_g)); chi2(g - 2)."""
    cal = calibration(df, y, p, g)
    rows = cal.agg(F.count(F.lit(1)).alias("groups"),
                   F.sum((F.col("obs_rate") * F.col("n") - F.col("mean_pred") * F.col("n")) ** 2
                         / (F.col("mean_pred") * F.col("n") * (F.lit(1.0) - F.col("mean_pred")))).alias("hl")
                   ).collect()[0]
    dof = rows["groups"] - 2
    return {"hl_stat": rows["hl"], "df": dof, "p_value": dist.chi2_sf(rows["hl"], dof) if dof > 0 else math.nan}


# ------------------------------------------------------------------ E9
def baseline(fit: LinearFit, df: DataFrame) -> dict:
    """Model vs mean-only: RMSE (model n-k, null n), MAE both."""
    data = design(df, fit.target, fit.features)
    ybar = fit.moments.mean([fit.target])[0]
    r = data.agg(F.sum(F.abs(fit.residual())).alias("mae_m"),
                 F.sum(F.abs(F.col(fit.target) - F.lit(ybar))).alias("mae_0")).collect()[0]
    n = fit.n
    return {"rmse_model": math.sqrt(fit.sigma2), "rmse_null": math.sqrt(fit.sst / n),
            "mae_model": r["mae_m"] / n, "mae_null": r["mae_0"] / n,
            "rmse_improvement": 1 - math.sqrt(fit.sigma2) / math.sqrt(fit.sst / n)}


def confidence_linear(n: int, r2: float) -> float:
    return round(min(1.0, max(0.0, 0.5 + min(0.20, 0.05 * n ** 0.3) + min(0.15, 0.15 * r2))), 4)


def confidence_binary(n: int, r2: float, auc_value: float) -> float:
    c = 0.5 + min(0.20, 0.05 * n ** 0.3) + min(0.15, 0.15 * r2) + min(0.20, 0.4 * (auc_value - 0.5))
    return round(min(1.0, max(0.0, c)), 4)


def _size_part(n: int) -> float:
    return min(0.20, 0.05 * n ** 0.3) if n > 0 else 0.0


def _bounded(score: float) -> float:
    return round(min(1.0, max(0.0, score)), 4)


def confidence_interpretation(n: int) -> float:
    """Confidence of an interpretation: by the number of rows alone."""
    return _bounded(0.6 + _size_part(n))


def confidence_registry(n: int, r2: float | None = None, auc_value: float | None = None, flags: list[str] | None = None) -> float:
    """Confidence of a registered model: rows, fit, discrimination and the share of assumption checks
    that pass (0.10 of it); parts that are not known add nothing."""
    score = 0.5 + _size_part(n)
    if r2 is not None and r2 > 0:
        score += min(0.15, 0.15 * r2)
    if auc_value is not None:
        score += min(0.20, 0.4 * (auc_value - 0.5))
    if flags:
        score += 0.10 * flags.count("PASS") / len(flags)
    return _bounded(score)


# ----------------------------------------------------------- E12, E13
def information_criteria(llf: float, k: int, n: int) -> dict:
    return {"aic": -2 * llf + 2 * k, "bic": -2 * llf + k * math.log(n),
            "hqic": -2 * llf + 2 * k * math.log(math.log(n))}


def lr_test(llf_full: float, llf_restricted: float, df_diff: int) -> dict:
    stat = 2 * (llf_full - llf_restricted)
    return {"lr_stat": stat, "df": df_diff, "p_value": dist.chi2_sf(stat, df_diff)}


# ------------------------------------------------------------ E14-E17
def fold_column(key_cols: list[str], k: int, seed: int = 42) -> Column:
    """Deterministic fold from a hash of key columns (stable under recomputation)."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols]), F.lit(k)).cast("int")


def cross_validate_linear(df: DataFrame, target: str, features: list[str], k: int = 5,
                          key_cols: list[str] | None = None, fold: Column | None = None) -> list[dict]:
    """K-fold CV of OLS from ONE grouped GRAM by fold; train Gram = total - fold.
    Test SSE of fold f is computed from the fold's own moments and the train beta."""
    data = design(df, target, features, extra=key_cols or [])
    fcol = fold if fold is not None else fold_column(key_cols or [target] + list(features), k)
    names = list(features) + [target]
    rows = _collect_bounded(grouped_gram(data.withColumn("_fold", fcol), ["_fold"], names), "folds")
    moms = {r["_fold"]: moments_from_row(r, names) for r in rows}
    total = None
    for m in moms.values():
        total = m if total is None else total + m
    out = []
    for f, m in sorted(moms.items()):
        train = total - m
        beta, _, _, _ = solve_moments(train, target, features)
        # SSE on fold = sum (y - b0 - x b)^2 from the fold's raw moments
        z = np.concatenate([[-beta[0]], -beta[1:], [1.0]])
        raw = m.raw(names)
        sse = float(z @ raw @ z)
        out.append({"fold": f, "n_test": m.n, "rmse": math.sqrt(max(sse, 0) / m.n), "coef": beta})
    return out


def loo_linear(df: DataFrame, fit: LinearFit) -> dict:
    """Exact leave-one-out PRESS = sum (e / (1 - h))^2 in one pass (h weighted after WLS)."""
    data = design(df, fit.target, fit.features, fit.weight)
    w = F.col(fit.weight).cast("double") if fit.weight else None
    r = data.agg(F.count(F.lit(1)).alias("n"),
                 F.sum((fit.residual() / (F.lit(1.0) - fit.leverage(w))) ** 2).alias("press")).collect()[0]
    return {"press": r["press"], "loo_rmse": math.sqrt(r["press"] / r["n"]), "n": r["n"]}


def cross_validate_binary(df: DataFrame, y: str, features: list[str], fold: Column, link: str = "logit") -> list[dict]:
    """E14 for binary models: one fit per fold on the other folds (at most ``MAX_BINARY_FOLDS``),
    log loss, Brier score and accuracy on the fold, each from one aggregate."""
    from .discrete import glm, probability
    data = df.select(y, *features, fold.alias("_fold")).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folds = [r[0] for r in data.select("_fold").distinct().orderBy("_fold").limit(MAX_BINARY_FOLDS + 1).collect()]
        if len(folds) > MAX_BINARY_FOLDS:
            raise ValueError(f"more than {MAX_BINARY_FOLDS} folds: use a coarser grouping")
        out = []
        for f in folds:
            fit = glm(data.where(F.col("_fold") != F.lit(f)), y, features, "binomial", link, persist=False)
            m = probability_metrics(data.where(F.col("_fold") == F.lit(f)), y, probability(fit))
            out.append({"fold": f, "converged": fit.converged, **m})
        return out
    finally:
        data.unpersist()


def time_cv_linear(df: DataFrame, target: str, features: list[str], period: Column, mode: str = "expanding",
                   window: int = 3) -> list[dict]:
    """Rolling / expanding-origin CV from one GRAM per period (cumulative sums)."""
    pcol = period if isinstance(period, Column) else F.col(period)
    data = design(df.withColumn("_p", pcol), target, features, extra=["_p"])
    names = list(features) + [target]
    rows = _collect_bounded(grouped_gram(data, ["_p"], names), "periods")
    moms = sorted(((r["_p"], moments_from_row(r, names)) for r in rows), key=lambda t: t[0])
    out = []
    for i in range(1, len(moms)):
        lo = 0 if mode == "expanding" else max(0, i - window)
        train = None
        for _, m in moms[lo:i]:
            train = m if train is None else train + m
        test = moms[i][1]
        try:
            beta, _, _, _ = solve_moments(train, target, features)
        except (ValueError, np.linalg.LinAlgError):  # collinear training span: the period is reported without an error
            out.append({"period": moms[i][0], "n_train": train.n, "n_test": test.n, "rmse": math.nan})
            continue
        z = np.concatenate([[-beta[0]], -beta[1:], [1.0]])
        sse = float(z @ test.raw(names) @ z)
        out.append({"period": moms[i][0], "n_train": train.n, "n_test": test.n,
                    "rmse": math.sqrt(max(sse, 0) / test.n)})
    return out


# ----------------------------------------------------------- E21, E22
def partial_f(df: DataFrame, target: str, features: list[str], drop: list[str]) -> dict:
    """F test for dropping ``drop`` -- two sub-Grams of one GRAM pass."""
    data = design(df, target, features)
    mom = gram(data, list(features) + [target])
    _, _, ssr_u, _ = solve_moments(mom, target, features)
    keep = [c for c in features if c not in drop]
    _, _, ssr_r, _ = solve_moments(mom, target, keep)
    q = len(drop)
    dfd = mom.n - len(features) - 1
    f = ((ssr_r - ssr_u) / q) / (ssr_u / dfd)
    return {"f_stat": f, "df_num": q, "df_den": dfd, "p_value": dist.f_sf(f, q, dfd)}


def ridge(df: DataFrame, target: str, features: list[str], lam: float | list[float]) -> list[dict]:
    """Ridge on standardised features from one GRAM; a whole lambda path per pass."""
    data = design(df, target, features)
    mom = gram(data, list(features) + [target])
    c = mom.centered(features)
    cy = mom.centered(features, [target])[:, 0]
    sd = np.sqrt(np.diag(c) / mom.sw)
    out = []
    for lmb in ([lam] if isinstance(lam, (int, float)) else lam):
        cs = c / np.outer(sd, sd)
        b_std = np.linalg.solve(cs + lmb * np.eye(len(features)), cy / sd)
        b = b_std / sd
        b0 = mom.mean([target])[0] - mom.mean(features) @ b
        out.append({"lambda": lmb, "coef": np.concatenate([[b0], b])})
    return out


def lasso(df: DataFrame, target: str, features: list[str], lam: float, iters: int = 500) -> np.ndarray:
    """LASSO by coordinate descent on the standardised Gram (driver, k x k)."""
    data = design(df, target, features)
    mom = gram(data, list(features) + [target])
    n = mom.sw
    c = mom.centered(features) / n
    cy = mom.centered(features, [target])[:, 0] / n
    sd = np.sqrt(np.diag(c))
    cs = c / np.outer(sd, sd)
    cys = cy / sd
    b = np.zeros(len(features))
    for _ in range(iters):
        old = b.copy()
        for j in range(len(b)):
            rj = cys[j] - cs[j] @ b + cs[j, j] * b[j]
            b[j] = np.sign(rj) * max(abs(rj) - lam, 0.0) / cs[j, j]
        if np.max(np.abs(b - old)) < 1e-12 * max(1.0, np.max(np.abs(b))):
            break
    else:
        warnings.warn(f"LASSO did not settle in {iters} sweeps", stacklevel=2)
    coef = b / sd
    b0 = mom.mean([target])[0] - mom.mean(features) @ coef
    return np.concatenate([[b0], coef])


def learning_curve(df: DataFrame, target: str, features: list[str], key_cols: list[str],
                   shares=(0.1, 0.25, 0.5, 1.0), test_share: float = 0.2) -> list[dict]:
    """Nested hash samples -> grouped GRAM; train/test RMSE per share."""
    data = design(df, target, features, extra=key_cols)
    u = (F.pmod(F.xxhash64(F.lit(7), *[F.col(c) for c in key_cols]), F.lit(1_000_000)) / F.lit(1e6))
    grid = sorted(shares)
    bucket = F.when(u < test_share, F.lit(-1))
    for i, s in enumerate(grid):
        bucket = bucket.when(u < test_share + (1 - test_share) * s, F.lit(i))
    names = list(features) + [target]
    rows = grouped_gram(data.withColumn("_g", bucket), ["_g"], names).collect()
    moms = {r["_g"]: moments_from_row(r, names) for r in rows if r["_g"] is not None}
    test = moms.get(-1)
    out = []
    acc = None
    for i, s in enumerate(grid):
        if i in moms:
            acc = moms[i] if acc is None else acc + moms[i]
        if acc is None or test is None:
            continue
        beta, _, ssr, _ = solve_moments(acc, target, features)
        z = np.concatenate([[-beta[0]], -beta[1:], [1.0]])
        sse = float(z @ test.raw(names) @ z)
        out.append({"share": s, "n_train": acc.n, "train_rmse": math.sqrt(ssr / acc.n),
                    "test_rmse": math.sqrt(max(sse, 0) / test.n)})
    return out


def metrics_frame(spark: SparkSession, d: dict) -> DataFrame:
    return spark.createDataFrame([(k, sig(float(v))) for k, v in d.items() if isinstance(v, (int, float))],
                                 METRIC_SCHEMA)


def ks_two_sample(a: DataFrame, b: DataFrame, col: str) -> dict:
    """Two-sample KS -- counts by value from both sides, global prefix sums, max gap."""
    va = a.select(F.col(col).cast("double").alias("v")).dropna().groupBy("v").agg(
        F.count(F.lit(1)).cast("double").alias("ca"))
    vb = b.select(F.col(col).cast("double").alias("v")).dropna().groupBy("v").agg(
        F.count(F.lit(1)).cast("double").alias("cb"))
    both = va.join(vb, "v", "full").fillna(0.0, ["ca", "cb"]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tot = both.agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb")).collect()[0]
        na, nb = tot["na"], tot["nb"]
        go = GlobalOrder(both, ["v"])
        run = go.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # per bucket: counts and the extremes of the local gap; the global gap is local + offset,
        # so max |gap| is read from the per-bucket extremes (at most n_buckets rows)
        gap = F.col("_a") / F.lit(na) - F.col("_bb") / F.lit(nb)
        rows = bucket_reduce(go, {"_a": F.sum("ca").over(run), "_bb": F.sum("cb").over(run)},
                             [F.sum("ca").alias("A"), F.sum("cb").alias("B"), F.max(gap).alias("hi"),
                              F.min(gap).alias("lo")])
    finally:
        both.unpersist()
    d, oa, ob = 0.0, 0.0, 0.0
    for r in rows:
        off = oa / na - ob / nb
        d = max(d, abs(r["hi"] + off), abs(r["lo"] + off))
        oa += r["A"]
        ob += r["B"]
    return {"ks_stat": d, "p_value": dist.ks_two_sample_p(d, na, nb), "n_a": na, "n_b": nb}


# ------------------------------------------------------------------ E16
def bootstrap_632(df: DataFrame, target: str, features: list[str], key_cols: list[str], B: int = 50,
                  seed: int = 17) -> dict:
    """.632 and .632+ bootstrap error of OLS from one pass without multiplying rows
    (:func:`poisson_grams`): per replicate a weighted Gram of the in-bag rows and a Gram of the
    out-of-bag rows, whose SSE is read with the in-bag beta. The no-information error
    of .632+ pairs every response with every prediction; it follows from the full Gram."""
    data = design(df, target, features, extra=key_cols)
    names = list(features) + [target]
    g = poisson_grams(data, names, key_cols, B, seed, out_of_bag=True).collect()
    moms = {(r["_r"], r["_oob"]): moments_from_row(r, names) for r in g}
    full = gram(data, names)
    beta_full, _, ssr_full, _ = solve_moments(full, target, features)
    err_train = ssr_full / full.n
    oob_errs = []
    for b in range(1, B + 1):
        tr, te = moms.get((b, 0)), moms.get((b, 1))
        if tr is None or te is None or te.n == 0:
            continue
        beta, _, _, _ = solve_moments(tr, target, features)
        z = np.concatenate([[-beta[0]], -beta[1:], [1.0]])
        oob_errs.append(float(z @ te.raw(names) @ z) / te.sw)
    err_oob = float(np.mean(oob_errs))
    b = np.asarray(beta_full, dtype=float)
    raw = full.raw(list(features))  # [1, x]' [1, x]
    y_mean = full.mean([target])[0]
    y_sq = full.m[full.idx([target])[0], full.idx([target])[0]] / full.n
    no_info = y_sq - 2 * y_mean * float(raw[0] @ b) / full.n + float(b @ raw @ b) / full.n
    over = min(max((err_oob - err_train) / (no_info - err_train), 0.0), 1.0) if no_info > err_train else 0.0
    w = 0.632 / (1 - 0.368 * over)
    return {"err_train": err_train, "err_oob": err_oob, "err_632": 0.368 * err_train + 0.632 * err_oob,
            "err_632_plus": (1 - w) * err_train + w * min(err_oob, no_info), "no_information": no_info,
            "replicates": len(oob_errs)}


def nested_cv_ridge(df: DataFrame, target: str, features: list[str], outer: Column, inner: Column,
                    lambdas: list[float]) -> list[dict]:
    """Nested CV for the ridge penalty from ONE grouped GRAM by (outer, inner) fold:
    every train / validation / test Gram is a sum of cells."""
    data = design(df.withColumn("_o", outer).withColumn("_i", inner), target, features, extra=["_o", "_i"])
    names = list(features) + [target]
    cells = {(r["_o"], r["_i"]): moments_from_row(r, names)
             for r in _collect_bounded(grouped_gram(data, ["_o", "_i"], names), "fold cells")}

    def total(keys):
        acc = None
        for k in keys:
            acc = cells[k] if acc is None else acc + cells[k]
        return acc

    def ridge_beta(m, lam):
        c = m.centered(features)
        cy = m.centered(features, [target])[:, 0]
        sd = np.sqrt(np.diag(c) / m.sw)
        bs = np.linalg.solve(c / np.outer(sd, sd) + lam * np.eye(len(features)), cy / sd)
        b = bs / sd
        return np.concatenate([[m.mean([target])[0] - m.mean(features) @ b], b])

    def sse(m, beta):
        z = np.concatenate([[-beta[0]], -beta[1:], [1.0]])
        return float(z @ m.raw(names) @ z)

    outs = sorted({k[0] for k in cells})
    res = []
    for o in outs:
        test = total([k for k in cells if k[0] == o])
        inners = sorted({k[1] for k in cells if k[0] != o})
        scores = []
        for lam in lambdas:
            s = 0.0
            for i in inners:
                val = total([k for k in cells if k[0] != o and k[1] == i])
                tr = total([k for k in cells if k[0] != o and k[1] != i])
                s += sse(val, ridge_beta(tr, lam))
            scores.append(s)
        best = lambdas[int(np.argmin(scores))]
        train = total([k for k in cells if k[0] != o])
        beta = ridge_beta(train, best)
        res.append({"outer": o, "lambda": best, "test_rmse": math.sqrt(sse(test, beta) / test.sw), "n_test": test.n})
    return res


def repeated_cv_linear(df: DataFrame, target: str, features: list[str], key_cols: list[str], k: int = 5,
                       repeats: int = 3, strata: str | None = None, seed: int = 42) -> list[dict]:
    """Repeated (optionally stratified) k-fold CV of OLS in ONE pass: rows are exploded
    over the repeats, each repeat assigns hash folds (within ``strata`` the fold is the
    hash of the key and the stratum, so every stratum is split over all folds), and one
    grouped GRAM by (repeat, fold) yields all R x k train/test splits."""
    data = design(df, target, features, extra=list(key_cols) + ([strata] if strata else []))
    rep = data.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    hkeys = [F.col("_rep")] + [F.col(c) for c in key_cols] + ([F.col(strata)] if strata else [])
    rep = rep.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *hkeys), F.lit(k)).cast("int"))
    names = list(features) + [target]
    rows = _collect_bounded(grouped_gram(rep, ["_rep", "_fold"], names), "repeat x fold cells")
    cells = {(r["_rep"], r["_fold"]): moments_from_row(r, names) for r in rows}
    out = []
    for r_id in range(1, repeats + 1):
        folds = {f: m for (rr, f), m in cells.items() if rr == r_id}
        total = None
        for m in folds.values():
            total = m if total is None else total + m
        sse, n = 0.0, 0
        for f, m in folds.items():
            beta, _, _, _ = solve_moments(total - m, target, features)
            z = np.concatenate([[-beta[0]], -beta[1:], [1.0]])
            sse += float(z @ m.raw(names) @ z)
            n += m.n
        out.append({"repeat": r_id, "rmse": math.sqrt(max(sse, 0.0) / n), "n": n})
    return out
