"""Interpretation (T1-T15): marginal effects with delta-method SE, elasticities,
partial dependence, ICE, ordered-level effects, scenarios, attributions,
permutation importance and the Poisson bootstrap."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.columns import logistic, norm_cdf, norm_pdf, sig
from ..plans.gram import moments_from_row, poisson_grams
from ..plans.newton import lit_dot
from ..plans.selection import exact_quantiles
from .discrete import DiscreteFit, class_probabilities, inverse_link, probability
from .linear import LinearFit, design, solve_moments

EFFECT_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("effect", T.DoubleType()),
    T.StructField("se", T.DoubleType()), T.StructField("z_stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType())])


def _f_and_fprime(family: str, eta: Column) -> tuple[Column, Column]:
    """Density of the link and its derivative (d mu / d eta, d2 mu / d eta2)."""
    if family == "logit":
        p = logistic(eta)
        return p * (F.lit(1.0) - p), p * (F.lit(1.0) - p) * (F.lit(1.0) - F.lit(2.0) * p)
    if family == "probit":
        return norm_pdf(eta), -eta * norm_pdf(eta)
    if family in ("poisson", "negbin"):
        return F.exp(eta), F.exp(eta)
    return F.lit(1.0), F.lit(0.0)


def _f_py(family: str, eta: float) -> tuple[float, float]:
    if family == "logit":
        p = 1 / (1 + math.exp(-eta))
        return p * (1 - p), p * (1 - p) * (1 - 2 * p)
    if family == "probit":
        f = math.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
        return f, -eta * f
    if family in ("poisson", "negbin"):
        return math.exp(eta), math.exp(eta)
    return 1.0, 0.0


def _rows(terms, eff, cov):
    out = []
    for t, e, v in zip(terms, eff, np.diag(cov)):
        s = math.sqrt(max(v, 0.0))
        z = e / s if s > 0 else math.nan
        out.append((t, sig(e), sig(s), sig(z), sig(2 * dist.norm_sf(abs(z))) if s > 0 else None))
    return out


def average_marginal_effects(df: DataFrame, fit: DiscreteFit) -> list[tuple]:
    """AME_j = mean f(x'b) b_j; Jacobian mean[f e_j + f' b_j x'] in ONE aggregate."""
    feats = fit.features
    k = len(feats) + 1
    xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in feats]
    d = df.dropna(subset=list(feats)).withColumn("_eta", fit.linear_predictor())
    f, fp = _f_and_fprime(fit.family, F.col("_eta"))
    d = d.withColumn("_f", f).withColumn("_fp", fp)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_f").alias("sf")]
    aggs += [F.sum(F.col("_fp") * x).alias(f"g{m}") for m, x in enumerate(xs)]
    r = d.agg(*aggs).collect()[0]
    n = r["n"]
    mf = r["sf"] / n
    g = np.array([r[f"g{m}"] / n for m in range(k)])
    b = fit.theta[:k]
    eff = b[1:] * mf
    J = np.zeros((k - 1, k))
    for j in range(1, k):
        J[j - 1, j] += mf
        J[j - 1] += b[j] * g
    return _rows(feats, eff, J @ fit.cov[:k, :k] @ J.T)


def effects_at(df: DataFrame, fit: DiscreteFit, at: str = "mean") -> list[tuple]:
    """T1 (at='mean', MEM) and T3 (at='median' / 'mode'): effects at one profile."""
    feats = fit.features
    k = len(feats) + 1
    if at == "mean":
        r = df.dropna(subset=feats).agg(*[F.avg(c).alias(c) for c in feats]).collect()[0]
    elif at == "median":
        r = {c: v[0] for c, v in exact_quantiles(df.dropna(subset=feats), feats, [0.5]).items()}
    elif at == "mode":
        r = df.dropna(subset=feats).agg(*[F.mode(c).alias(c) for c in feats]).collect()[0]
    else:
        raise ValueError(at)
    x = np.array([1.0] + [float(r[c]) for c in feats])
    b = fit.theta[:k]
    eta = float(x @ b)
    f, fp = _f_py(fit.family, eta)
    eff = b[1:] * f
    J = np.zeros((k - 1, k))
    for j in range(1, k):
        J[j - 1, j] = f
        J[j - 1] += b[j] * fp * x
    return _rows(feats, eff, J @ fit.cov[:k, :k] @ J.T)


def effects_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, EFFECT_SCHEMA)


def importance_rank(rows: list[tuple]) -> list[tuple]:
    """Rank terms by absolute effect."""
    return [(i + 1, r[0], r[1]) for i, r in enumerate(sorted(rows, key=lambda r: -abs(r[1] or 0)))]


def elasticities(fit: LinearFit) -> list[tuple]:
    """T5: b_j * mean(x_j) / mean(y) from the fit's own Gram (no pass)."""
    mom = fit.moments
    ybar = mom.mean([fit.target])[0]
    return [(c, sig(b * mom.mean([c])[0] / ybar)) for c, b in zip(fit.features, fit.beta[1:])]


def _grid(df: DataFrame, feature: str, points: int) -> list[float]:
    """Even points from the smallest to the largest value of a feature."""
    r = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi")).first()
    lo, hi = float(r["lo"]), float(r["hi"])
    return [lo + (hi - lo) * i / (points - 1) for i in range(points)]


def partial_dependence(df: DataFrame, fit, feature: str, grid: int = 20, score=None) -> DataFrame:
    """Average prediction with ``feature`` set to each of ``grid`` points min..max.

    A fit with an index enters by its index without the feature, once per row; every grid point is
    one more average in the same aggregate, so rows are not multiplied. With a ``score`` of one's own
    (a function of the fit) the grid is exploded per row and averaged by partial aggregation.
    """
    feats = fit.features
    pts = _grid(df, feature, grid)
    d = df.dropna(subset=list(feats))
    if score is None:
        slope = float(fit.theta[feats.index(feature) + 1] if isinstance(fit, DiscreteFit) else fit.beta[feats.index(feature) + 1])
        mean = inverse_link(fit) if isinstance(fit, DiscreteFit) else None
        rest = d.select((fit.linear_predictor() - F.lit(slope) * F.col(feature).cast("double")).alias("_rest"))
        if isinstance(fit, DiscreteFit):
            one = rest.agg(*[F.avg(mean(F.col("_rest") + F.lit(slope * v))).alias(f"_a{i}") for i, v in enumerate(pts)])
        else:  # the mean goes through
            one = rest.agg(F.avg("_rest").alias("_m")).select(*[(F.col("_m") + F.lit(slope * v)).alias(f"_a{i}") for i, v in enumerate(pts)])
        rows = [F.struct(F.lit(i).alias("grid_index"), F.lit(v).alias("grid_value"), F.col(f"_a{i}").alias("partial_dependence")) for i, v in enumerate(pts)]
        return one.select(F.explode(F.array(*rows)).alias("_g")).select("_g.*")
    d = d.select(*feats).withColumn("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(pts)])))
    d = d.withColumn(feature, F.col("_g.v")).withColumn("grid_index", F.col("_g.i"))
    return (d.withColumn("_s", score(fit)).groupBy("grid_index")
            .agg(F.first(feature).alias("grid_value"), F.avg("_s").alias("partial_dependence")))


def ice(df: DataFrame, fit, feature: str, id_col: str, grid: int = 20, ids: DataFrame | list | None = None) -> DataFrame:
    """Per-row curves (the PDP before averaging) on the grid of all rows, for the rows whose ``id_col`` is in
    ``ids`` (values, or a table with that column); all rows where it is None."""
    feats = fit.features
    pts = _grid(df, feature, grid)
    d = df.dropna(subset=list(feats)).select(id_col, *feats)
    if isinstance(ids, DataFrame):
        d = d.join(ids.select(id_col).distinct(), id_col, "left_semi")
    elif ids is not None:
        d = d.where(F.col(id_col).isin(list(ids)))
    d = d.withColumn(feature, F.explode(F.array(*[F.lit(v) for v in pts])))
    return d.select(id_col, F.col(feature).alias("grid_value"), _default_score(fit).alias("prediction"))


def _default_score(fit) -> Column:
    if isinstance(fit, LinearFit):
        return fit.linear_predictor()
    from .discrete import probability
    return probability(fit)


def effects_by_level(df: DataFrame, fit: DiscreteFit) -> list[tuple]:
    """AME of each feature on P(Y = j) for an ordered model (sums to 0 over j)."""
    feats = fit.features
    kx = len(feats)
    f = (lambda z: logistic(z) * (F.lit(1.0) - logistic(z))) if fit.family.endswith("logit") else norm_pdf
    xb = lit_dot(fit.theta[:kx], [F.col(c).cast("double") for c in feats])
    taus = list(fit.theta[kx:])
    d = df.dropna(subset=feats).withColumn("_xb", xb)
    dens = [f(F.lit(float(t)) - F.col("_xb")) for t in taus]
    J = len(taus) + 1
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(e).alias(f"d{j}") for j, e in enumerate(dens)]
    r = d.agg(*aggs).collect()[0]
    n = r["n"]
    md = [r[f"d{j}"] / n for j in range(len(taus))]
    out = []
    for i, c in enumerate(feats):
        b = fit.theta[i]
        for j in range(J):
            upper = md[j] if j < J - 1 else 0.0
            lower = md[j - 1] if j > 0 else 0.0
            out.append((c, str(fit.classes[j]), sig(-b * (upper - lower))))
    return out


def probability_curves(df: DataFrame, fit: DiscreteFit, feature: str, grid: int = 20) -> DataFrame:
    """Average P(Y = k) along a grid of ``feature`` (a PDP per class). Ordered fits average the cumulative
    shares of all grid points in one aggregate over the index without the feature; others explode the grid."""
    feats = fit.features
    pts = _grid(df, feature, grid)
    d = df.dropna(subset=list(feats))
    if fit.family.startswith("ordered"):
        kx = len(feats)
        slope, cuts = float(fit.theta[feats.index(feature)]), [float(t) for t in fit.theta[kx:]]
        cdf = logistic if fit.family.endswith("logit") else norm_cdf
        rest = d.select((lit_dot(fit.theta[:kx], [F.col(c).cast("double") for c in feats]) - F.lit(slope) * F.col(feature).cast("double")).alias("_rest"))
        one = rest.agg(*[F.avg(cdf(F.lit(t - slope * v) - F.col("_rest"))).alias(f"_a{i}_{j}") for i, v in enumerate(pts) for j, t in enumerate(cuts)])
        rows = []
        for i, v in enumerate(pts):
            upto = [F.lit(0.0)] + [F.col(f"_a{i}_{j}") for j in range(len(cuts))] + [F.lit(1.0)]
            shares = F.array(*[b - a for a, b in zip(upto, upto[1:])])
            rows.append(F.struct(F.lit(i).alias("grid_index"), F.lit(v).alias("grid_value"), shares.alias("probabilities")))
        return one.select(F.explode(F.array(*rows)).alias("_g")).select("_g.*")
    d = d.select(*feats).withColumn("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(pts)])))
    d = d.withColumn(feature, F.col("_g.v")).withColumn("grid_index", F.col("_g.i"))
    d = d.withColumn("_p", class_probabilities(fit))
    K = fit.n_classes
    return (d.groupBy("grid_index").agg(F.first(feature).alias("grid_value"),
                                        *[F.avg(F.col("_p")[k]).alias(f"_a{k}") for k in range(K)])
            .select("grid_index", "grid_value", F.array(*[F.col(f"_a{k}") for k in range(K)]).alias("probabilities")))


def scenario(df: DataFrame, fit, shifts: dict[str, float]) -> DataFrame:
    """Base vs shifted mean prediction (shift each driver by the given amount)."""
    base = _default_score(fit)
    shifted = df
    for c, v in shifts.items():
        shifted = shifted.withColumn(c, F.col(c) + F.lit(v))
    b = df.dropna(subset=fit.features).agg(F.avg(base).alias("v")).collect()[0]["v"]
    s = shifted.dropna(subset=fit.features).agg(F.avg(_default_score(fit)).alias("v")).collect()[0]["v"]
    spark = df.sparkSession
    return spark.createDataFrame([("base", sig(b)), ("scenario", sig(s)), ("delta", sig(s - b))],
                                 "metric string, value double")


def linear_attributions(df: DataFrame, fit: LinearFit, keep: list[str] | None = None) -> DataFrame:
    """T13 (linear models): exact Shapley values b_j (x_j - mean x_j) per row."""
    mom = fit.moments
    cols = [F.col(c) for c in (keep or [])]
    att = [(F.lit(float(b)) * (F.col(c).cast("double") - F.lit(float(mom.mean([c])[0])))).alias(f"phi_{c}")
           for c, b in zip(fit.features, fit.beta[1:])]
    base = float(fit.beta[0] + sum(b * mom.mean([c])[0] for c, b in zip(fit.features, fit.beta[1:])))
    return df.dropna(subset=fit.features).select(*cols, *att, F.lit(base).alias("phi_base"))


def mean_abs_attribution(df: DataFrame, fit: LinearFit) -> DataFrame:
    a = linear_attributions(df, fit)
    return a.agg(*[F.avg(F.abs(f"phi_{c}")).alias(c) for c in fit.features])


def permutation_importance(df: DataFrame, fit: LinearFit, key: str, seed: int = 11) -> list[tuple]:
    """MSE increase when a feature's values are re-joined through a hash-permuted index."""
    from ..plans.order import GlobalOrder
    base_mse = fit.ssr / fit.n
    data = design(df, fit.target, fit.features, extra=[key])
    # one permuted index and one join serve all features: row i of the key order lends its
    # values to row i of the hash order
    other = {c: f"_o{j}" for j, c in enumerate(fit.features)}
    idx = GlobalOrder(data.select(key, *[F.col(c).alias(o) for c, o in other.items()]), [key]).with_running_sums([]).select(
        F.col("_idx").alias("_i"), *other.values())
    perm = GlobalOrder(data.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))), ["_h", key]).with_running_sums([]).select(
        F.col("_idx").alias("_i"), fit.target, *fit.features)
    joined = perm.join(idx, "_i")
    swapped = []
    for c in fit.features:
        pred = fit.linear_predictor() + F.lit(float(fit.beta[fit.features.index(c) + 1])) * (F.col(other[c]) - F.col(c).cast("double"))
        swapped.append(F.avg((F.col(fit.target) - pred) ** 2).alias(other[c]))
    mse = joined.agg(*swapped).first()
    return [(c, sig(mse[other[c]] - base_mse)) for c in fit.features]


def poisson_bootstrap_effects(df: DataFrame, fit: DiscreteFit, key_cols: list[str], B: int = 500, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """T9 for logit models: Poisson bootstrap of the effects at the mean. A replicate's coefficients are one
    IRLS step from the fit (weighted least squares of the working response), so all replicates come from
    one pass of weighted Grams (:func:`poisson_grams`); its means are the weighted means of its rows."""
    feats, p = list(fit.features), probability(fit)
    w = p * (F.lit(1.0) - p)
    d = df.dropna(subset=[fit.target, *feats]).withColumn("_w", w)
    root = F.sqrt("_w")
    work = {"_z": root * fit.linear_predictor() + (F.col(fit.target).cast("double") - p) / root, "_x0": root}
    work.update({f"_x{j}": root * F.col(c).cast("double") for j, c in enumerate(feats, start=1)})
    work.update({f"_m{j}": F.col(c).cast("double") for j, c in enumerate(feats, start=1)})
    names = list(work)
    g = poisson_grams(d.select(*key_cols, *[e.alias(n) for n, e in work.items()]), names, list(key_cols), B, seed)
    xs = [f"_x{j}" for j in range(len(feats) + 1)]

    def solve(it):
        import pandas as pd
        for pdf in it:
            out = []
            for _, row in pdf.iterrows():
                mom = moments_from_row(row.to_dict(), names)
                b = np.linalg.solve(mom.m[np.ix_(mom.idx(xs), mom.idx(xs))], mom.m[np.ix_(mom.idx(xs), mom.idx(["_z"]))][:, 0])
                eta = b @ np.r_[1.0, mom.mean([f"_m{j}" for j in range(1, len(xs))])]
                f = np.exp(-abs(eta)) / (1 + np.exp(-abs(eta))) ** 2
                out += [(int(row["_r"]), c, float(v * f)) for c, v in zip(feats, b[1:])]
            yield pd.DataFrame(out, columns=["replicate", "term", "effect"])

    reps = g.mapInPandas(solve, "replicate int, term string, effect double")
    ends = [F.percentile_approx("effect", q, 10000) for q in (alpha / 2, 1 - alpha / 2)]  # of B values a term
    return reps.groupBy("term").agg(F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("se"), ends[0].alias("ci_lower"), ends[1].alias("ci_upper"))


def poisson_bootstrap_linear(df: DataFrame, target: str, features: list[str], B: int = 200,
                             key_cols: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Poisson bootstrap -- B weighted Grams in one pass (:func:`poisson_grams`, rows are not
    multiplied); percentile CI per coefficient over the B solved replicates."""
    data = design(df, target, features, extra=key_cols or [])
    names = list(features) + [target]
    g = poisson_grams(data, names, list(key_cols or names), B, seed)
    schema = T.StructType([T.StructField("replicate", T.IntegerType()), T.StructField("term", T.StringType()),
                           T.StructField("coefficient", T.DoubleType())])

    def solve(it):
        import pandas as pd
        for pdf in it:
            out = []
            for _, row in pdf.iterrows():
                mom = moments_from_row(row.to_dict(), names)
                beta, _, _, _ = solve_moments(mom, target, features)
                for t, b in zip(["const"] + list(features), beta):
                    out.append((int(row["_r"]), t, float(b)))
            yield pd.DataFrame(out, columns=["replicate", "term", "coefficient"])

    reps = g.mapInPandas(solve, schema)
    return reps.groupBy("term").agg(F.avg("coefficient").alias("mean"), F.stddev_samp("coefficient").alias("se"),
                                    F.percentile_approx("coefficient", 0.025, 10000).alias("ci_lower"),
                                    F.percentile_approx("coefficient", 0.975, 10000).alias("ci_upper"))
