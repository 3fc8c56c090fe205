"""Prediction (P1-P9): scoring is a pure column expression (SCORE), lazy and
distributed; intervals use new-row leverage as a quadratic form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import dist
from .discrete import DiscreteFit, class_probabilities, inverse_link, probability
from .linear import LinearFit


def predict_linear(fit: LinearFit, df: DataFrame, interval: str | None = None, alpha: float = 0.05,
                   keep: list[str] | None = None, model_id: str | None = None,
                   observation: Observation | None = None) -> DataFrame:
    """Prediction, optional mean or observation interval.

    Rows with a missing feature are skipped; their count is an ``observe``
    metric (``skipped``) filled by the first action on the result.
    """
    feats = fit.features
    missing = [c for c in feats if c not in df.columns]
    if missing:
        raise ValueError(f"Columns not found in prediction data: {missing}")
    bad = None
    for c in feats:
        cond = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        bad = cond if bad is None else bad | cond
    if observation is not None:
        df = df.observe(observation, F.sum(bad.cast("long")).alias("skipped"), F.count(F.lit(1)).alias("rows"))
    d = df.where(~bad)
    cols = [F.col(c) for c in (keep or [])]
    pred = fit.linear_predictor()
    out = d.select(*cols, pred.alias("prediction"), *[F.col(c) for c in feats if c not in (keep or [])])
    if interval:
        crit = dist.t_ppf(1 - alpha / 2, fit.df_resid) if fit.use_t else dist.norm_ppf(1 - alpha / 2)
        se_mean = fit.mean_se()
        if interval == "mean":
            se = se_mean
        elif interval == "obs":
            se = F.sqrt(se_mean * se_mean + F.lit(fit.sigma2))
        else:
            raise ValueError("interval must be 'mean' or 'obs'")
        out = (out.withColumn("se", se)
               .withColumn("ci_lower", F.col("prediction") - F.lit(crit) * F.col("se"))
               .withColumn("ci_upper", F.col("prediction") + F.lit(crit) * F.col("se")))
    out = out.drop(*[c for c in feats if c not in (keep or [])])
    if model_id is not None:
        out = out.withColumn("model_id", F.lit(model_id)).withColumn("predicted_at", F.current_timestamp())
    return out


def predict_discrete(fit: DiscreteFit, df: DataFrame, interval: bool = False, alpha: float = 0.05,
                     keep: list[str] | None = None) -> DataFrame:
    """Probability (binary), class-probability array (ordered / multinomial),
    delta-method CI on the link scale mapped through the inverse link."""
    feats = [*fit.features, *([fit.extra["offset"]] if fit.extra.get("offset") else [])]
    d = df.dropna(subset=list(feats))
    cols = [F.col(c) for c in (keep or [])]
    if fit.family.startswith("ordered") or fit.family == "mnlogit":
        probs = class_probabilities(fit)
        out = d.select(*cols, probs.alias("probabilities"))
        return out.withColumn("predicted_class", F.array_position(F.col("probabilities"),
                                                                  F.array_max("probabilities")) - F.lit(1))
    out = d.select(*cols, *[F.col(c) for c in feats if c not in (keep or [])],
                   probability(fit).alias("prediction"), fit.linear_predictor().alias("_eta"))
    if interval:
        k = len(fit.features) + 1
        x = [F.lit(1.0)] + [F.col(c).cast("double") for c in fit.features]
        q = None
        for i in range(k):
            for j in range(i, k):
                t = F.lit(float(fit.cov[i, j] * (1 if i == j else 2))) * x[i] * x[j]
                q = t if q is None else q + t
        z = dist.norm_ppf(1 - alpha / 2)
        se = F.sqrt(F.greatest(q, F.lit(0.0)))
        inv = inverse_link(fit)
        ends = [inv(F.col("_eta") - F.lit(z) * se), inv(F.col("_eta") + F.lit(z) * se)]
        if fit.link == "inverse":  # a falling link
            ends.reverse()
        out = out.withColumns({"se_link": se, "ci_lower": ends[0], "ci_upper": ends[1]})
    return out.drop("_eta", *[c for c in feats if c not in (keep or [])])


def z_crit(alpha: float) -> float:
    return dist.norm_ppf(1 - alpha / 2) if 0 < alpha < 1 else math.nan
