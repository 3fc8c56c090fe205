"""Report tables (V1-V8): the data behind each diagnostic plot as a tidy
DataFrame, and the (section, key, value) report record with verdicts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import sig
from .evaluate import bin_column, exact_cuts
from .linear import LinearFit, design


def _resid_frame(df: DataFrame, fit: LinearFit) -> DataFrame:
    return design(df, fit.target, fit.features).select(fit.linear_predictor().alias("fitted"),
                                                       fit.residual().alias("resid"))


def resid_vs_fitted(df: DataFrame, fit: LinearFit, bins: int = 10) -> DataFrame:
    """V1: mean residual per fitted-value quantile bin (replaces the LOWESS line)."""
    r = _resid_frame(df, fit)
    cuts = exact_cuts(r, "fitted", bins)
    return (r.withColumn("bin", bin_column("fitted", cuts)).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("fitted").alias("mean_fitted"), F.avg("resid").alias("mean_resid")))


def scale_location(df: DataFrame, fit: LinearFit, bins: int = 10) -> DataFrame:
    """V3: mean sqrt(|standardised residual|) per fitted bin."""
    s = math.sqrt(fit.sigma2)
    r = _resid_frame(df, fit).withColumn("sl", F.sqrt(F.abs(F.col("resid") / F.lit(s))))
    cuts = exact_cuts(r, "fitted", bins)
    return (r.withColumn("bin", bin_column("fitted", cuts)).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("fitted").alias("mean_fitted"), F.avg("sl").alias("mean_sqrt_abs")))


def qq_points(df: DataFrame, fit: LinearFit, points: int = 20) -> DataFrame:
    """V2: sample residual quantiles (exact, lower) vs normal quantiles at i/points."""
    r = _resid_frame(df, fit)
    cuts = exact_cuts(r, "resid", points)
    rows = [(i / points, sig(c), sig(dist.norm_ppf(i / points))) for i, c in enumerate(cuts, start=1)]
    return df.sparkSession.createDataFrame(rows, "p double, sample_q double, theoretical_q double")


def resid_histogram(df: DataFrame, fit: LinearFit, bins: int = 30) -> DataFrame:
    """V5: equal-width histogram of residuals with the fitted normal density count per bin."""
    r = _resid_frame(df, fit)
    st = r.agg(F.min("resid").alias("lo"), F.max("resid").alias("hi"), F.count(F.lit(1)).alias("n"),
               F.stddev_pop("resid").alias("sd"), F.avg("resid").alias("mu")).collect()[0]
    lo, hi, n = st["lo"], st["hi"], st["n"]
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("resid") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    h = r.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    center = F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit(width)
    z = (center - F.lit(st["mu"])) / F.lit(st["sd"])
    dens = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi) * st["sd"]) * F.lit(n * width)
    return h.select("bin", center.alias("center"), "count", dens.alias("normal_count"))


def report_record(spark: SparkSession, model_id: str, parts: dict[str, list[tuple]]) -> DataFrame:
    """V7: union of tidy parts as (section, key, value, verdict) rows."""
    rows = []
    for section, items in parts.items():
        for it in items:
            key, value = it[0], it[1]
            verdict = it[2] if len(it) > 2 else None
            rows.append((model_id, section, str(key), None if value is None else float(value), verdict))
    return spark.createDataFrame(rows, "model_id string, section string, key string, value double, verdict string")


def fit_verdict(r2: float, n: int) -> str:
    """Quality wording thresholds kept as a verdict column (no prose)."""
    size = "large_sample" if n > 10000 else "moderate_sample" if n >= 100 else "small_sample"
    fit = "strong" if r2 >= 0.7 else "moderate" if r2 >= 0.3 else "weak"
    return f"{fit}|{size}"


def forecast_vs_actual(df: DataFrame, col: str, series, order_by, cutoff, p: int = 1, q: int = 0,
                       horizon: int = 5) -> DataFrame:
    """V8: fit ARIMA(p, 0, q) per series on rows before ``cutoff`` (a boolean Column on the
    order), forecast ``horizon`` steps and join the first ``horizon`` held-out rows of each
    series by step. Held-out positions come from the series-led global order (row index
    minus the series' first held-out index), so no series is sorted in one task."""
    from ..plans.order import series_lags
    from .series import arima_hr
    series = [series] if isinstance(series, str) else list(series)
    ob = [order_by] if isinstance(order_by, str) else list(order_by)
    train = df.where(cutoff)
    hold = df.where(~cutoff).select(*series, *ob, F.col(col).cast("double").alias("actual"))
    _, fc = arima_hr(train, col, series, ob, p=p, d=0, q=q, horizon=horizon)
    idx = series_lags(hold, series, ob, [], 1)
    first = idx.groupBy(*series).agg(F.min("_idx").alias("_first"))
    steps = (idx.join(first, series).withColumn("step", (F.col("_idx") - F.col("_first") + 1).cast("int"))
             .where(F.col("step") <= horizon).select(*series, "step", "actual"))
    return fc.join(steps, series + ["step"], "left").withColumn("error", F.col("actual") - F.col("forecast"))
