"""Monitoring (W1-W5, W9): drift, decay, regime change, model age and the
retrain decision table, all as aggregates over the scored tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import GlobalOrder
from .evaluate import bin_column, exact_cuts, ks_two_sample
from ..session import shared_folder

__all__ = ["ks_two_sample", "psi", "auc_by_period", "auc_decay", "stale_models", "retrain_triggers"]


def psi(train: DataFrame, batch: DataFrame, col: str, bins: int = 10, eps: float = 1e-4) -> dict:
    """Population stability index over the training deciles (exact cuts)."""
    cuts = exact_cuts(train, col, bins)
    a = train.select(bin_column(col, cuts).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("na"))
    b = batch.select(bin_column(col, cuts).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("nb"))
    t = a.join(b, "bin", "full").fillna(0, ["na", "nb"])
    tot = t.agg(F.sum("na").alias("A"), F.sum("nb").alias("B")).collect()[0]
    sa = F.greatest(F.col("na") / F.lit(tot["A"]), F.lit(eps))
    sb = F.greatest(F.col("nb") / F.lit(tot["B"]), F.lit(eps))
    v = t.agg(F.sum((sb - sa) * F.log(sb / sa))).collect()[0][0]
    return {"psi": v, "bins": len(set(cuts)) + 1}


def auc_by_period(df: DataFrame, y, score, period: Column) -> DataFrame:
    """Exact AUC per period: counts by (period, score), running negatives over the period-led
    global order (a hot period is split across tasks), less those before the period."""
    g = (df.select(period.alias("period"), F.col(y).cast("double").alias("y") if isinstance(y, str) else y.alias("y"),
                   (F.col(score) if isinstance(score, str) else score).cast("double").alias("s")).dropna()
         .groupBy("period", "s").agg(F.sum("y").alias("pos"), F.sum(F.lit(1.0) - F.col("y")).alias("neg")))
    path = shared_folder(g.sparkSession, "auc-by-period")  # read by the cut, edge and window passes
    g.write.parquet(path)
    g = g.sparkSession.read.parquet(path)
    c = GlobalOrder(g, ["period", "s"]).with_running_sums(["neg"])
    t = c.groupBy("period").agg(
        F.sum(F.col("pos") * (F.col("neg_cum") - F.lit(0.5) * F.col("neg"))).alias("u"), F.sum("pos").alias("p"),
        F.sum("neg").alias("q"), F.min(F.col("neg_cum") - F.col("neg")).alias("before"))
    return t.select("period", F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("u") - F.col("p") * F.col("before")) / (F.col("p") * F.col("q")))
                    .alias("auc"), (F.col("p") + F.col("q")).cast("long").alias("n"))


def auc_decay(df: DataFrame, y, score, period: Column, floor: float = 0.65, runs: int = 3) -> DataFrame:
    """Per-period AUC, low flag and the length of the current run of low periods
    (gaps and islands over the per-period table, one row per period)."""
    a = auc_by_period(df, y, score, period).withColumn("low", F.col("auc") < F.lit(floor))
    w = Window.orderBy("period")  # over the per-period table only (one row per period)
    a = a.withColumn("_grp", F.sum(F.when(~F.col("low"), 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r = Window.partitionBy("_grp", "low").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = a.withColumn("low_run", F.when(F.col("low"), F.count(F.lit(1)).over(r)).otherwise(F.lit(0)).cast("int"))
    return a.withColumn("alarm", F.col("low_run") >= F.lit(runs)).drop("_grp")


def stale_models(registry: DataFrame, days: int = 90, now: Column | None = None) -> DataFrame:
    """Models older than ``days`` at ``now`` (default: current date)."""
    now = now if now is not None else F.current_date()
    return registry.select("model_id", "trained_at",
                           F.datediff(now, F.to_date("trained_at")).alias("age_days")).withColumn(
        "stale", F.col("age_days") > F.lit(days))


def retrain_triggers(drift: dict, decay: DataFrame | None, cusum: dict | None, age_days: int | None,
                     alpha: float = 0.05, max_age: int = 90) -> list[tuple]:
    """One row per trigger -- drift (KS p), decay (alarm), regime (CUSUM p), calendar (age)."""
    rows = [("drift", float(drift.get("p_value", math.nan)), bool(drift.get("p_value", 1.0) < alpha))]
    if decay is not None:
        alarms = decay.agg(F.max(F.col("alarm").cast("int"))).collect()[0][0] or 0
        rows.append(("decay", float(alarms), bool(alarms)))
    if cusum is not None:
        rows.append(("regime", float(cusum["p_value"]), bool(cusum["p_value"] < alpha)))
    if age_days is not None:
        rows.append(("calendar", float(age_days), age_days > max_age))
    return rows
