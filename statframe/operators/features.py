"""Feature preparation (F1-F16) as column expressions, small code tables and
grouped aggregates joined back (broadcast only where the table is bounded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scan import require

MAX_LEVELS = 1000


def listwise(df: DataFrame, cols: list[str]) -> DataFrame:
    """drop rows with null or NaN in any of ``cols``."""
    require(df, cols)
    return df.dropna(subset=cols)


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct levels; bounded (error above ``max_levels``)."""
    lv = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
          .limit(max_levels + 1).collect()]
    if len(lv) > max_levels:
        raise ValueError(f"{col!r} has more than {max_levels} levels")
    return lv


def dummies(df: DataFrame, col: str, drop_first: bool = True, prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """one 0/1 column per level (first sorted level dropped by default)."""
    lv = levels(df, col)
    use = lv[1:] if drop_first else lv
    p = prefix or col
    names = [f"{p}_{v}" for v in use]
    out = df.withColumns({n: F.when(F.col(col).isNull(), F.lit(None).cast("double"))
                          .otherwise((F.col(col) == F.lit(v)).cast("double")) for n, v in zip(names, use)})
    return out, names


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """0-based code by sorted level (code table is broadcast: bounded by MAX_LEVELS)."""
    lv = levels(df, col)
    spark = df.sparkSession
    codes = spark.createDataFrame([(v, i) for i, v in enumerate(lv)], [col, out or f"{col}_code"])
    return df.join(F.broadcast(codes), col, "left")


def ordinal_encode(df: DataFrame, col: str, order: list, out: str | None = None) -> DataFrame:
    """code by a user-given order."""
    code = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(order))):
        code = F.when(F.col(col) == F.lit(v), F.lit(i)).otherwise(code)
    return df.withColumn(out or f"{col}_ord", code)


def interact(df: DataFrame, a: str, b: str, out: str | None = None) -> DataFrame:
    """F8: a*b."""
    return df.withColumn(out or f"{a}_x_{b}", F.col(a).cast("double") * F.col(b).cast("double"))


def log1p(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """log(x + 1)."""
    return df.withColumn(out or f"log1p_{col}", F.log1p(F.col(col).cast("double")))


def scale(df: DataFrame, cols: list[str], how: str = "zscore") -> DataFrame:
    """z-score (population sd) or min-max from ONE aggregate, applied as literals."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"),
                 F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    r = df.agg(*aggs).collect()[0]
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        if how == "zscore":
            out[f"z_{c}"] = (x - F.lit(float(r[f"m_{c}"]))) / F.lit(float(r[f"s_{c}"]))
        else:
            out[f"mm_{c}"] = (x - F.lit(float(r[f"lo_{c}"]))) / F.lit(float(r[f"hi_{c}"] - r[f"lo_{c}"]))
    return df.withColumns(out)


def bin_edges(col, edges: list[float]) -> Column:
    """bin index over sorted edges: 0 below the first edge, i for [e_{i-1}, e_i)."""
    out = F.lit(0)
    for e in sorted(edges):
        out = out + (F.col(col) >= F.lit(float(e))).cast("int")
    return F.when(F.col(col).isNull(), F.lit(None).cast("int")).otherwise(out)


def nps3(col) -> Column:
    """NPS score 0-6 -> 0 (detractor), 7-8 -> 1 (passive), 9-10 -> 2 (promoter)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c.isNull(), F.lit(None).cast("int")).when(c <= 6, F.lit(0))
            .when(c <= 8, F.lit(1)).otherwise(F.lit(2)))


def strata_weights(sample: DataFrame, population: DataFrame, stratum: str) -> DataFrame:
    """weight = N_pop / N_sample per stratum (both sides aggregated first). Every stratum of either side is
    reported: one without sample rows has ``n_sample`` 0, one without population rows ``n_pop`` 0, both a null weight."""
    s = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_sample"))
    p = population.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_pop"))
    both = s.join(p, stratum, "full").fillna(0, ["n_sample", "n_pop"])
    return both.withColumn("weight", F.when((F.col("n_sample") > 0) & (F.col("n_pop") > 0), F.col("n_pop") / F.col("n_sample")))


def to_counts(df: DataFrame, y: str, cells: list[str]) -> DataFrame:
    """successes and trials per cell."""
    return df.groupBy(*cells).agg(F.sum(F.col(y).cast("double")).alias("successes"),
                                  F.count(F.lit(1)).alias("trials"))


def target_encode(df: DataFrame, col: str, y: str, folds: int = 5, smoothing: float = 10.0,
                  key_cols: list[str] | None = None, out: str | None = None, fold: Column | None = None) -> DataFrame:
    """out-of-fold smoothed target mean per category.

    Category x fold sums are aggregated once (partial aggregation); the
    out-of-fold value is (category total - own fold) shrunk toward the prior
    of the other folds. The per-category table is joined back by key (shuffle
    join; AQE splits skewed categories).
    """
    if fold is None:
        keys = key_cols or df.columns
        fold = F.pmod(F.xxhash64(F.lit(3), *[F.col(c) for c in keys]), F.lit(folds)).cast("int")
    d = df.withColumn("_fold", fold)
    yc = F.col(y).cast("double")
    cf = d.groupBy(col, "_fold").agg(F.sum(yc).alias("_s"), F.count(yc).alias("_n"))
    ct = cf.groupBy(col).agg(F.sum("_s").alias("_tot_s"), F.sum("_n").alias("_tot_n"))
    ff = d.groupBy("_fold").agg(F.sum(yc).alias("_fs"), F.count(yc).alias("_fn"))
    tot = d.agg(F.sum(yc).alias("ts"), F.count(yc).alias("tn")).collect()[0]
    enc = (cf.join(ct, col).join(F.broadcast(ff), "_fold")
           .withColumn("_prior", (F.lit(float(tot["ts"])) - F.col("_fs")) / (F.lit(float(tot["tn"])) - F.col("_fn")))
           .withColumn(out or f"te_{col}",
                       ((F.col("_tot_s") - F.col("_s")) + F.lit(smoothing) * F.col("_prior"))
                       / ((F.col("_tot_n") - F.col("_n")) + F.lit(smoothing)))
           .select(col, "_fold", out or f"te_{col}"))
    return d.join(enc, [col, "_fold"], "left").drop("_fold")


def child_features(parent: DataFrame, child: DataFrame, key: str, child_key: str | None = None,
                   cols: list[str] | None = None, aggs=("sum", "avg", "min", "max", "count")) -> DataFrame:
    """F16: aggregates of a child table as parent features (groupBy + left join)."""
    ck = child_key or key
    cols = cols or [c for c, t in child.dtypes if t in ("double", "int", "bigint", "float") and c != ck]
    fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_samp}
    ex = []
    for c in cols:
        for a in aggs:
            ex.append(fns[a](c).alias(f"{a}_{c}"))
    g = child.groupBy(F.col(ck).alias(key)).agg(F.count(F.lit(1)).alias("n_children"), *ex)
    return parent.join(g, key, "left").fillna(0, ["n_children"])
