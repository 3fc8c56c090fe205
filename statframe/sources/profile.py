"""S7 schema preview / profile and S14 column constraint checks: one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame, cols: list[str] | None = None, exact_distinct: bool = False) -> DataFrame:
    """Per column: type, n, nulls, distinct, min, max, mean, sd -- ONE aggregate over the table.
    ``approx_count_distinct`` by default (HyperLogLog++, mergeable); exact on request."""
    cols = cols or df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = F.col(c)
        num = isinstance(df.schema[c].dataType, T.NumericType)
        aggs += [F.count(x).alias(f"n{i}"),
                 (F.countDistinct(x) if exact_distinct else F.approx_count_distinct(x)).alias(f"d{i}")]
        if num:
            aggs += [F.min(x).cast("double").alias(f"lo{i}"), F.max(x).cast("double").alias(f"hi{i}"),
                     F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    r = df.agg(*aggs).collect()[0]
    rows = []
    for i, c in enumerate(cols):
        num = isinstance(df.schema[c].dataType, T.NumericType)
        rows.append((c, df.schema[c].dataType.simpleString(), int(r["_rows"]), int(r["_rows"] - r[f"n{i}"]),
                     int(r[f"d{i}"]), r[f"lo{i}"] if num else None, r[f"hi{i}"] if num else None,
                     r[f"m{i}"] if num else None, r[f"s{i}"] if num else None))
    schema = ("column string, dtype string, n bigint, nulls bigint, distinct bigint, min double, max double, "
              "mean double, sd double")
    return df.sparkSession.createDataFrame(rows, schema)


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rules name -> boolean Column that must hold; violations counted in one aggregate
    (a null rule result counts as a violation)."""
    r = df.agg(F.count(F.lit(1)).alias("_n"),
               *[F.sum(F.when(rule, 0).otherwise(1)).alias(f"v{i}") for i, rule in enumerate(rules.values())]
               ).collect()[0]
    rows = [(name, int(r[f"v{i}"] or 0), int(r["_n"])) for i, name in enumerate(rules)]
    return df.sparkSession.createDataFrame(rows, "rule string, violations bigint, n bigint")


def in_range(c: str, lo=None, hi=None) -> Column:
    x = F.col(c)
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x >= F.lit(lo))
    if hi is not None:
        cond = cond & (x <= F.lit(hi))
    return cond


def in_set(c: str, values) -> Column:
    return F.col(c).isin(list(values))


def not_null(c: str) -> Column:
    return F.col(c).isNotNull()
