"""Sources: resolve a reference (path, table name or SQL) to a DataFrame.

S1 CSV, S2 auto by suffix, S3 table, S4 SQL, S5 Parquet/JSON, S6 guards.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import folder_names

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SEP = {".csv": ",", ".tsv": "\t", ".txt": ","}


def scan(spark: SparkSession, ref: str, source_type: str = "auto", schema: T.StructType | None = None,
         sql_query: str | None = None) -> DataFrame:
    """Resolve ``ref``: csv/tsv/txt by suffix, parquet/json by suffix, else a table name."""
    if sql_query:
        return spark.sql(sql_query)
    st = source_type.lower()
    ext = os.path.splitext(ref)[1].lower()
    if st == "csv" or (st == "auto" and ext in _SEP):
        r = spark.read.option("header", True).option("sep", _SEP.get(ext, ","))
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(ref)
    if st == "parquet" or (st == "auto" and ext == ".parquet"):
        return spark.read.parquet(ref)
    if st == "json" or (st == "auto" and ext in (".json", ".jsonl")):
        r = spark.read.schema(schema) if schema is not None else spark.read
        return r.json(ref)
    if st == "auto" and "/" in ref and folder_names(spark, ref) is not None:
        return spark.read.parquet(ref)
    return spark.table(ref)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views named like the driver's tables, for the SQL source."""
    for n in names:
        p = f"{sf_dir}/{n}.parquet"
        if folder_names(spark, p) is not None:
            spark.read.parquet(p).createOrReplaceTempView(n)


def require(df: DataFrame, cols, ctx: str = "data") -> None:
    """F2/S6 schema guard: missing columns raise before any job runs."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Columns not found in {ctx}: {missing}")


def require_numeric(df: DataFrame, cols, ctx: str = "data") -> None:
    require(df, cols, ctx)
    bad = [c for c in cols if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    if bad:
        raise TypeError(f"Non-numeric column(s) in {ctx}: {bad}")


def check_nonempty(n: int, ctx: str) -> None:
    if n == 0:
        raise ValueError(f"{ctx} is empty")
