"""Model registry (S8, S9, S12, S13), prediction sink (S10) and artifact sinks.

The registry is an append-only Parquet table of small model rows
(coefficients, covariance, metrics, lineage), never data-sized. The table
lives under the shared folder the session names (``spark.checkpoint.dir``)
unless a path is given.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

MODEL_ID_RE = r"^[a-z0-9]+(?:-[a-z0-9]+)*_[a-z0-9]+_[0-9]{8}_[0-9a-f]{6}$"

REGISTRY_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("algorithm", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("coefficients", T.ArrayType(T.StructType([T.StructField("term", T.StringType()),
                                                            T.StructField("value", T.DoubleType())]))),
    T.StructField("covariance", T.ArrayType(T.DoubleType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("dataset_hash", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("n_cols", T.IntegerType()), T.StructField("date_min", T.StringType()),
    T.StructField("date_max", T.StringType()), T.StructField("trained_at", T.TimestampType()),
    T.StructField("parent_model_id", T.StringType()), T.StructField("schema_version", T.StringType()),
    T.StructField("retrained_from", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "dtype", "role", "transform")])))])

#: Columns of the prediction sink, in order.
PREDICTION_COLUMNS = ["row_id", "prediction", "se", "ci_lower", "ci_upper", "model_id", "predicted_at"]


def registry_path(spark: SparkSession, path: str | None = None) -> str:
    if path:
        return path
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/model_registry"


def dataset_fingerprint(df: DataFrame, cols: list[str] | None = None, date_col: str | None = None) -> dict:
    """Order-independent content hash: exact decimal sum of xxhash64 per row + count,
    plus the date range, all in one aggregate."""
    cols = cols or df.columns
    h = F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")]
    if date_col:
        aggs += [F.min(date_col).cast("string").alias("lo"), F.max(date_col).cast("string").alias("hi")]
    r = df.agg(*aggs).collect()[0]
    digest = hashlib.sha256(f"{r['h']}|{r['n']}|{','.join(cols)}".encode()).hexdigest()
    return {"hash": digest, "n_rows": int(r["n"]), "n_cols": len(cols),
            "date_min": r["lo"] if date_col else None, "date_max": r["hi"] if date_col else None}


def make_model_id(slug: str, algorithm: str, data_hash: str, when: _dt.date | None = None) -> str:
    """<slug>_<alg>_<YYYYMMDD>_<hash6>."""
    when = when or _dt.date.today()
    s = re.sub(r"[^a-z0-9]+", "-", slug.lower()).strip("-")
    a = re.sub(r"[^a-z0-9]+", "", algorithm.lower())
    mid = f"{s}_{a}_{when:%Y%m%d}_{data_hash[:6]}"
    if not re.match(MODEL_ID_RE, mid):
        raise ValueError(f"bad model id {mid!r}")
    return mid


def save_model(spark: SparkSession, fit, model_id: str, fingerprint: dict, metrics: dict | None = None,
               hyperparameters: dict | None = None, parent: str | None = None, path: str | None = None, retrained_from: str | None = None,
               data: DataFrame | None = None, transforms: dict | None = None, ids: list[str] | None = None) -> str:
    """Append one row to the registry table. S12: ``retrained_from`` names the model this one replaces;
    with ``data``, the row lists every column's name, type, role (feature, target or id) and
    transformation (``transforms``, none where it is not named)."""
    terms = list(getattr(fit, "terms", []))
    beta = [float(b) for b in getattr(fit, "beta", getattr(fit, "theta", []))]
    cov = [float(v) for v in fit.cov.ravel()] if hasattr(fit, "cov") else []
    row = (model_id, getattr(fit, "algorithm", getattr(fit, "family", "")), getattr(fit, "target", ""),
           list(getattr(fit, "features", [])), [(t, b) for t, b in zip(terms, beta)], cov,
           {k: float(v) for k, v in (metrics or {}).items()},
           {k: json.dumps(v) for k, v in (hyperparameters or {}).items()},
           fingerprint["hash"], fingerprint["n_rows"], fingerprint["n_cols"], fingerprint.get("date_min"),
           fingerprint.get("date_max"), _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), parent, "1.0.0", retrained_from,
           _column_rows(fit, data, transforms or {}, ids or []))
    if getattr(fit, "family", None):  # what scoring needs beside the coefficients
        row[7].update({"_family": json.dumps(fit.family), "_link": json.dumps(fit.link), "_classes": json.dumps([str(c) for c in fit.classes]),
                       "_n_classes": json.dumps(fit.n_classes), "_offset": json.dumps(fit.extra.get("offset"))})
    p = registry_path(spark, path)
    spark.createDataFrame([row], REGISTRY_SCHEMA).write.mode("append").parquet(p)
    return model_id


def _column_rows(fit, data: DataFrame | None, transforms: dict, ids: list[str]) -> list[tuple] | None:
    if data is None:
        return None
    kinds = {f.name: f.dataType.simpleString() for f in data.schema}
    roles = [(c, "feature") for c in getattr(fit, "features", [])] + [(fit.target, "target")] + [(c, "id") for c in ids]
    return [(c, kinds.get(c), role, transforms.get(c, "none")) for c, role in roles]


def load_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path(spark, path))


def load_model(spark: SparkSession, model_id: str, path: str | None = None):
    """The model row; a missing id is an error."""
    rows = load_registry(spark, path).where(F.col("model_id") == model_id).orderBy(F.col("trained_at").desc()).limit(1).collect()
    if not rows:
        raise KeyError(f"model {model_id!r} not found in registry")
    return rows[0]


def score_expression(model_row):
    """SCORE column of any registered model: the linear prediction, the mean response
    through the model's own link, or the array of class probabilities (ordered, multinomial)."""
    h = {k: json.loads(v) for k, v in (model_row["hyperparameters"] or {}).items() if k.startswith("_")}
    if h.get("_family"):
        from ..operators.discrete import DiscreteFit, class_probabilities, probability
        terms = [c["term"] for c in model_row["coefficients"]]
        theta = np.array([c["value"] for c in model_row["coefficients"]])
        fit = DiscreteFit(h["_family"], terms, theta, np.zeros((len(theta), len(theta))), 0.0, 0.0, 0, h["_n_classes"], True, 0,
                          list(model_row["features"]), model_row["target"], h["_classes"], link=h["_link"], extra={"offset": h["_offset"]} if h.get("_offset") else {})
        many = fit.family.startswith("ordered") or fit.family == "mnlogit"
        return class_probabilities(fit) if many else probability(fit)
    coefs = {c["term"]: c["value"] for c in model_row["coefficients"]}
    out = F.lit(coefs.get("const", 0.0))
    for f in model_row["features"]:
        out = out + F.lit(coefs[f]) * F.col(f).cast("double")
    return out


def prediction_table(pred: DataFrame, model_id: str, row_id: list[str] | str | None = None) -> DataFrame:
    """``pred`` in the sink's schema: ``row_id`` (the key columns as text, joined by ``|``), ``prediction``,
    ``se``, ``ci_lower``, ``ci_upper`` (null where the model gives none), ``model_id``, ``predicted_at`` and
    ``schema_version``; further columns follow."""
    keys = [row_id] if isinstance(row_id, str) else list(row_id or [])
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    out = pred.withColumn("row_id", F.concat_ws("|", *text) if keys else F.lit(None).cast("string"))
    for c in ("prediction", "se", "ci_lower", "ci_upper"):
        out = out.withColumn(c, F.col(c).cast("double") if c in pred.columns else F.lit(None).cast("double"))
    out = out.withColumn("model_id", F.lit(model_id)).withColumn("predicted_at", F.current_timestamp()).withColumn("schema_version", F.lit("1.0.0"))
    first = [*PREDICTION_COLUMNS, "schema_version"]
    return out.select(*first, *[c for c in out.columns if c not in first and c not in keys])


def write_predictions(pred: DataFrame, path: str, model_id: str, row_id: list[str] | str | None = None) -> None:
    """Append to the prediction sink, partitioned by model_id (:func:`prediction_table`)."""
    prediction_table(pred, model_id, row_id).write.mode("append").partitionBy("model_id").parquet(path)


def write_artifact(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Tidy result table to JSON / Parquet."""
    getattr(df.write.mode("overwrite"), fmt)(path)
