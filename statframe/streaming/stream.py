"""Structured Streaming forms of the monitors.

Sources are file streams (schema from the table, ``maxFilesPerTrigger``);
event time is cast from TIMESTAMP_NTZ to TIMESTAMP before the watermark.
Sinks write to the shared checkpoint folder the session names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.gram import gram_aggs, moments_from_row
from ..session import folder_names, shared_folder


def file_stream(spark: SparkSession, directory: str, file_glob: str, schema: T.StructType,
                ts: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stream of the Parquet files in ``directory``; ``max_files`` per micro-batch if given."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        s = s.option("maxFilesPerTrigger", max_files)
    s = s.parquet(directory)
    if ts:
        s = s.withColumn(ts, F.col(ts).cast("timestamp"))
    return s


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return shared_folder(spark, name)


def score_stream(stream: DataFrame, score: Column, keep: list[str]) -> DataFrame:
    """The batch SCORE expression applied to a stream."""
    return stream.select(*keep, score.alias("prediction"))


def window_stats(stream: DataFrame, ts: str, value: str, size: str, slide: str | None = None,
                 watermark: str = "1 hour", by: list[str] | None = None, gap: str | None = None) -> DataFrame:
    """Tumbling / sliding / session window statistics with a watermark;
    late rows beyond the watermark are dropped, windows are emitted once closed."""
    s = stream.withWatermark(ts, watermark)
    if gap:
        w = F.session_window(ts, gap)
    else:
        w = F.window(ts, size, slide) if slide else F.window(ts, size)
    x = F.col(value).cast("double")
    return (s.groupBy(w.alias("w"), *(by or []))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"),
                 F.min(x).alias("min"), F.max(x).alias("max"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []),
                    "n", "sum", "sum_sq", "min", "max"))


def run_to_table(df: DataFrame, out: str, mode: str = "append", foreach_batch=None) -> str:
    """Drive a streaming query to completion (availableNow) into a Parquet folder."""
    ck = out + "-ckpt"
    w = df.writeStream.option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out


def gram_stream(stream: DataFrame, ts: str, y: str, features: list[str], size: str, out: str) -> str:
    """Mergeable Gram rows per micro-batch and event-time window. Gram rows add up, so
    no row waits for a watermark and late rows count too: every batch writes the rows of its
    own data (a retried batch rewrites its version) and a fit over any span is the sum of its
    rows (see :func:`fit_from_gram_rows`)."""
    names = list(features) + [y]

    def per_batch(batch: DataFrame, batch_id: int):
        g = (batch.groupBy(F.window(ts, size).alias("w")).agg(*gram_aggs([F.col(c) for c in names]))
             .select(F.col("w.start").alias("window_start"), "*").drop("w"))
        g.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    return run_to_table(stream, out, foreach_batch=per_batch)


def fit_from_gram_rows(rows: DataFrame, y: str, features: list[str]):
    """Sum Gram rows (one small aggregate) and solve."""
    from ..operators.linear import solve_moments
    names = list(features) + [y]
    cols = [c for c in rows.columns if c.startswith("_")]  # not window_start, not batch
    total = rows.agg(*[F.sum(c).alias(c) for c in cols]).collect()[0]
    mom = moments_from_row(total, names)
    return solve_moments(mom, y, features), mom


def cusum_stream_batches(stream: DataFrame, key: str, value: str, order_by: list[str], target_mean: float,
                         threshold: float, out: str):
    """Per-key running CUSUM of (x - target) over a stream. Each micro-batch computes per-key running sums on the series-led
    global order (a hot key is split across tasks), reduces them to per-key (n, sum, max, min)
    of the batch-local prefix, and merges those with the per-key state table of the previous
    batch: s' = s + s_b, max' = max(max, s + max_b), min' = min(min, s + min_b). The state is
    a small Parquet table per batch id under ``out`` (a retried batch rewrites its own version)."""
    from ..plans.order import series_running_sums

    def per_batch(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        b = batch.withColumn("_x", F.col(value).cast("double") - F.lit(target_mean))
        run = series_running_sums(b, [key], order_by, "_x")
        part = run.groupBy(key).agg(F.count(F.lit(1)).alias("nb"), F.sum("_x").alias("sb"),
                                    F.max("_x_scum").alias("hib"), F.min("_x_scum").alias("lob"))
        prev_path = _latest_state(spark, out, batch_id)
        if prev_path:
            prev = spark.read.parquet(prev_path)
            merged = prev.join(part, key, "full")
        else:
            merged = part.withColumn("n", F.lit(0).cast("long")).withColumn("s", F.lit(0.0)) \
                .withColumn("smax", F.lit(0.0)).withColumn("smin", F.lit(0.0))
        s0 = F.coalesce(F.col("s"), F.lit(0.0))
        new = merged.select(
            F.col(key).cast("string").alias(key),
            (F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("nb"), F.lit(0))).alias("n"),
            (s0 + F.coalesce(F.col("sb"), F.lit(0.0))).alias("s"),
            F.greatest(F.coalesce(F.col("smax"), F.lit(0.0)), s0 + F.coalesce(F.col("hib"), F.lit(0.0))).alias("smax"),
            F.least(F.coalesce(F.col("smin"), F.lit(0.0)), s0 + F.coalesce(F.col("lob"), F.lit(0.0))).alias("smin"))
        new = new.withColumn("alarm", F.greatest(F.abs("smax"), F.abs("smin")) > F.lit(threshold))
        new.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    run_to_table(stream, out + "-sink", foreach_batch=per_batch)
    return _latest_state(stream.sparkSession, out, None)


def _latest_state(spark: SparkSession, out: str, before: int | None):
    """Path of the newest state table below ``out`` (of the batches before ``before``)."""
    ids = sorted(int(d.split("=")[1]) for d in folder_names(spark, out) or [] if d.startswith("batch="))
    if before is not None:
        ids = [i for i in ids if i < before]
    return f"{out}/batch={ids[-1]:012d}" if ids else None
