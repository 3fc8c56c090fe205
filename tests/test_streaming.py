"""Streaming results equal the batch result over closed windows."""
import pytest
from pyspark.sql import functions as F

from statframe.sources.scan import load
from statframe.streaming import stream
from tests.conftest import SF_SMALL


def test_window_stats_equal_batch(spark):
    ev = load(spark, SF_SMALL, "events")
    s = stream.file_stream(spark, SF_SMALL, "events.parquet", ev.schema, ts="ts")
    out = stream.run_to_table(stream.window_stats(s, "ts", "value", "1 day", watermark="1 hour"),
                              stream.scratch(spark, "t-window"))
    got = {r["window_start"]: (r["n"], round(r["sum"], 6)) for r in spark.read.parquet(out).collect()}
    b = ev.withColumn("t", F.col("ts").cast("timestamp"))
    mx = b.agg(F.max("t")).collect()[0][0]
    batch = (b.groupBy(F.window("t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
             .where(F.col("w.end") <= F.lit(mx) - F.expr("INTERVAL 1 HOUR")).collect())
    want = {r["w"]["start"]: (r["n"], round(r["s"], 6)) for r in batch}
    assert got == want and len(got) > 0


def test_late_rows_dropped_after_watermark(spark, tmp_path):
    """Three files in arrival order: early days, later days (the watermark passes the early
    windows, which are emitted and evicted), then rows for the first day. Those rows are
    behind the watermark and must not reopen or change the closed window; days without
    rows produce no window."""
    import time
    ev = load(spark, SF_SMALL, "events")
    src = tmp_path / "src"
    day2 = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    early = ev.where(F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    early.coalesce(1).write.parquet(str(src / "part1"))
    time.sleep(1.2)
    ev.where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).coalesce(1).write.parquet(str(src / "part2"))
    time.sleep(1.2)
    ev.where(F.col("ts") < day2).coalesce(1).write.parquet(str(src / "part3"))
    s = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
         .parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp")))
    out = stream.run_to_table(stream.window_stats(s, "ts", "value", "1 day", watermark="1 hour"),
                              stream.scratch(spark, "t-late"))
    rows = spark.read.parquet(out).collect()
    day1 = [r["n"] for r in rows if r["window_start"].strftime("%Y-%m-%d") == "2024-01-01"]
    assert day1 == [early.where(F.col("ts") < day2).count()]  # emitted once, late copies dropped
    assert not any(r["window_start"].strftime("%Y-%m-%d") == "2024-01-15" for r in rows)


def test_cusum_batches_merge_state_across_files(spark, tmp_path):
    """Three files -> three micro-batches; the merged per-key state equals a brute-force
    running sum over the whole ordered table."""
    import time
    import numpy as np
    ev = load(spark, SF_SMALL, "events")
    src = tmp_path / "src"
    bounds = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    for i in range(3):
        lo, hi = (F.lit(f"{bounds[i]} 00:00:00").cast("timestamp_ntz"), F.lit(f"{bounds[i + 1]} 00:00:00").cast("timestamp_ntz"))
        ev.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.parquet(str(src / f"part{i}"))
        time.sleep(1.1)
    s = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
         .parquet(str(src)))
    path = stream.cusum_stream_batches(s, "event_type", "value", ["ts", "event_id"], 50.0, 1e9,
                                       stream.scratch(spark, "t-cusum"))
    got = {r["event_type"]: (r["n"], r["smax"], r["smin"]) for r in spark.read.parquet(path).collect()}
    pdf = ev.toPandas().sort_values(["ts", "event_id"])
    for k, g in pdf.groupby("event_type"):
        c = np.cumsum(g["value"].to_numpy() - 50.0)
        n, smax, smin = got[k]
        assert n == len(g)
        assert smax == pytest.approx(max(c.max(), 0.0), rel=1e-9)
        assert smin == pytest.approx(min(c.min(), 0.0), rel=1e-9)
