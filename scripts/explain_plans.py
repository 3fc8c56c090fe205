"""Write PLANS.md: formatted physical plans of the headline operators at an sf directory."""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from statframe.operators.linear import ols  # noqa: E402
from statframe.plans.gram import gram_aggs, grouped_gram  # noqa: E402
from statframe.plans.order import GlobalOrder  # noqa: E402
from statframe.session import get_spark  # noqa: E402
from statframe.sources.scan import load  # noqa: E402


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    li = load(spark, sf, "lineitem")
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `scripts/explain_plans.py {sf}` (local[8], 16 shuffle partitions, AQE on).", ""]
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    g = li.where(F.col("l_shipdate") >= cut).select("l_quantity", "l_discount", "l_extendedprice").dropna()
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    li_order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    go = GlobalOrder(li.select(*li_order, "l_quantity"), li_order)  # 600k rows at sf0.1: multi-bucket plan
    items = [
        ("GRAM with a filter (one partial aggregate; filter and columns pushed to the scan)",
         g.agg(*gram_aggs([F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")]))),
        ("Grouped GRAM (segmented fits: partial aggregation before the shuffle)",
         grouped_gram(li, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])),
        ("SANDWICH pass (HC residual products with literal coefficients)",
         li.agg(F.sum((fit.residual() ** 2) * F.col("l_quantity") * F.col("l_quantity")))),
        (f"GIDX lag over lineitem ({go.n_buckets} buckets): exchange by bucket only, edges broadcast",
         go.with_lags(["l_quantity"], 1).agg(F.sum((F.col("l_quantity") - F.col("l_quantity_lag1")) ** 2))),
        ("GIDX bucket reduce (Durbin-Watson / AUC stitching): one windowed pass, per-bucket rows to the driver",
         go.bucketed.withColumn("_l", F.lag("l_quantity").over(go.window)).groupBy("_b").agg(
             F.sum((F.col("l_quantity") - F.col("_l")) ** 2).alias("num"))),
    ]
    for title, df in items:
        out += [f"## {title}", "", "```", plan(df).strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
