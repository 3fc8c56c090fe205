"""The three significant-digit rounding twins must agree bit for bit."""
import duckdb
from pyspark.sql import functions as F

from statframe.functions.columns import sig, sig_col, sig_sql

VALUES = [123.4565, -0.000123456789, 98765432.1, 2.5, -2.5, 1e-13, 0.1 + 0.2, 7.161722083951675,
          52872.34733902594, 1.1804709798938618e-05, 1e22, -3.0000005]


def test_sig_twins(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    got_spark = [r[0] for r in df.select(sig_col("x")).collect()]
    con = duckdb.connect()
    got_duck = [con.execute(f"SELECT {sig_sql(repr(v))}").fetchone()[0] for v in VALUES]
    got_py = [sig(v) for v in VALUES]
    assert got_py == got_spark == got_duck
    assert sig(1e-13) == 0.0 and sig(None) is None
