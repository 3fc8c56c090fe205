"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def get_spark(master: str | None = None, app: str = "statframe",
              shuffle_partitions: int | None = None,
              driver_memory: str = "8g") -> SparkSession:
    """Session with the settings the library assumes: UTC, AQE, Arrow, no UI."""
    master = master or os.environ.get("STATFRAME_MASTER", "local[*]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", driver_memory))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; it is read from the session.
    Where it is unset, a local master (tests) gets a temporary folder; on any other
    master this is an error, because executors would not see a driver-local folder.
    """
    sc = spark.sparkContext
    conf = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="statframe-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, unique to this call."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_table(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """Rows of the driver as a table, by way of Arrow: of a list, the executors' Python workers would hand over the rows."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pa.table([pa.array([r[j] for r in rows]) for j in range(len(schema))], schema.names), schema)


def folder_names(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder of any store Spark reads, or None if there is no such path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``statframe`` importable on executors (``mapInPandas`` / ``applyInPandas``
    functions and streaming state functions import it): zip the package once and add it
    with ``SparkContext.addPyFile``, which distributes it with the job."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="statframe-pkg-"), "statframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
