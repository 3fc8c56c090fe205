"""A training-data pipeline over ``documents``: five stages, each one operator of ``statframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in
the shared folder and read again as the next one's ``docs``. All but the last return the
columns of ``docs``; extra columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.llm import op2_cgk_decontamination as op2
from statframe.llm import op4_line_windows as op4
from statframe.llm import op5_simhash as op5
from statframe.llm import op8_knn_quality as op8
from statframe.llm import op10_sum_of_squares as op10
from statframe.llm.common import table
from statframe.session import ensure_checkpoint_dir, shared_folder, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut stay."""
    _ready(spark)
    return op8.keep_good(docs, op8.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows leave the texts; ``n_chars`` follows."""
    _ready(spark)
    out = op4.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    _ready(spark)
    return op5.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    _ready(spark)
    return op2.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_words=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed into training sequences."""
    _ready(spark)
    return op10.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Fitted models, fingerprints and tokenizers have no SQL form; see tests/llm/test_corpus_operators.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{shared_folder(spark, 'pipeline')}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
