"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A document becomes a bag of hashed terms: its words, the shapes of its words
("Thing," -> ``Xx,``; runs collapse), pairs of neighbouring shapes and the number of
words equal to the word before. Term weights (1 + log tf) * idf are projected on the
leading right singular vectors of the labelled sample's matrix (randomised SVD). The
labelled vectors (at most ``max_labelled`` x ``dims`` floats) are broadcast; every
document takes exact cosine products against all of them, block by block, and its
``k`` nearest neighbours vote with their similarity as weight.

Only ``max_labelled`` labelled rows (lowest hash of the id) train the model; all
documents are scored on their whole text. Defined results: null or empty text, or a
text without any known term, scores the labelled share of ones; no labelled row at
all: 0.5; several labels of a document are averaged; null labels are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, id_bucket, table, text_slices, words_of

WORD_DIMS, SHAPE_DIMS, PAIR_DIMS = 2048, 1024, 1023
N_TERMS = WORD_DIMS + SHAPE_DIMS + PAIR_DIMS + 1
MAX_LABELLED = 4000
DIMS = 48
NEIGHBOURS = 15
#: Similarities below this carry no vote.
MIN_SIMILARITY = 0.05
CUT = 0.3


def shapes(words: list[str]) -> list[str]:
    """Shape of each word: U upper-case run, X one capital, x lower-case run, 9 digits,
    other characters once per run."""
    s = "\n".join(words)
    s = re.sub("[a-zß-öø-ÿ]+", "\x01", s)
    s = re.sub("[A-ZÀ-ÖØ-Þ]{2,}", "\x02", s)
    s = re.sub("[A-ZÀ-ÖØ-Þ]", "\x03", s)
    s = re.sub(r"\d+", "9", s)
    s = re.sub(r"[^\W\d_]+", "\x01", s)
    s = re.sub("([^\n])\\1+", r"\1", s)
    return s.translate({1: "x", 2: "U", 3: "X"}).split("\n")


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts (row, term, count) of the hashed terms, sorted by row and term."""
    rows, codes, uniq = words_of(texts)
    if not len(codes):
        z = np.zeros(0, np.int64)
        return z, z, z
    word_dim = np.fromiter((zlib.crc32(w.lower().encode()) % WORD_DIMS for w in uniq), np.int64, len(uniq))
    shape = np.array([zlib.crc32(s.encode()) for s in shapes([w.replace("\n", " ") for w in uniq])], np.int64)
    sh = shape[codes]
    same = rows[1:] == rows[:-1]
    pair = ((sh[:-1] * 31 + sh[1:]) % 2147483647) % PAIR_DIMS
    repeat = same & (codes[1:] == codes[:-1])
    keys = np.concatenate([
        rows * N_TERMS + word_dim[codes],
        rows * N_TERMS + WORD_DIMS + sh % SHAPE_DIMS,
        (rows[1:] * N_TERMS + WORD_DIMS + SHAPE_DIMS + pair)[same],
        (rows[1:] * N_TERMS + N_TERMS - 1)[repeat],
    ])
    keys, cnt = np.unique(keys, return_counts=True)
    return keys // N_TERMS, keys % N_TERMS, cnt


@dataclass
class KnnModel:
    """idf per term, term projection, unit vectors of the labelled rows, their labels."""

    idf: np.ndarray
    terms: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int

    def embed(self, n: int, row: np.ndarray, term: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        w = ((1.0 + np.log(cnt)) * self.idf[term]).astype(np.float32)
        out = np.zeros((n, self.terms.shape[1]), np.float32)
        if len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            for lo in range(0, len(starts), 512):
                hi = min(lo + 512, len(starts))
                a, b = starts[lo], starts[hi] if hi < len(starts) else len(row)
                out[row[starts[lo:hi]]] = np.add.reduceat(self.terms[term[a:b]] * w[a:b, None], starts[lo:hi] - a, axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest labelled vectors."""
        m = len(self.labels)
        if not m:
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        for lo in range(0, len(x), 1024):
            sim = x[lo:lo + 1024] @ self.vectors.T
            k = min(self.k, m)
            near = np.argpartition(sim, m - k, axis=1)[:, m - k:]
            w = np.take_along_axis(sim, near, axis=1).astype(np.float64)
            w[w < MIN_SIMILARITY] = 0.0
            total = w.sum(axis=1)
            ones = (w * self.labels[near]).sum(axis=1)
            out[lo:lo + 1024] = np.where(total > 0, ones / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0.0, 1.0)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, part in text_slices(texts):
            out[lo:lo + len(part)] = self.vote(self.embed(len(part), *term_counts(part)))
        return out


def _counts_rows(batches):
    for batch in batches:
        texts, quality = batch.column(0), batch.column(1)
        for lo, part in text_slices(texts):
            row, term, cnt = term_counts(part)
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term, pa.int32())),
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(cnt, pa.int32())),
                quality.slice(lo, len(part))], names=["term", "cnt", "quality"])


def fit(docs: DataFrame, labels: DataFrame, fold_mod: int | None = 5, max_labelled: int = MAX_LABELLED,
        dims: int = DIMS, k: int = NEIGHBOURS) -> KnnModel:
    """Train on at most ``max_labelled`` labelled documents; ids whose crc32 modulo
    ``fold_mod`` is 0 are held out. The driver receives their sparse term counts only."""
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if fold_mod:
        lab = lab.where(id_bucket("doc_id", fold_mod) != 0)
    lab = (lab.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = (docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
            .select("text", "quality").mapInArrow(_counts_rows, "term array<int>, cnt array<int>, quality double")
            .orderBy(F.hash("term", "cnt"), "quality").toArrow())
    n = rows.num_rows
    y = rows["quality"].to_numpy() if n else np.zeros(0)
    prior = float(np.mean(y)) if n else 0.5
    if not n:
        return KnnModel(np.zeros(N_TERMS), np.zeros((N_TERMS, dims), np.float32), np.zeros((0, dims), np.float32), y, prior, k)
    term, cnt = (rows[c].combine_chunks() for c in ("term", "cnt"))
    row = np.repeat(np.arange(n), [len(x) for x in term])
    term, cnt = term.flatten().to_numpy(), cnt.flatten().to_numpy()
    df = np.bincount(term, minlength=N_TERMS)
    idf = np.where(df > 1, np.log((1.0 + n) / (1.0 + df)) + 0.1, 0.0)  # a term of one document says nothing
    a = np.zeros((n, N_TERMS), np.float32)
    a[row, term] = (1.0 + np.log(cnt)) * idf[term]
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    a = np.divide(a, norm, out=a, where=norm > 0)
    rng = np.random.default_rng(7)
    width = min(dims, n, N_TERMS)
    q = np.linalg.qr(a @ rng.standard_normal((N_TERMS, width + 8)).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(a @ (a.T @ q))[0]
    vt = np.linalg.svd(q.T @ a, full_matrices=False)[2][:width]
    m = KnnModel(idf, np.ascontiguousarray(vt.T, np.float32), np.zeros((0, width), np.float32), y, prior, k)
    m.vectors = m.embed(n, row, term, cnt)
    return m


def score_column(spark: SparkSession, model: KnnModel):
    """Arrow function: text column -> score; the model travels as a broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts))

    return score


def classify(docs: DataFrame, model: KnnModel, cut: float = CUT) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (existing columns of those names are replaced)."""
    score = score_column(docs.sparkSession, model)
    return (docs.withColumn("score", score(F.col("text").cast("string")))
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))


def keep_good(docs: DataFrame, model: KnnModel, cut: float = CUT) -> DataFrame:
    """Rows whose score reaches ``cut``, with the columns of ``docs``."""
    s = free_name(docs, "_score")
    score = score_column(docs.sparkSession, model)
    return docs.withColumn(s, score(F.col("text").cast("string"))).where(F.col(s) >= cut).drop(s)


def op8_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select(
        "doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
