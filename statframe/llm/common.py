"""Small helpers shared by the operators: table access, Arrow slicing, local unions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled by one vectorised step inside a task; bounds a worker's memory.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, slice) pairs of at most ``limit`` text bytes (or one row)."""
    n = len(texts)
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def split_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """Flatten a list<string> array: (row of each part, code of each part, distinct parts)."""
    rows = np.repeat(np.arange(len(arr)), pc.list_value_length(arr).to_numpy(zero_copy_only=False).astype(np.int64))
    enc = arr.flatten().dictionary_encode()
    return rows, enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary.to_pylist()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """White-space words ([^\\x20\\x09-\\x0D]+) of each text; null texts have none."""
    arr = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows, codes, uniq = split_parts(arr)
    if "" in uniq:
        keep = codes != uniq.index("")
        rows, codes = rows[keep], codes[keep]
    return rows, codes, uniq


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (a[i], b[i])."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(lab, np.maximum(la, lb), low)
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab = nxt
    return lab
