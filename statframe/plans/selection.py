"""Exact order statistics of many columns at once, by radix refinement.

A double's bits, with the sign handled, compare as an unsigned 64-bit integer. Each of four levels
counts the rows of every column by the next 16 bits, only among rows whose higher bits are those of a
wanted rank, and descends into the bins that hold the ranks. All columns and ranks share the level's
one pass; a task sends its non-empty bins, the bins are summed and searched on the executors, and the
driver receives one row per wanted rank. No rows are sorted and nothing is approximated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS, BITS = 4, 16
_TOP = np.uint64(1 << 63)


def order_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that compare as the doubles do (-0.0 as 0.0)."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b & _TOP, ~b, b | _TOP)


def from_order_bits(u: int) -> float:
    u = np.uint64(u)
    b = u ^ _TOP if u & _TOP else ~u
    return float(np.array([b], np.uint64).view(np.float64)[0])


def _count(batches, prefixes: list[np.ndarray], level: int):
    """Non-empty (column, prefix number, bin) counts of a partition; the prefixes ascend."""
    shift = np.uint64(64 - BITS * (level + 1))
    held: list[np.ndarray] = []
    total = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def folded():
        key = np.concatenate([total[0], *[h[0] for h in held]])
        n = np.concatenate([total[1], *[h[1] for h in held]])
        uniq, at = np.unique(key, return_inverse=True)
        return uniq, np.bincount(at, weights=n, minlength=len(uniq)).astype(np.int64)

    size = 0
    for batch in batches:
        for c, wanted in enumerate(prefixes):
            x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
            u = order_bits(x[~np.isnan(x)])
            if level:
                high = u >> (shift + np.uint64(BITS))
                at = np.searchsorted(wanted, high)
                hit = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == high)
                u, at = u[hit], at[hit]
            else:
                at = np.zeros(len(u), np.int64)
            digit = ((u >> shift) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            key, n = np.unique((np.int64(c) << 40) | (at.astype(np.int64) << BITS) | digit, return_counts=True)
            held.append((key, n))
            size += len(key)
        if size > 1 << 20:
            total, held, size = folded(), [], 0
    key, n = folded()
    yield pa.RecordBatch.from_arrays([pa.array(key >> 40, pa.int64()), pa.array((key >> BITS) & ((1 << 24) - 1)), pa.array(key & ((1 << BITS) - 1)), pa.array(n)],
                                     names=["col", "prefix", "bin", "n"])


def _level(df: DataFrame, cols: list[str], prefixes: list[np.ndarray], level: int) -> DataFrame:
    """(col, prefix, bin, n, upto): counts with their running total inside each prefix."""
    bins = (df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
            .mapInArrow(lambda it: _count(it, prefixes, level), "col long, prefix long, bin long, n long")
            .groupBy("col", "prefix", "bin").agg(F.sum("n").alias("n")))
    run = Window.partitionBy("col", "prefix").orderBy("bin")  # at most 65,536 bins
    return bins.withColumn("upto", F.sum("n").over(run))


def order_statistics(df: DataFrame, cols: list[str], ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values of rank r (0 is the smallest) of each column, among its rows that are neither
    null nor NaN. Ranks beyond a column's rows are left out."""
    spark = df.sparkSession
    # (column, wanted rank) -> (prefix, rank among the rows of that prefix)
    state = {(i, r): (0, r) for i, c in enumerate(cols) for r in ranks.get(c, [])}
    for level in range(LEVELS):
        prefixes = [np.array(sorted({p for (i, _), (p, _) in state.items() if i == c}), np.uint64) for c in range(len(cols))]
        place = [{int(p): k for k, p in enumerate(x)} for x in prefixes]
        keys = list(state)
        if not keys:
            break
        want = spark.createDataFrame([(k, i, place[i][state[(i, r)][0]] if level else 0, state[(i, r)][1]) for k, (i, r) in enumerate(keys)],
                                     "k long, col long, prefix long, r long")
        found = (_level(df, cols, prefixes, level).join(F.broadcast(want), ["col", "prefix"])
                 .where((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("n") <= F.col("r")))
                 .select("k", "bin", (F.col("r") - F.col("upto") + F.col("n")).alias("r")).collect())
        state = {keys[x["k"]]: ((state[keys[x["k"]]][0] << BITS) | x["bin"], x["r"]) for x in found}
    out: dict[str, dict[int, float]] = {c: {} for c in cols}
    for (i, r), (u, _) in state.items():
        out[cols[i]][r] = from_order_bits(u)
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Quantiles of each column with linear interpolation between order statistics (the median of an
    even number of rows is the mean of the two in the middle); NaN for a column without values."""
    cols = list(dict.fromkeys(cols))
    x = [F.col(c).cast("double") for c in cols]
    n = df.agg(*[F.count(F.when(~F.isnan(v), v)).alias(f"n{i}") for i, v in enumerate(x)]).first()
    at = {c: [(n[f"n{i}"] - 1) * p for p in probs] for i, c in enumerate(cols) if n[f"n{i}"]}
    got = order_statistics(df, cols, {c: sorted({r for h in hs for r in (math.floor(h), math.ceil(h))}) for c, hs in at.items()})

    def value(c: str, h: float) -> float:
        lo, hi = got[c][math.floor(h)], got[c][math.ceil(h)]
        return lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))

    return {c: [value(c, h) for h in at[c]] if c in at else [math.nan] * len(probs) for c in cols}
