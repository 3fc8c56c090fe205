"""Autocovariances over a global order at any number of lags, without a column per lag.

Rows carry their position in the order (``_idx`` of :class:`..plans.order.GlobalOrder`). Positions are cut
into blocks of ``block`` rows; a block's products with itself and with what follows within ``lags``
rows come from FFTs of bounded length. A block gets the first rows of its neighbour as overlap;
where the lags reach further than one block, pairs of blocks meet as further groups, so a group
never exceeds two blocks. Sums of products over blocks are exact for every lag, and a task adds
up its blocks before it sends anything: all lags (``lag_products``) or their weighted total
(``weighted_products``), which is a matrix of columns x columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
MAX_BLOCK = 1 << 20


def block_size(lags: int) -> int:
    """Rows per block: the lags if they fit, so that one overlap is enough."""
    return min(max(BLOCK, lags), MAX_BLOCK)


def _dealt(df: DataFrame, cols: list[str], lags: int, block: int) -> DataFrame:
    """(group, reach, place, columns): rows of the groups (block b, reach d), with their place in
    block b or, for partners, ``block`` + their place in block b + d."""
    pos = F.col("_idx") - F.lit(1)
    base = df.select((F.floor(pos / F.lit(block))).cast("long").alias("_g"), F.pmod(pos, F.lit(block)).cast("int").alias("_o"),
                     *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(cols)])
    reach = -(-lags // block)  # blocks that the lags reach into
    x = [f"_x{j}" for j in range(len(cols))]
    steps = F.sequence(F.lit(1), F.lit(max(1, reach)))
    own = base.withColumn("_d", F.explode(steps)).select("_g", "_d", F.col("_o").alias("_p"), *x)
    if not lags:
        return own
    # a partner at place o of block b + d is needed while its least lag, to the block's last row, is in reach
    other = (base.withColumn("_d", F.explode(steps))
             .where((F.col("_g") >= F.col("_d")) & (F.col("_o") + (F.col("_d") - 1) * F.lit(block) < F.lit(lags)))
             .select((F.col("_g") - F.col("_d")).alias("_g"), "_d", (F.col("_o") + F.lit(block)).alias("_p"), *x))
    return own.unionByName(other)


def _products(x: np.ndarray, place: np.ndarray, reach: int, lags: int, block: int, out: np.ndarray) -> None:
    """Adds sum_t x_i(t) x_j(t + k) of one group to ``out[k, i, j]``."""
    own = place < block
    n, k = block, x.shape[1]
    head = np.zeros((n, k))
    head[place[own]] = x[own]
    if reach == 1:
        # the block and its overlap in one run
        run = np.zeros((n + min(lags, block), k))
        run[place] = x
        first, low, high = 0, 0, min(lags, 2 * block - 1)
    else:
        # partners ``reach`` blocks further on alone
        run = np.zeros((n, k))
        run[place[~own] - block] = x[~own]
        first, low, high = reach * block, (reach - 1) * block + 1, min(lags, (reach + 1) * block - 1)
    size = 1 << int(np.ceil(np.log2(len(head) + len(run))))
    a, b = np.fft.rfft(head, size, axis=0), np.fft.rfft(run, size, axis=0)
    for i in range(k):
        for j in range(k):
            c = np.fft.irfft(np.conj(a[:, i]) * b[:, j], size)
            lag = np.arange(low, high + 1)
            out[lag, i, j] += c[(lag - first) % size]


def _sums(df: DataFrame, cols: list[str], lags: int, block: int | None, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``finish`` of the (lags + 1, k, k) products of each task, added up."""
    block = block or block_size(lags)
    k = len(cols)

    def add(batches):
        out = np.zeros((lags + 1, k, k))
        hold: list[pd.DataFrame] = []

        def flush():
            if hold:
                g = pd.concat(hold) if len(hold) > 1 else hold[0]
                _products(g.iloc[:, 3:].to_numpy(dtype=float), g["_p"].to_numpy().astype(np.int64), int(g["_d"].iloc[0]), lags, block, out)
                hold.clear()

        last = None
        for batch in batches:  # sorted by group: a group may go on in the next batch
            if not len(batch):
                continue
            key = batch["_g"].to_numpy() * np.int64(1 << 20) + batch["_d"].to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            for lo, hi in zip([0, *cut], [*cut, len(batch)]):
                if last is not None and key[lo] != last:
                    flush()
                hold.append(batch.iloc[lo:hi])
                last = key[lo]
        flush()
        v = finish(out).ravel()
        yield pd.DataFrame({"pos": np.arange(len(v), dtype=np.int64), "v": v})

    dealt = _dealt(df, cols, lags, block).repartition("_g", "_d").sortWithinPartitions("_g", "_d")
    rows = dealt.mapInPandas(add, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(finish(np.zeros((lags + 1, k, k))).ravel()))
    for r in rows:
        out[r["pos"]] = r["v"]
    return out


def lag_products(df: DataFrame, cols: list[str], lags: int, block: int | None = None) -> np.ndarray:
    """(lags + 1, k, k): sum over t of x_i(t) x_j(t + lag), for ``df`` with ``_idx`` 1..n."""
    return _sums(df, cols, lags, block, lambda p: p).reshape(lags + 1, len(cols), len(cols))


def weighted_products(df: DataFrame, cols: list[str], weights: np.ndarray, block: int | None = None) -> np.ndarray:
    """(k, k): G(0) w(0) + sum of w(lag) (G(lag) + G(lag)'); the lags are weighted inside the tasks."""
    w = np.asarray(weights, dtype=float)

    def finish(p):
        later = np.tensordot(w[1:], p[1:], axes=1)
        return w[0] * p[0] + later + later.T

    k = len(cols)
    return _sums(df, cols, len(w) - 1, block, finish).reshape(k, k)


def bartlett(lags: int) -> np.ndarray:
    return 1 - np.arange(lags + 1) / (lags + 1)
