"""GRAM: one aggregate of weighted sums and cross-products.

Every linear estimator, auxiliary regression and moment-based test reads a
:class:`Moments` object: n, sum w, sum w*z, sum w*z*z' over a list of column
expressions. The aggregate is partial (map-side combine) so the shuffle is one
row per task; with ``by`` it yields one mergeable row per segment. Rows add
up, so roll-ups, folds and stream windows are sums of rows.

Above ``BLOCK_THRESHOLD`` variables the sum expressions would leave
whole-stage codegen; the block path computes X'X per Arrow batch with numpy
inside ``mapInPandas`` and sums the partials with a small grouped aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_THRESHOLD = 40


@dataclass
class Moments:
    names: list[str]
    n: int
    sw: float
    s: np.ndarray
    m: np.ndarray
    slogw: float = 0.0
    extra: dict = field(default_factory=dict)

    def idx(self, names) -> list[int]:
        return [self.names.index(c) for c in names]

    def mean(self, names=None) -> np.ndarray:
        i = self.idx(names) if names is not None else list(range(len(self.names)))
        return self.s[i] / self.sw

    def centered(self, rows, cols=None) -> np.ndarray:
        """sum w (z_r - zbar_r)(z_c - zbar_c) for the given variable names."""
        cols = rows if cols is None else cols
        ri, ci = self.idx(rows), self.idx(cols)
        return self.m[np.ix_(ri, ci)] - np.outer(self.s[ri], self.s[ci]) / self.sw

    def raw(self, rows, cols=None, const=True) -> np.ndarray:
        """Uncentred cross-product matrix of [1, rows] x [1, cols]."""
        cols = rows if cols is None else cols
        ri, ci = self.idx(rows), self.idx(cols)
        inner = self.m[np.ix_(ri, ci)]
        if not const:
            return inner
        top = np.concatenate([[self.sw], self.s[ci]])
        body = np.column_stack([self.s[ri], inner])
        return np.vstack([top, body])

    def __add__(self, o: "Moments") -> "Moments":
        assert self.names == o.names
        return Moments(self.names, self.n + o.n, self.sw + o.sw, self.s + o.s,
                       self.m + o.m, self.slogw + o.slogw)

    def __sub__(self, o: "Moments") -> "Moments":
        assert self.names == o.names
        return Moments(self.names, self.n - o.n, self.sw - o.sw, self.s - o.s,
                       self.m - o.m, self.slogw - o.slogw)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gram_aggs(exprs: list[Column], weight: Column | None = None, logw: bool = True) -> list[Column]:
    """Aggregate expressions: n, sw, slogw, s_i, m_i_j (i <= j)."""
    z = [e.cast("double") for e in exprs]
    out = [F.count(F.lit(1)).alias("_n")]
    if weight is None:
        out += [F.count(F.lit(1)).cast("double").alias("_sw"), F.lit(0.0).alias("_slogw")]
        out += [F.sum(zi).alias(f"_s{i}") for i, zi in enumerate(z)]
        out += [F.sum(z[i] * z[j]).alias(f"_m{i}_{j}")
                for i in range(len(z)) for j in range(i, len(z))]
    else:
        w = weight.cast("double")
        out += [F.sum(w).alias("_sw"),
                (F.sum(F.log(w)) if logw else F.lit(0.0)).alias("_slogw")]
        out += [F.sum(w * zi).alias(f"_s{i}") for i, zi in enumerate(z)]
        out += [F.sum(w * z[i] * z[j]).alias(f"_m{i}_{j}")
                for i in range(len(z)) for j in range(i, len(z))]
    return out


def moments_from_row(row, names: list[str]) -> Moments:
    p = len(names)
    d = row.asDict() if hasattr(row, "asDict") else dict(row)
    s = np.array([d[f"_s{i}"] or 0.0 for i in range(p)], dtype=float)
    m = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = d[f"_m{i}_{j}"] or 0.0
    return Moments(list(names), int(d["_n"] or 0), float(d["_sw"] or 0.0), s, m,
                   float(d.get("_slogw") or 0.0))


def gram(df: DataFrame, cols, weight=None, names: list[str] | None = None, logw: bool = True) -> Moments:
    """One pass; returns the moments of the given columns (names or Columns)."""
    exprs = [_c(c) for c in cols]
    names = names or [c if isinstance(c, str) else f"z{i}" for i, c in enumerate(cols)]
    w = _c(weight) if weight is not None else None
    if len(exprs) > BLOCK_THRESHOLD:
        return block_gram(df, exprs, w, names)
    row = df.agg(*gram_aggs(exprs, w, logw)).collect()[0]
    return moments_from_row(row, names)


def grouped_gram(df: DataFrame, keys: list[str], cols, weight=None) -> DataFrame:
    """One Gram row per segment (partial aggregation before the shuffle)."""
    exprs = [_c(c) for c in cols]
    w = _c(weight) if weight is not None else None
    return df.groupBy(*keys).agg(*gram_aggs(exprs, w))


def group_shrunk_moments(groups: DataFrame, names: list[str], theta: Column, const: bool = False) -> tuple[Moments, int]:
    """Moments of z - theta_g * mean_g(z) over all rows, from the Gram rows of the groups, and
    the number of groups. ``theta`` is an expression over the group's row (``_n`` its size);
    theta = 1 is the within transformation. With ``const`` the column 1 - theta_g (the
    transformed constant, name ``_c``) comes first. Neither the rows nor the group means are
    joined: sum (z_i - theta m_i)(z_j - theta m_j) = m_ij - (2 theta - theta^2) s_i s_j / n."""
    keep = (F.lit(1.0) - theta) * (F.lit(1.0) - theta)
    p = len(names)
    aggs = [F.sum("_n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(keep * F.col("_n")).alias("cc")]
    for i in range(p):
        aggs.append(F.sum(keep * F.col(f"_s{i}")).alias(f"c{i}"))
        aggs += [F.sum(F.col(f"_m{i}_{j}") - (F.lit(1.0) - keep) * F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("_n")).alias(f"m{i}_{j}")
                 for j in range(i, p)]
    r = groups.agg(*aggs).first()
    m = np.zeros((p + 1, p + 1))
    m[0, 0] = r["cc"] or 0.0
    for i in range(p):
        m[0, i + 1] = m[i + 1, 0] = r[f"c{i}"] or 0.0
        for j in range(i, p):
            m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"m{i}_{j}"] or 0.0
    full = Moments(["_c"] + list(names), int(r["n"] or 0), float(r["n"] or 0), m[0], m)
    if const:
        return full, int(r["g"])
    return Moments(list(names), full.n, full.sw, m[0, 1:], m[1:, 1:]), int(r["g"])


def poisson_grams(df: DataFrame, names: list[str], key_cols: list[str], replicates: int, seed: int, out_of_bag: bool = False) -> DataFrame:
    """Gram rows (``_r``, ``_oob`` and the columns of :func:`gram_aggs`) of Poisson(1) bootstrap
    replicates. Rows are not multiplied: each Arrow batch draws its rows' weights for all
    replicates from a hash of the key and one matrix product adds up every replicate's
    cross-products; a task sends one row per replicate. With ``out_of_bag`` the rows of
    weight zero are added up too (``_oob`` = 1)."""
    p = len(names)
    tri = np.triu_indices(p)
    fields = ["_n", "_sw", "_slogw"] + [f"_s{i}" for i in range(p)] + [f"_m{i}_{j}" for i, j in zip(*tri)]
    d = df.select(F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols]).alias("_h"), *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(names)])
    cdf = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 12.0)]))  # of Poisson(1)

    def add(batches):
        import pandas as pd
        acc = np.zeros((2, replicates, len(fields)))
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.iloc[lo:lo + 4096]
                z = part[[f"z{i}" for i in range(p)]].to_numpy(dtype=float)
                h = part["_h"].to_numpy().astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed values: SplitMix64
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
                w = np.searchsorted(cdf, u, side="left").astype(float)
                v = np.column_stack([np.ones(len(z)), np.zeros(len(z)), z, z[:, tri[0]] * z[:, tri[1]]])
                acc[0, :, 0] += (w > 0).sum(axis=0)
                acc[0, :, 1:] += w.T @ v
                if out_of_bag:
                    o = (w == 0).astype(float)
                    acc[1, :, 0] += o.sum(axis=0)
                    acc[1, :, 1:] += o.T @ v
        for oob in range(1 + out_of_bag):
            yield pd.DataFrame(acc[oob], columns=fields).assign(_r=np.arange(1, replicates + 1), _oob=oob)[["_r", "_oob"] + fields]

    rows = d.mapInPandas(add, "_r long, _oob long, " + ", ".join(f"{f} double" for f in fields))
    return rows.groupBy("_r", "_oob").agg(*[F.sum(f).alias(f) for f in fields])


def block_gram(df: DataFrame, exprs: list[Column], weight, names: list[str]) -> Moments:
    """Wide designs: per-batch numpy X'X, then a grouped sum of the partials."""
    p = len(exprs)
    sel = [e.cast("double").alias(f"z{i}") for i, e in enumerate(exprs)]
    sel.append((weight.cast("double") if weight is not None else F.lit(1.0)).alias("w"))
    proj = df.select(*sel)
    tri = np.triu_indices(p)
    width = 3 + p + len(tri[0])

    def part(it):
        import pandas as pd
        acc = np.zeros(width)
        for b in it:
            x = b[[f"z{i}" for i in range(p)]].to_numpy(dtype=float)
            w = b["w"].to_numpy(dtype=float)
            acc[0] += len(b)
            acc[1] += w.sum()
            acc[2] += np.log(w).sum() if weight is not None else 0.0
            acc[3:3 + p] += w @ x
            acc[3 + p:] += (x.T @ (x * w[:, None]))[tri]
        yield pd.DataFrame({"pos": np.arange(width, dtype=np.int32), "v": acc})

    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("v", T.DoubleType())])
    parts = proj.mapInPandas(part, schema).groupBy("pos").agg(F.sum("v").alias("v"))
    vals = np.zeros(width)
    for r in parts.collect():
        vals[r["pos"]] = r["v"]
    m = np.zeros((p, p))
    m[tri] = vals[3 + p:]
    m = m + m.T - np.diag(np.diag(m))
    return Moments(list(names), int(vals[0]), float(vals[1]), vals[3:3 + p].copy(), m, float(vals[2]))
