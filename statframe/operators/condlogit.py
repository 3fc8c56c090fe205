"""Conditional logit with the exact conditional likelihood.

A stratum of n rows with m cases contributes sum over cases of x'b minus log e_m(exp(x'b)), e_m
being the elementary symmetric polynomial of degree m. With rows tilted by a constant c of the
stratum, p = c exp(x'b) / (1 + c exp(x'b)), the coefficients of prod (1 - p + p t) are the
probabilities of a sum of independent draws, and

    log e_m = -m log c + sum log(1 + c exp(x'b)) + log P[m].

c puts the mean of that sum at m, so P[m] is near the mode: nothing overflows or underflows at
any stratum size. Score and Hessian follow from the polynomials of first and second
derivatives, carried along with P. These polynomials multiply, so a stratum merges from
parts: blocks of ``LEAF`` rows by recursion (all blocks of a batch at once), blocks and parts by FFT
products, cut where they fall below 1e-18 of their peak.

Rows are laid out once, hashed by stratum, sorted and persisted. A stratum with more than
1 / ``HEAVY_STRATA`` of all rows (fewer than ``HEAVY_STRATA`` of them, so they are broadcast) is dealt
into parts of about ``PART_ROWS`` rows over all tasks. A Newton step is one pass that returns a
row of sums per task and the parts' polynomials.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 64
HEAVY_STRATA, PART_ROWS, MERGED_PARTS = 1000, 1 << 16, 64
TAIL = 1e-18
#: Cells (rows times polynomial columns) of one vectorised step.
CELLS = 4_000_000


# -------------------------------------------------------------- polynomials
def leaf_polynomials(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(blocks, rows + 1, 1 + k + k k): coefficients of prod (1 - p + p t) and of its first and second
    derivatives by b, for ``p`` (blocks, rows), ``x`` (blocks, rows, k); rows with p = 0 pad."""
    blocks, rows, k = x.shape
    s = np.zeros((blocks, rows + 1, 1 + k + k * k))
    s[:, 0, 0] = 1.0
    for i in range(rows):
        w, v = p[:, i, None, None], x[:, i, None, :]
        old = s[:, :i + 1].copy()
        s[:, :i + 1] *= 1 - w
        new = old
        first = old[:, :, 1:1 + k].copy()
        new[:, :, 1:1 + k] += v * old[:, :, :1]
        cross = v[:, :, :, None] * first[:, :, None, :]
        square = v[:, :, :, None] * v[:, :, None, :] * old[:, :, :1, None]
        new[:, :, 1 + k:] += (cross + cross.transpose(0, 1, 3, 2) + square).reshape(blocks, i + 1, k * k)
        s[:, 1:i + 2] += w * new
    return s


def product(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Product of two polynomials (rows: coefficients; columns: value, first, second derivatives)."""
    size = len(a) + len(b) - 1
    n = 1 << max(size - 1, 1).bit_length()
    fa, fb = np.fft.rfft(a, n, axis=0), np.fft.rfft(b, n, axis=0)
    out = np.empty((len(fa), a.shape[1]), complex)
    out[:, 0] = fa[:, 0] * fb[:, 0]
    da, db = fa[:, 1:1 + k], fb[:, 1:1 + k]
    out[:, 1:1 + k] = da * fb[:, :1] + fa[:, :1] * db
    cross = (da[:, :, None] * db[:, None, :] + db[:, :, None] * da[:, None, :]).reshape(len(fa), k * k)
    out[:, 1 + k:] = fa[:, 1 + k:] * fb[:, :1] + fa[:, :1] * fb[:, 1 + k:] + cross
    return np.fft.irfft(out, n, axis=0)[:size]


def trimmed(lo: int, poly: np.ndarray) -> tuple[int, np.ndarray]:
    """The polynomial without the ends that are below ``TAIL`` of its peak, and its lowest degree."""
    at = np.flatnonzero(poly[:, 0] > TAIL * poly[:, 0].max())
    return lo + int(at[0]), poly[at[0]:at[-1] + 1]


def merged(polys: list[tuple[int, np.ndarray]], k: int) -> tuple[int, np.ndarray]:
    """Product of (lowest degree, polynomial) pairs, pairwise in rounds."""
    while len(polys) > 1:
        odd = [polys[-1]] if len(polys) % 2 else []
        polys = [trimmed(a[0] + b[0], product(a[1], b[1], k)) for a, b in zip(polys[::2], polys[1::2])] + odd
    return polys[0]


def _contribution(poly: np.ndarray, k: int) -> np.ndarray:
    """(log P, first / P, second / P - first first' / P^2) of coefficient rows (..., columns)."""
    value = poly[..., 0]
    first = poly[..., 1:1 + k] / value[..., None]
    second = poly[..., 1 + k:] / value[..., None] - (first[..., :, None] * first[..., None, :]).reshape(*value.shape, k * k)
    return np.concatenate([np.log(value)[..., None], first, second], axis=-1)


def _blocks(order: np.ndarray, p: np.ndarray, x: np.ndarray, length: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Leaf polynomials of the blocks ``order`` (rows ``start`` to ``start + length``), padded to ``width``."""
    at = start[order][:, None] + np.arange(width)
    inside = np.arange(width) < length[order][:, None]
    at = np.where(inside, at, 0)
    return leaf_polynomials(np.where(inside, p[at], 0.0), x[at])


def _cut_blocks(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, length) of runs of at most ``LEAF`` rows of consecutive groups."""
    parts = -(-size // LEAF)
    owner = np.repeat(np.arange(len(size)), parts)
    first = np.cumsum(parts) - parts
    k = np.arange(len(owner)) - first[owner]
    start = (np.cumsum(size) - size)[owner] + k * LEAF
    return owner, start, np.minimum(LEAF, size[owner] - k * LEAF)


def _block_runs(owner, start, length, p, x):
    """(blocks, polynomials) for classes of similar block length, in steps of bounded size."""
    k = x.shape[1]
    width = 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        step = max(1, CELLS // int((w + 1) * (1 + k + k * k)))
        for lo in range(0, len(mine), step):
            yield mine[lo:lo + step], _blocks(mine[lo:lo + step], p, x, length, start, int(w))


def strata_sums(y: np.ndarray, x: np.ndarray, size: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """[strata, log-likelihood, score, Hessian] summed over consecutive whole strata of ``size`` rows."""
    k = x.shape[1]
    out = np.zeros(2 + k + k * k)
    sid = np.repeat(np.arange(len(size)), size)
    cases = np.bincount(sid, weights=y, minlength=len(size))
    use = (cases > 0) & (cases < size)
    if not use.any():
        return out
    keep = use[sid]
    y, x, size, cases = y[keep], x[keep], size[use], cases[use]
    sid = np.repeat(np.arange(len(size)), size)
    mean = np.stack([np.bincount(sid, weights=x[:, j]) for j in range(k)], axis=1) / size[:, None]
    x = x - mean[sid]
    eta = x @ beta
    log_c = np.log(cases / (size - cases))
    for _ in range(60):
        p = 1 / (1 + np.exp(-(eta + log_c[sid])))
        gap = cases - np.bincount(sid, weights=p)
        spread = np.bincount(sid, weights=p * (1 - p))
        if np.all(np.abs(gap) < 1e-3 * np.sqrt(spread) + 1e-9):
            break
        log_c += np.clip(gap / np.maximum(spread, 1e-300), -2, 2)
    a = eta + log_c[sid]
    p = 1 / (1 + np.exp(-a))
    out[0] = len(size)
    out[1] = a[y > 0].sum() - np.logaddexp(0, a).sum()
    out[2:2 + k] = x[y > 0].sum(axis=0)
    owner, start, length = _cut_blocks(size)
    single = -(-size // LEAF) == 1
    many: dict[int, list] = {}
    for run, polys in _block_runs(owner, start, length, p, x):
        one = single[owner[run]]
        if one.any():
            c = _contribution(polys[np.flatnonzero(one), cases[owner[run[one]]].astype(int)], k).sum(axis=0)
            out[1:] -= c
        for b in np.flatnonzero(~one):
            many.setdefault(int(owner[run[b]]), []).append(trimmed(0, polys[b, :length[run[b]] + 1]))
    for s, polys in many.items():
        lo, poly = merged(polys, k)
        out[1:] -= _contribution(poly[int(cases[s]) - lo], k)
    return out


def part_polynomial(x: np.ndarray, mean: np.ndarray, log_c: float, beta: np.ndarray) -> tuple[int, np.ndarray, list[float]]:
    """(lowest degree, polynomial, [sum log(1 + c w), sum p, sum p (1 - p)]) of a part of a stratum."""
    x = x - mean
    a = x @ beta + log_c
    p = 1 / (1 + np.exp(-a))
    owner, start, length = _cut_blocks(np.array([len(x)]))
    polys: list = [None] * len(owner)
    for run, got in _block_runs(owner, start, length, p, x):
        for b, poly in zip(run, got):
            polys[b] = trimmed(0, poly[:length[b] + 1])
    lo, poly = merged(polys, x.shape[1])
    return lo, poly, [float(np.logaddexp(0, a).sum()), float(p.sum()), float((p * (1 - p)).sum())]


# -------------------------------------------------------------------- passes
def _groups(batches, names: int):
    """Record batches of whole groups: rows are sorted by their first ``names`` columns."""
    hold = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        t = t if hold is None else pa.concat_tables([hold, t]).combine_chunks()
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for c in range(names):
            col = t.column(c).combine_chunks()
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            change[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change)
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1])), starts[:-1]
        hold = t.slice(int(starts[-1]))
    if hold is not None and hold.num_rows:
        yield hold, np.array([0])


FIELDS = "hid int, part long, lo long, poly binary, sums array<double>"


def _row(hid: int, part: int, lo: int, poly: bytes, sums) -> tuple:
    return hid, part, lo, poly, list(map(float, sums))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["hid", "part", "lo", "poly", "sums"])


def _evaluate(batches, k: int, beta: np.ndarray, heavy: dict):
    """Sums of the whole strata of a partition (one row, hid -1) and polynomials of the heavy ones' parts."""
    total = np.zeros(2 + k + k * k)
    for t, starts in _groups(batches, 3):
        hid = t.column("_hid").to_numpy()
        y = t.column("_y").to_numpy()
        x = np.column_stack([t.column(f"_x{j}").to_numpy() for j in range(k)])
        ends = np.r_[starts[1:], t.num_rows]
        own = hid[starts] < 0
        if own.any():
            rows = np.repeat(own, ends - starts)
            total += strata_sums(y[rows], x[rows], (ends - starts)[own], beta)
        for lo, hi in zip(starts[~own], ends[~own]):
            h = int(hid[lo])
            mean, log_c = heavy[h]
            low, poly, sums = part_polynomial(x[lo:hi], mean, log_c, beta)
            d = x[lo:hi] - mean
            case = y[lo:hi] > 0
            yield _record([_row(h, int(t.column("_part")[int(lo)].as_py()), low, poly.tobytes(),
                                [*sums, float((d[case] @ beta + log_c).sum()), *d[case].sum(axis=0)])])
    yield _record([_row(-1, 0, 0, b"", total)])


def _merge(batches, k: int, cases: dict | None):
    """Multiplies the polynomials of a group of parts; with ``cases`` a heavy stratum is finished."""
    open_: dict = {"key": None, "polys": [], "sums": None}

    def close():
        if open_["key"] is None:
            return
        hid, part = open_["key"]
        sums = open_["sums"]
        if hid < 0:
            yield _record([_row(-1, 0, 0, b"", sums)])
            return
        lo, poly = merged(open_["polys"], k)
        if cases is None:
            yield _record([_row(hid, part, lo, poly.tobytes(), sums)])
            return
        at = cases[hid] - lo
        done = np.zeros(2 + k + k * k)
        done[0] = 1
        done[1] = sums[3] - sums[0]
        done[2:2 + k] = sums[4:]
        if 0 <= at < len(poly) and poly[at, 0] > 0:
            done[1:] -= _contribution(poly[at], k)
        else:
            done[1] = -np.inf
        yield _record([_row(hid, 0, 0, b"", [*done, *sums[1:3]])])

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["hid"], r["part"])
            if key != open_["key"]:
                yield from close()
                open_.update(key=key, polys=[], sums=0)
            if r["hid"] >= 0:
                open_["polys"].append((r["lo"], np.frombuffer(r["poly"]).reshape(-1, 1 + k + k * k)))
                if len(open_["polys"]) == 8:
                    open_["polys"] = [merged(open_["polys"], k)]
            open_["sums"] = open_["sums"] + np.array(r["sums"])
    yield from close()


class ExactLayout:
    """Rows of the strata, laid out for repeated evaluation."""

    def __init__(self, data: DataFrame, y: str, features: list[str], strata: str, heavy_strata: int = HEAVY_STRATA, part_rows: int = PART_ROWS):
        self.k = len(features)
        spark = data.sparkSession
        xs = [F.col(c).cast("double") for c in features]
        counts = data.groupBy(F.col(strata).alias("_s")).agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col(y).cast("double") > 0).cast("long")).alias("m"), *[F.avg(x).alias(f"x{j}") for j, x in enumerate(xs)])
        rows = data.count()
        # fewer than heavy_strata strata can hold more than this share of the rows
        limit = max(rows // heavy_strata, part_rows)
        top = counts.where(F.col("n") > limit).collect()
        self.heavy = {h: (int(r["n"]), int(r["m"]), np.array([r[f"x{j}"] for j in range(self.k)], dtype=float)) for h, r in enumerate(top)}
        self.log_c = {h: math.log(m / (n - m)) for h, (n, m, _) in self.heavy.items() if 0 < m < n}
        d = data.select(F.col(strata).alias("_s"), (F.col(y).cast("double") > 0).cast("double").alias("_y"), *[x.alias(f"_x{j}") for j, x in enumerate(xs)])
        d = d.withColumn("_no", F.monotonically_increasing_id())
        if top:
            schema = d.select(F.col("_s").alias("_t")).schema.add("_hid", T.IntegerType()).add("_parts", T.LongType())
            names = spark.createDataFrame([(r["_s"], h, -(-int(r["n"]) // part_rows)) for h, r in enumerate(top)], schema)
            d = d.join(F.broadcast(names), F.col("_s") == F.col("_t"), "left").drop("_t")
            d = d.withColumn("_part", F.coalesce(F.pmod(F.col("_no"), F.col("_parts")), F.lit(0))).withColumn("_hid", F.coalesce("_hid", F.lit(-1)))
            flat = [h for h in self.heavy if h not in self.log_c]  # all cases or none: no information
            d = d.where(~F.col("_hid").isin(flat)) if flat else d
        else:
            d = d.withColumn("_part", F.lit(0).cast("long")).withColumn("_hid", F.lit(-1))
        cols = ["_hid", "_part", "_s", "_y", *[f"_x{j}" for j in range(self.k)]]
        self.rows = (d.select(cols).repartition("_hid", "_part", "_s").sortWithinPartitions("_hid", "_part", "_s").persist(StorageLevel.MEMORY_AND_DISK))

    def evaluate(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        """(log-likelihood, score, Hessian, informative strata) at ``beta``; the tilts of split
        strata follow ``beta`` until their means are within one deviation of the cases."""
        k = self.k
        for _ in range(50):
            heavy = {h: (self.heavy[h][2], c) for h, c in self.log_c.items()}
            out = self.rows.mapInArrow(lambda it: _evaluate(it, k, beta, heavy), FIELDS)
            if heavy:
                cases = {h: self.heavy[h][1] for h in heavy}
                some = out.withColumn("part", F.floor(F.col("part") / F.lit(MERGED_PARTS))).repartition("hid", "part").sortWithinPartitions("hid", "part")
                some = some.mapInArrow(lambda it: _merge(it, k, None), FIELDS).withColumn("part", F.lit(0).cast("long"))
                out = some.repartition("hid").sortWithinPartitions("hid").mapInArrow(lambda it: _merge(it, k, cases), FIELDS)
            width = 2 + k + k * k
            sums = out.groupBy("hid").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width + (2 if heavy else 0))]).collect()
            moved = False
            for r in sums:
                if r["hid"] >= 0:
                    gap, spread = self.heavy[r["hid"]][1] - r[f"s{width}"], max(r[f"s{width + 1}"], 1e-300)
                    if abs(gap) > math.sqrt(spread):
                        self.log_c[r["hid"]] += min(2.0, max(-2.0, gap / spread))
                        moved = True
            if not moved:
                break
        v = np.array([[r[f"s{i}"] or 0.0 for i in range(width)] for r in sums], dtype=float).sum(axis=0)
        return float(v[1]), v[2:2 + k], v[2 + k:].reshape(k, k), int(v[0])

    def close(self) -> None:
        self.rows.unpersist()


def fit_exact(data: DataFrame, y: str, features: list[str], strata: str, max_iter: int = 50, tol: float = 1e-10,
              heavy_strata: int = HEAVY_STRATA, part_rows: int = PART_ROWS) -> dict:
    """Newton's method on the exact conditional likelihood; keys theta, cov, llf, ll0, strata,
    converged, iterations."""
    layout = ExactLayout(data, y, features, strata, heavy_strata, part_rows)
    try:
        theta = np.zeros(len(features))
        llf, g, h, strata_n = layout.evaluate(theta)
        if not strata_n:
            raise ValueError(f"no stratum of {strata!r} has both cases and controls")
        ll0, converged, it = llf, False, 0
        for it in range(1, max_iter + 1):
            step = np.linalg.solve(-h, g)
            if np.max(np.abs(step)) < tol * (1 + np.max(np.abs(theta))):
                theta, converged = theta + step, True
                break
            t = 1.0
            while True:
                cand = theta + t * step
                got = layout.evaluate(cand)
                if got[0] >= llf - 1e-12 * abs(llf) or t < 1e-8:
                    break
                t /= 2
            theta, (llf, g, h, _) = cand, got
        return {"theta": theta, "cov": np.linalg.inv(-h), "llf": llf, "ll0": ll0, "strata": strata_n, "converged": converged, "iterations": it}
    finally:
        layout.close()
