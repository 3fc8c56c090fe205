"""Dynamic panel GMM (N5): Arellano-Bond difference GMM, over-identified, one- and two-step.

Model y(t) = a y(t-1) + x(t)'b + effect + error, in first differences. The instruments of period t are
the levels y(t-2), y(t-3), ... (``max_lag`` of them; a column per period and lag, or a column per lag with
``collapse``) and the differences of x. An entity adds

    Z'[dy, dX]                                 J x (1 + K)
    sum over t of r(t-m) r(t)', m = 1, 2       (1 + K) x (1 + K), r = (dy, dy(-1), dx)

and everything after that is a function of the sums and of the Gram matrix of these entity rows, so one
pass serves every weighting matrix and both steps: the two-step weight, the
finite-sample correction of its covariance, Sargan and Hansen tests and the tests of serial correlation
are contractions of that Gram matrix on the driver.

Rows are grouped by entity once. (entity, period) must be unique, so a group holds at most one
row per period (``MAX_PERIODS`` is checked before anything is collected); tasks add up their entities in
numpy and send one row of sums each. Periods are integers; gaps are allowed, a missing level is
no instrument and a difference needs both of its periods.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import sig
from .linear import design

#: Calendar periods from the first to the last; each is a column of a task's panel.
MAX_PERIODS = 2000
#: Cells of one vectorised step (entities x periods x instruments).
CELLS = 4_000_000


@dataclass
class GMMFit:
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    groups: int
    instruments: int
    steps: int
    tests: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def coef_rows(self) -> list[tuple]:
        z = self.beta / self.se
        return [(t, sig(b), sig(s), sig(v), sig(2 * dist.norm_sf(abs(v)))) for t, b, s, v in zip(self.terms, self.beta, self.se, z)]

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.coef_rows(), "term string, coefficient double, se double, z_stat double, p_value double")

    def test_table(self, spark: SparkSession) -> DataFrame:
        rows = [(name, sig(s) if s is not None else None, df, sig(p) if p is not None else None) for name, (s, df, p) in self.tests.items()]
        return spark.createDataFrame(rows, "test string, statistic double, df int, p_value double")


def instrument_columns(periods: int, max_lag: int, collapse: bool) -> list[tuple[int, int]]:
    """(period or -1, lag) of each level instrument."""
    if collapse:
        return [(-1, lag) for lag in range(2, min(max_lag, periods - 1) + 2) if lag < periods]
    return [(t, lag) for t in range(2, periods) for lag in range(2, min(t, max_lag + 1) + 1)]


def entity_sums(level: np.ndarray, x: np.ndarray, columns: list[tuple[int, int]]) -> dict:
    """Sums over entities of a dense panel: ``level`` (entities, periods), ``x`` (entities, periods, k);
    NaN where an entity has no row."""
    e, t = level.shape
    k = x.shape[2]
    dy, dx = np.full((e, t), np.nan), np.full((e, t, k), np.nan)
    dy[:, 1:], dx[:, 1:] = level[:, 1:] - level[:, :-1], x[:, 1:] - x[:, :-1]
    lag = np.full((e, t), np.nan)
    lag[:, 1:] = dy[:, :-1]
    r = np.concatenate([dy[:, :, None], lag[:, :, None], dx], axis=2)
    use = np.isfinite(r).all(axis=2)
    r = np.where(use[:, :, None], r, 0.0)
    z = np.zeros((e, t, len(columns) + k))
    have = np.where(np.isfinite(level), level, 0.0)
    for j, (period, back) in enumerate(columns):
        if period < 0:
            z[:, back:, j] = have[:, :t - back]
        else:
            z[:, period, j] = have[:, period - back]
    z[:, :, len(columns):] = np.where(np.isfinite(dx), dx, 0.0)
    z *= use[:, :, None]
    own = use.any(axis=1)
    zr = np.einsum("etj,etr->ejr", z, r).reshape(e, -1)
    serial = []
    for m in (1, 2):
        back = np.zeros_like(r)
        back[:, m:] = r[:, :-m] if t > m else 0.0
        serial.append(np.einsum("eta,etb->eab", back, r).reshape(e, -1))
    v = np.concatenate([zr, *serial], axis=1)
    near = np.einsum("eti,etj->ij", z[:, 1:], z[:, :-1])
    return {"gram": v.T @ v, "total": v.sum(axis=0), "rr": np.einsum("eta,etb->ab", r, r),
            "weight": 2 * np.einsum("eti,etj->ij", z, z) - near - near.T, "groups": np.array([own.sum()]), "n": np.array([use.sum()])}


def panel_sums(df: DataFrame, y: str, features: list[str], entity: str, period: str, max_lag: int | None, collapse: bool) -> tuple[dict, int]:
    """(sums of :func:`entity_sums` over all entities, level instruments)."""
    data = design(df, y, features, extra=[entity, period]).select(
        F.col(entity).alias("_e"), F.col(period).cast("long").alias("_t"), *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate([y, *features])])
    span = data.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).first()
    if span["lo"] is None:
        raise ValueError("no complete rows")
    t = span["hi"] - span["lo"] + 1
    if t > MAX_PERIODS:
        raise ValueError(f"{t} periods from {span['lo']} to {span['hi']}: difference GMM is for panels of at most {MAX_PERIODS}")
    twice = data.groupBy("_e", "_t").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"({entity}, {period}) is not unique")
    columns = instrument_columns(t, max_lag or t, collapse)
    k, lo = len(features), span["lo"]
    names = ["gram", "total", "rr", "weight", "groups", "n"]

    def add(batches):
        total: dict | None = None
        step = max(1, CELLS // (t * (len(columns) + 2 * k + 4)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                lists = batch.column(0).slice(at, step)
                part = lists.flatten()
                e = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                p = part.field(0).to_numpy() - lo
                panel = np.full((len(lists), t, 1 + k), np.nan)
                for j in range(1 + k):
                    panel[e, p, j] = part.field(1 + j).to_numpy()
                got = entity_sums(panel[:, :, 0], panel[:, :, 1:], columns)
                total = got if total is None else {n: total[n] + got[n] for n in names}
        if total is not None:
            v = np.concatenate([total[n].ravel() for n in names]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["pos", "v"])

    row = F.struct("_t", *[f"_v{j}" for j in range(1 + k)])
    grouped = data.groupBy("_e").agg(F.collect_list(row).alias("rows")).select("rows")
    sums = {r["pos"]: r["v"] for r in grouped.mapInArrow(add, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([sums[i] for i in range(len(sums))])
    j, width = len(columns) + k, 2 + k
    size = j * width + 2 * width * width
    shapes = {"gram": (size, size), "total": (size,), "rr": (width, width), "weight": (j, j), "groups": (), "n": ()}
    out, at = {}, 0
    for name in names:
        cells = int(np.prod(shapes[name]))
        out[name] = flat[at:at + cells].reshape(shapes[name])
        at += cells
    return out, len(columns)


def _serial_test(m: int, s: dict, j: int, width: int, c: np.ndarray, cov: np.ndarray, gain: np.ndarray) -> tuple:
    """z test that differenced residuals are uncorrelated at distance m."""
    at = j * width + (m - 1) * width * width
    sel = slice(at, at + width * width)
    cc = np.outer(c, c).ravel()
    total = s["total"][sel].reshape(width, width)
    d = float(c @ total @ c)
    dd = float(cc @ s["gram"][sel, sel] @ cc)
    wx = (c @ total)[1:]
    zd = np.einsum("jac,a,c->j", s["gram"][:j * width, sel].reshape(j, width, -1), c, cc)
    var = dd - 2 * wx @ gain @ zd + wx @ cov @ wx
    if var <= 0 or dd == 0:
        return None, None, None
    z = d / math.sqrt(var)
    return z, None, 2 * dist.norm_sf(abs(z))


def arellano_bond(df: DataFrame, y: str, features: list[str], entity: str, period: str, max_lag: int | None = None, collapse: bool = False,
                  steps: int = 2) -> GMMFit:
    """Difference GMM. One step: robust covariance. Two steps: the weight is the inverse of the
    entities' score Gram at the one-step estimate, the covariance carries the correction for
    that estimate (a first-order term in b). ``tests`` holds sargan (one step), hansen, ar1 and ar2 as
    (statistic, degrees of freedom, p-value); with as many instruments as coefficients the
    first two have no degrees of freedom and are None."""
    s, levels = panel_sums(df, y, features, entity, period, max_lag, collapse)
    k, j = 1 + len(features), levels + len(features)
    width = 1 + k
    if j < k:
        raise ValueError(f"{j} instruments for {k} coefficients: too few periods")
    z = s["total"][:j * width].reshape(j, width)
    zy, zx = z[:, 0], z[:, 1:]
    g4 = s["gram"][:j * width, :j * width].reshape(j, width, j, width)

    def solve(w):
        inv = np.linalg.inv(zx.T @ w @ zx)
        return inv @ zx.T @ w @ zy, inv, inv @ zx.T @ w

    def scores(b):  # sum over entities of Z'u u'Z
        c = np.r_[1.0, -b]
        return np.einsum("aibj,i,j->ab", g4, c, c)

    w1 = np.linalg.pinv(s["weight"], hermitian=True)
    beta, bread, gain = solve(w1)
    a2 = scores(beta)
    cov = gain @ a2 @ gain.T
    n, free = int(s["n"]), j - k
    e = zy - zx @ beta
    c1 = np.r_[1.0, -beta]
    sigma2 = float(c1 @ s["rr"] @ c1) / (2 * (n - k))
    sargan = float(e @ w1 @ e) / sigma2
    tests = {"sargan": (sargan, free, dist.chi2_sf(sargan, free)) if free else (None, 0, None)}
    if steps == 2:
        w2 = np.linalg.pinv(a2, hermitian=True)
        first_cov = cov
        slope = [np.einsum("abj,j->ab", g4[:, 1 + i], c1) for i in range(k)]  # Z'x u'Z
        beta, bread, gain = solve(w2)
        e2 = zy - zx @ beta
        d = np.column_stack([gain @ (x + x.T) @ w2 @ e2 for x in slope])
        cov = bread + d @ bread + bread @ d.T + d @ first_cov @ d.T
        hansen = float(e2 @ w2 @ e2)
        tests["hansen"] = (hansen, free, dist.chi2_sf(hansen, free)) if free else (None, 0, None)
    c = np.r_[1.0, -beta]
    for m in (1, 2):
        tests[f"ar{m}"] = _serial_test(m, s, j, width, c, cov, gain)
    return GMMFit([f"L.{y}", *features], beta, cov, n, int(s["groups"]), j, steps, tests)
