"""Panel estimators (N1-N5): within (one- and two-way), between, first
differences, random effects (Swamy-Arora), Hausman, F test for effects,
Wooldridge serial-correlation test, difference GMM.

One partial aggregate per entity (its Gram row) carries all that the within,
between and quasi-demeaned moments need: no group mean is joined back to the
rows, so a hot entity costs one row per task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import sig
from ..functions.linalg import sym_inv
from ..plans.gram import Moments, gram, group_shrunk_moments, grouped_gram
from ..plans.order import series_lags
from ..session import shared_folder
from .linear import design


@dataclass
class PanelFit:
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    groups: int
    ssr: float
    df_resid: int
    method: str

    @property
    def se(self):
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def coef_rows(self) -> list[tuple]:
        out = []
        for t, b, s in zip(self.terms, self.beta, self.se):
            tv = b / s if s > 0 else math.nan
            out.append((t, sig(b), sig(s), sig(tv), sig(dist.t_two_sided_p(tv, self.df_resid))))
        return out

    def coefficients(self, spark: SparkSession):
        return spark.createDataFrame(self.coef_rows(), "term string, coefficient double, se double, t_stat double, "
                                                       "p_value double")


def _solve_raw(mom: Moments, y: str, xs: list[str]):
    xtx = mom.m[np.ix_(mom.idx(xs), mom.idx(xs))]
    xty = mom.m[np.ix_(mom.idx(xs), mom.idx([y]))][:, 0]
    inv = sym_inv(xtx, xs)
    b = inv @ xty
    yty = mom.m[mom.idx([y])[0], mom.idx([y])[0]]
    return b, inv, max(float(yty - b @ xty), 0.0)


#: Periods of a two-way model whose cross-products are a matrix on the driver; with more, the period
#: effects are partialled out by conjugate gradients over distributed vectors (the same result).
MAX_PERIODS = 500
CG_ROUNDS, CG_TOLERANCE = 500, 1e-11


def within(df: DataFrame, y: str, features: list[str], entity: str, time: str | None = None) -> PanelFit:
    """Fixed effects from the entities' Gram rows; with ``time`` two-way, exactly: the
    period effects are partialled out of the within moments."""
    cols = [y] + list(features)
    data = design(df, y, features, extra=[entity] + ([time] if time else []))
    if time:
        mom, groups, extra_df = _two_way_moments(data, cols, entity, time)
    else:
        mom, groups = group_shrunk_moments(grouped_gram(data, [entity], cols), cols, F.lit(1.0))
        extra_df = 0
    b, inv, ssr = _solve_raw(mom, y, list(features))
    dfr = mom.n - groups - len(features) - extra_df
    return PanelFit(list(features), b, inv * ssr / dfr, mom.n, groups, ssr, dfr, "within")


def _two_way_moments(data: DataFrame, cols: list[str], entity: str, time: str) -> tuple[Moments, int, int]:
    """Moments after entity and period effects, the number of entities and the rank of the
    periods. One aggregate per (entity, period) cell, one list of at most ``MAX_PERIODS``
    cells per entity; tasks add up the cross-products and send one matrix each."""
    periods = [r[0] for r in data.select(time).distinct().orderBy(time).limit(MAX_PERIODS + 1).collect()]
    if len(periods) > MAX_PERIODS:
        return _two_way_by_gradients(data, cols, entity, time)
    p, t = len(cols), len(periods)
    total = gram(data, cols)
    index = F.array_position(F.array(*[F.lit(x) for x in periods]), F.col(time)) - 1
    cells = (data.groupBy(entity, index.cast("int").alias("_t"))
             .agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(cols)]))
    rows = cells.groupBy(entity).agg(F.collect_list(F.struct("_t", "_n", *[f"_s{i}" for i in range(p)])).alias("c")).select("c")

    def add(batches):
        acc = np.zeros((t + p, t + p))
        groups = 0
        for pdf in batches:
            for c in pdf["c"]:
                v = np.array([tuple(x.values()) for x in c], dtype=float)
                at, n, s = v[:, 0].astype(int), v[:, 1], v[:, 2:]
                z = np.zeros(t + p)
                z[at] = n
                z[t:] = s.sum(axis=0)
                acc -= np.outer(z, z) / n.sum()
                acc[at, at] += n
                acc[at, t:] += s
                acc[t:, at] += s.T
                groups += 1
        yield pd.DataFrame({"pos": np.arange(acc.size + 1), "v": np.r_[acc.ravel(), groups]})

    got = np.zeros((t + p) ** 2 + 1)
    for r in rows.mapInPandas(add, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        got[r["pos"]] = r["v"]
    m = got[:-1].reshape(t + p, t + p)
    m[t:, t:] += total.m
    inner = m[:t, :t]
    left = m[t:, t:] - m[t:, :t] @ np.linalg.pinv(inner, rcond=1e-10, hermitian=True) @ m[:t, t:]
    rank = int(np.linalg.matrix_rank(inner, tol=1e-8 * max(1.0, float(np.abs(inner).max()))))
    return Moments(list(cols), total.n, total.sw, total.s, left), int(got[-1]), rank


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _two_way_by_gradients(data: DataFrame, cols: list[str], entity: str, time: str) -> tuple[Moments, int, int]:
    """:func:`_two_way_moments` for any number of periods. With A = D_t - N' D_e^-1 N (periods x periods,
    never built) and r the period sums after the entity effects, the moments are those within entities minus
    r' A^+ r. A x = r is solved for all columns at once by conjugate gradients, preconditioned by the
    period sizes: a product with A is a grouped sum per entity and one per period over the (entity, period)
    cells. Vectors are tables with a row per period, written in every round; the driver sees their dot products."""
    p = len(cols)
    total = gram(data, cols)
    sums = [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
    cells = _written(data.groupBy(F.col(entity).alias("e"), F.col(time).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums), "two-way-cells")
    ent = cells.groupBy("e").agg(F.sum("n").alias("m"), *[F.sum(f"s{i}").alias(f"m{i}") for i in range(p)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = ent.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"m{i}") * F.col(f"m{j}") / F.col("m")).alias(f"w{i}_{j}") for i, j in pairs]).first()
    start = cells.join(ent, "e").groupBy("t").agg(F.sum("n").alias("d"), *[F.sum(F.col(f"s{i}") - F.col("n") * F.col(f"m{i}") / F.col("m")).alias(f"r{i}") for i in range(p)])
    v = start.withColumns({f"x{i}": F.lit(0.0) for i in range(p)})
    v = _written(v.withColumns({f"q{i}": F.col(f"r{i}") / F.col("d") for i in range(p)}).withColumns({f"b{i}": F.col(f"r{i}") for i in range(p)}), "two-way-vector")

    def dots(df, exprs):
        r = df.agg(*[F.sum(e).alias(f"a{i}") for i, e in enumerate(exprs)]).first()
        return np.array([r[f"a{i}"] or 0.0 for i in range(len(exprs))])

    rho = dots(v, [F.col(f"r{i}") * F.col(f"r{i}") / F.col("d") for i in range(p)])
    first = np.maximum(rho, 1e-300)
    for _ in range(CG_ROUNDS):
        if np.all(rho <= CG_TOLERANCE ** 2 * first):
            break
        moved = cells.select("e", "t", "n").join(v.select("t", *[f"q{i}" for i in range(p)]), "t")
        mean = moved.groupBy("e").agg(*[(F.sum(F.col("n") * F.col(f"q{i}")) / F.sum("n")).alias(f"h{i}") for i in range(p)])
        aq = moved.join(mean, "e").groupBy("t").agg(*[F.sum(F.col("n") * (F.col(f"q{i}") - F.col(f"h{i}"))).alias(f"aq{i}") for i in range(p)])
        step = _written(v.join(aq, "t"), "two-way-step")
        curve = dots(step, [F.col(f"q{i}") * F.col(f"aq{i}") for i in range(p)])
        alpha = np.where(curve > 0, rho / np.where(curve > 0, curve, 1.0), 0.0)
        v = step.withColumns({**{f"x{i}": F.col(f"x{i}") + F.lit(float(alpha[i])) * F.col(f"q{i}") for i in range(p)},
                              **{f"r{i}": F.col(f"r{i}") - F.lit(float(alpha[i])) * F.col(f"aq{i}") for i in range(p)}})
        new = dots(v, [F.col(f"r{i}") * F.col(f"r{i}") / F.col("d") for i in range(p)])
        beta = np.where(rho > 0, new / np.where(rho > 0, rho, 1.0), 0.0)
        v = _written(v.withColumns({f"q{i}": F.col(f"r{i}") / F.col("d") + F.lit(float(beta[i])) * F.col(f"q{i}") for i in range(p)})
                     .drop(*[f"aq{i}" for i in range(p)]), "two-way-vector")
        rho = new
    else:
        raise RuntimeError(f"period effects not settled after {CG_ROUNDS} rounds")
    part = dots(v, [(F.col(f"b{i}") * F.col(f"x{j}") + F.col(f"b{j}") * F.col(f"x{i}")) / 2 for i, j in pairs])
    left = total.m.copy()
    for (i, j), a in zip(pairs, part):
        left[i, j] = left[j, i] = total.m[i, j] - got[f"w{i}_{j}"] - a
    return Moments(list(cols), total.n, total.sw, total.s, left), int(got["g"]), v.count() - _components(cells)


def _components(cells: DataFrame) -> int:
    """Connected components of the (entity, period) graph: the least period label spreads until it stands still."""
    lab = cells.select("t").distinct().withColumn("l", F.col("t"))
    before = None
    while True:
        by_e = cells.select("e", "t").join(lab, "t").groupBy("e").agg(F.min("l").alias("k"))
        lab = _written(cells.select("e", "t").join(by_e, "e").groupBy("t").agg(F.min("k").alias("l")), "two-way-labels")
        now = lab.agg(F.count_distinct("l"), F.sum(F.xxhash64("l", "t").cast("decimal(38,0)"))).first()
        if now == before:
            return int(now[0])
        before = now


def between(df: DataFrame, y: str, features: list[str], entity: str) -> PanelFit:
    """OLS on entity means."""
    from .linear import ols
    data = design(df, y, features, extra=[entity])
    means = data.groupBy(entity).agg(*[F.avg(c).alias(c) for c in [y] + list(features)])
    fit = ols(means, y, features)
    return PanelFit(fit.terms, fit.beta, fit.cov, fit.n, fit.n, fit.ssr, fit.df_resid, "between")


def first_difference(df: DataFrame, y: str, features: list[str], entity: str, time) -> PanelFit:
    """OLS without constant on within-entity first differences."""
    tcols = [time] if isinstance(time, str) else list(time)
    data = design(df, y, features, extra=[entity] + tcols)
    cols = [y] + list(features)
    lagged = series_lags(data, [entity], tcols, cols, 1)
    d = lagged.select(*[(F.col(c).cast("double") - F.col(f"{c}_lag1")).alias(c) for c in cols]).dropna()
    mom = gram(d, cols)
    b, inv, ssr = _solve_raw(mom, y, list(features))
    dfr = mom.n - len(features)
    return PanelFit(list(features), b, inv * ssr / dfr, mom.n, 0, ssr, dfr, "first_difference")


def random_effects(df: DataFrame, y: str, features: list[str], entity: str) -> PanelFit:
    """Swamy-Arora variance components, quasi-demeaning with theta_i per entity."""
    data = design(df, y, features, extra=[entity])
    fe = within(data, y, features, entity)
    be = between(data, y, features, entity)
    k = len(features)
    s2_e = fe.ssr / (fe.n - fe.groups - k)
    tbar = fe.n / fe.groups
    s2_between = be.ssr / (be.n - k - 1)
    s2_u = max(s2_between - s2_e / tbar, 0.0)
    cols = [y] + list(features)
    theta = F.lit(1.0) - F.sqrt(F.lit(s2_e) / (F.col("_n") * F.lit(s2_u) + F.lit(s2_e)))
    mom, _ = group_shrunk_moments(grouped_gram(data, [entity], cols), cols, theta, const=True)
    b, inv, ssr = _solve_raw(mom, y, ["_c"] + list(features))
    dfr = mom.n - k - 1
    return PanelFit(["const"] + list(features), b, inv * ssr / dfr, mom.n, fe.groups, ssr, dfr, "random_effects")


def hausman(fe: PanelFit, re: PanelFit) -> dict:
    """(b_fe - b_re)' (V_fe - V_re)^-1 (b_fe - b_re) ~ chi2(k)."""
    idx = [re.terms.index(t) for t in fe.terms]
    d = fe.beta - re.beta[idx]
    v = fe.cov - re.cov[np.ix_(idx, idx)]
    stat = float(d @ np.linalg.pinv(v) @ d)
    return {"hausman": stat, "df": len(d), "p_value": dist.chi2_sf(stat, len(d))}


def fe_f_test(df: DataFrame, y: str, features: list[str], entity: str) -> dict:
    """F test that all entity effects are zero (pooled vs within SSR)."""
    from .linear import ols
    data = design(df, y, features, extra=[entity])
    pooled = ols(data, y, features)
    fe = within(data, y, features, entity)
    num = (pooled.ssr - fe.ssr) / (fe.groups - 1)
    den = fe.ssr / fe.df_resid
    f = num / den
    return {"f_stat": f, "df_num": fe.groups - 1, "df_den": fe.df_resid, "p_value": dist.f_sf(f, fe.groups - 1, fe.df_resid)}


def wooldridge_ac(df: DataFrame, y: str, features: list[str], entity: str, time) -> dict:
    """Regress FD residuals on their own lag; H0 coefficient = -0.5 (clustered by entity).
    Two lags of each column come from one entity-led global order (no single-task entity): a row then holds its
    own difference and the one before. The differences are written, so that the rows are sorted once for the slopes and
    for the sums of each entity."""
    tcols = [time] if isinstance(time, str) else list(time)
    cols = [y] + list(features)
    # positions, so that a column may be entity, time and target at once
    data = design(df, y, features, extra=[entity] + tcols).withColumns({f"_v{j}": F.col(c).cast("double") for j, c in enumerate(cols)})
    lagged = series_lags(data, [entity], tcols, [f"_v{j}" for j in range(len(cols))], 2)
    d = lagged.select(entity, *[(F.col(f"_v{j}") - F.col(f"_v{j}_lag1")).alias(f"_d{j}") for j in range(len(cols))],
                      *[(F.col(f"_v{j}_lag1") - F.col(f"_v{j}_lag2")).alias(f"_l{j}") for j in range(len(cols))]
                      ).dropna(subset=[f"_d{j}" for j in range(len(cols))])
    d = _written(d, "wooldridge-differences")
    slopes = [f"_d{j}" for j in range(1, len(cols))]
    beta, _, _ = _solve_raw(gram(d.select("_d0", *slopes), ["_d0", *slopes]), "_d0", slopes)
    e, el = (F.col(f"{k}0") - sum((F.lit(float(b)) * F.col(f"{k}{j}") for j, b in enumerate(beta, start=1)), F.lit(0.0)) for k in ("_d", "_l"))
    sums = (d.select(entity, e.alias("_e"), el.alias("_el")).dropna(subset=["_el"]).groupBy(entity)
            .agg(F.sum(F.col("_e") * F.col("_el")).alias("xy"), F.sum(F.col("_el") ** 2).alias("xx")))
    sums = _written(sums, "wooldridge-sums")
    r = sums.agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx")).first()
    rho = r["xy"] / r["xx"]
    # sum of el (e - rho el) of each entity
    meat = sums.agg(F.sum((F.col("xy") - F.lit(rho) * F.col("xx")) ** 2), F.count(F.lit(1))).first()
    se = math.sqrt(meat[0]) / r["xx"]
    f = ((rho + 0.5) / se) ** 2
    return {"rho": rho, "f_stat": f, "p_value": dist.f_sf(f, 1, meat[1] - 1)}


def difference_gmm(df: DataFrame, y: str, features: list[str], entity: str, time) -> dict:
    """N5 (one-step, just-identified Anderson-Hsiao form): instrument dy_{t-1} with y_{t-2}."""
    from .causal import iv2sls
    tcols = [time] if isinstance(time, str) else list(time)
    d = design(df, y, features, extra=[entity] + tcols)
    d = series_lags(d, [entity], tcols, [y] + list(features), 2)
    d = (d.withColumn("_ly", F.col(f"{y}_lag1")).withColumn("_l2y", F.col(f"{y}_lag2"))
         .withColumn("_dy", F.col(y) - F.col("_ly")).withColumn("_dly", F.col("_ly") - F.col("_l2y")))
    for c in features:
        d = d.withColumn(f"_d_{c}", F.col(c) - F.col(f"{c}_lag1"))
    d = d.dropna(subset=["_dy", "_dly", "_l2y"] + [f"_d_{c}" for c in features])
    fit = iv2sls(d, "_dy", [f"_d_{c}" for c in features], ["_dly"], ["_l2y"])
    return {"terms": fit["terms"], "beta": fit["beta"], "se": fit["se"], "n_obs": fit["n"]}
