"""Time series (M1-M8): lags and differences per series, resampling, ACF /
PACF, ADF / KPSS, AR / VAR / Granger, Engle-Granger ECM, per-series
features and CUSUM.

A global order uses GIDX (``plans.order``); a natural series key uses
``Window.partitionBy(series)`` so each series is sorted inside its own task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.columns import sig
from ..plans.autocov import bartlett, lag_products, weighted_products
from ..plans.gram import gram, grouped_gram, moments_from_row
from ..plans.order import GlobalOrder, check_unique, series_lags
from .linear import CONST, solve_moments


def _ob(order_by) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


# ----------------------------------------------------------------- M1
def lags_and_diffs(df: DataFrame, col: str, series: list[str] | str, order_by, lags: int = 1,
                   diff: int = 1) -> DataFrame:
    """Lag and difference columns per series (series-led global order: a hot series is
    split across tasks instead of being sorted in one)."""
    L = max(lags, diff)
    out = series_lags(df, series, order_by, [col], L)
    for lag in range(lags + 1, L + 1):
        out = out.drop(f"{col}_lag{lag}")
    if diff:
        out = out.withColumn(f"{col}_diff{diff}", F.col(col).cast("double") - F.col(f"{col}_lag{diff}"))
        if diff > lags:
            out = out.drop(f"{col}_lag{diff}")
    return out.drop("_b", "_idx")


def resample(df: DataFrame, ts: str, step: str, value: str, series: list[str] | str | None = None,
             how: str = "sum") -> DataFrame:
    """Aggregate to a fixed time grid and fill empty slots from a per-series spine."""
    series = [] if series is None else [series] if isinstance(series, str) else list(series)
    t = F.col(ts).cast("timestamp")
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}[how]
    binned = (df.withColumn("_slot", F.window(t, step).start)
              .groupBy(*series, "_slot").agg(agg(value).alias(value)))
    bounds = binned.groupBy(*series).agg(F.min("_slot").alias("_lo"), F.max("_slot").alias("_hi"))
    spine = bounds.select(*series, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias("_slot"))
    out = spine.join(binned, series + ["_slot"], "left")
    fill = 0 if how in ("sum", "count") else None
    if fill is not None:
        out = out.fillna({value: fill})
    return out.withColumnRenamed("_slot", "slot")


# ----------------------------------------------------------------- M3
def acf(df: DataFrame, col: str, order_by, lags: int = 10, return_n: bool = False):
    """Autocorrelations 0..lags over a global order, by block-wise FFTs (no column per lag)."""
    ob = _ob(order_by)
    data, n = _centred(df, col, ob)
    order = GlobalOrder(data, ob).with_running_sums([])
    check_unique(order.agg(F.sum("_tie")).first()[0], ob)
    g = lag_products(order, ["_e"], lags)[:, 0, 0]
    rho = (g / g[0]).tolist()
    return (rho, n) if return_n else rho


def _centred(df: DataFrame, col: str, ob: list[str]) -> tuple[DataFrame, int]:
    """(order columns, ``_e`` = value minus its mean) of the rows with a value, and their number."""
    data = df.select(*set(ob + [col])).dropna(subset=[col])
    r = data.agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("m")).first()
    return data.select(*ob, (F.col(col).cast("double") - F.lit(float(r["m"] or 0.0))).alias("_e")), r["n"]


def pacf_from_acf(rho: list[float]) -> list[float]:
    """Durbin-Levinson recursion on the (short) ACF vector."""
    L = len(rho) - 1
    phi = np.zeros((L + 1, L + 1))
    out = [1.0]
    if L == 0:
        return out
    phi[1, 1] = rho[1]
    out.append(rho[1])
    for k in range(2, L + 1):
        num = rho[k] - sum(phi[k - 1, j] * rho[k - j] for j in range(1, k))
        den = 1 - sum(phi[k - 1, j] * rho[j] for j in range(1, k))
        phi[k, k] = num / den
        for j in range(1, k):
            phi[k, j] = phi[k - 1, j] - phi[k, k] * phi[k - 1, k - j]
        out.append(phi[k, k])
    return out


def acf_table(spark, df: DataFrame, col: str, order_by, lags: int = 10) -> DataFrame:
    """V8 data: lag, acf, pacf, +-1.96/sqrt(n) band."""
    rho, n = acf(df, col, order_by, lags, return_n=True)
    pac = pacf_from_acf(rho)
    band = 1.96 / math.sqrt(n)
    rows = [(k, sig(rho[k]), sig(pac[k]), sig(band)) for k in range(lags + 1)]
    return spark.createDataFrame(rows, "lag int, acf double, pacf double, band double")


# ----------------------------------------------------------------- M2
def adf(df: DataFrame, col: str, order_by, lags: int = 0, trend: str = "c") -> dict:
    """ADF regression dy_t = a + g y_{t-1} + sum d_i dy_{t-i}; returns the t of g."""
    ob = _ob(order_by)
    data = df.select(*set(ob + [col])).dropna(subset=[col])
    lagged = GlobalOrder(data, ob).with_lags([col], lags + 1)
    y = F.col(col).cast("double")
    cols = {"_dy": y - F.col(f"{col}_lag1"), "_ylag": F.col(f"{col}_lag1")}
    for i in range(1, lags + 1):
        cols[f"_dy{i}"] = F.col(f"{col}_lag{i}") - F.col(f"{col}_lag{i + 1}")
    if trend == "ct":
        cols["_t"] = F.col("_idx").cast("double")
    d = lagged.select(*[e.alias(k) for k, e in cols.items()], "_tie").dropna()
    feats = [k for k in cols if k != "_dy"]
    mom = gram(d, feats + ["_dy", "_tie"])
    check_unique(int(round(mom.s[-1])), ob)
    beta, bread, ssr, _ = solve_moments(mom, "_dy", feats)
    s2 = ssr / (mom.n - len(beta))
    se = math.sqrt(bread[1, 1] * s2)
    return {"adf_stat": beta[1] / se, "gamma": beta[1], "se": se, "n_obs": mom.n, "lags": lags}


def kpss(df: DataFrame, col: str, order_by, lags: int | None = None) -> dict:
    """KPSS level stationarity: partial sums of demeaned x over the global order,
    Bartlett long-run variance from block-wise FFT autocovariances (any number of lags)."""
    ob = _ob(order_by)
    e, n = _centred(df, col, ob)
    if lags is None:
        lags = int(math.ceil(12 * (n / 100) ** 0.25))
    cum = GlobalOrder(e, ob).with_running_sums(["_e"])
    sr = cum.agg(F.sum(F.col("_e_cum") ** 2).alias("s"), F.sum("_tie").alias("t")).first()
    check_unique(sr["t"], ob)
    lrv = weighted_products(cum, ["_e"], bartlett(lags))[0, 0] / n
    return {"kpss_stat": sr["s"] / (n * n * lrv), "lags": lags, "n_obs": n}


# ----------------------------------------------------------------- M8
def cusum(df: DataFrame, col: str, order_by) -> dict:
    """Max |prefix sum of demeaned x| / (sigma sqrt n); Brownian-bridge p-value."""
    ob = _ob(order_by)
    data = df.select(*set(ob + [col])).dropna(subset=[col])
    r = data.agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).collect()[0]
    e = data.withColumn("_e", F.col(col).cast("double") - F.lit(r["m"]))
    cum = GlobalOrder(e, ob).with_running_sums(["_e"])
    top = cum.agg(F.max(F.abs("_e_cum")).alias("mx"), F.max_by("_idx", F.abs("_e_cum")).alias("at"),
                  F.sum("_tie").alias("ties")).collect()[0]
    check_unique(top["ties"], ob)
    stat = top["mx"] / (r["s"] * math.sqrt(r["n"]))
    return {"cusum_stat": stat, "p_value": dist.kolmogorov_sf(stat), "break_index": top["at"], "n_obs": r["n"]}


# --------------------------------------------------------- M4, M5
def _lagged_series(df, col_list, series, order_by, p):
    series = [series] if isinstance(series, str) else list(series or [])
    out = series_lags(df, series, order_by, col_list, p)
    for c in col_list:
        for lag in range(1, p + 1):
            out = out.withColumnRenamed(f"{c}_lag{lag}", f"{c}_l{lag}")
    return out, series


def ar_by_series(df: DataFrame, col: str, series, order_by, p: int = 1) -> DataFrame:
    """AR(p) with constant for many series: per-series lags, grouped GRAM, solve per segment."""
    lagged, series = _lagged_series(df, [col], series, order_by, p)
    feats = [f"{col}_l{i}" for i in range(1, p + 1)]
    d = lagged.select(*series, col, *feats).dropna()
    g = grouped_gram(d, series, feats + [col])
    names = feats + [col]
    key_fields = [df.schema[c] for c in series]
    schema = T.StructType(key_fields + [T.StructField("term", T.StringType()),
                                        T.StructField("coefficient", T.DoubleType()),
                                        T.StructField("se", T.DoubleType()), T.StructField("n_obs", T.LongType())])

    def solve(it):
        for pdf in it:
            out = []
            for _, row in pdf.iterrows():
                mom = moments_from_row(row.to_dict(), names)
                keys = [row[c] for c in series]
                try:
                    beta, bread, ssr, _ = solve_moments(mom, col, feats)
                    s2 = ssr / max(mom.n - len(beta), 1)
                    se = np.sqrt(np.clip(np.diag(bread) * s2, 0, None))
                except Exception:  # noqa: BLE001
                    beta = [None] * (p + 1)
                    se = [None] * (p + 1)
                for t, b, s in zip([CONST] + feats, beta, se):
                    out.append(keys + [t, sig(b) if b is not None else None,
                                       sig(s) if s is not None else None, mom.n])
            yield pd.DataFrame(out, columns=series + ["term", "coefficient", "se", "n_obs"])

    return g.mapInPandas(solve, schema)


def var_fit(df: DataFrame, cols: list[str], order_by, p: int = 1) -> dict:
    """VAR(p): one multi-target GRAM over all lags; equation-wise OLS from it."""
    ob = _ob(order_by)
    data = df.select(*set(ob + cols)).dropna(subset=cols)
    lagged = GlobalOrder(data, ob).with_lags(cols, p)
    feats = [f"{c}_lag{lag}" for lag in range(1, p + 1) for c in cols]
    d = lagged.select(*cols, *feats, "_tie").dropna()
    mom = gram(d, feats + cols + ["_tie"])
    check_unique(int(round(mom.s[-1])), ob)
    coefs, ssr = {}, {}
    for c in cols:
        beta, bread, s, _ = solve_moments(mom, c, feats)
        coefs[c] = beta
        ssr[c] = s
    return {"coefs": coefs, "ssr": ssr, "moments": mom, "features": feats, "n_obs": mom.n}


def granger(df: DataFrame, y: str, x: str, order_by, p: int = 1) -> dict:
    """Does x Granger-cause y: F test of x's lags, restricted and full fit from one GRAM."""
    v = var_fit(df, [y, x], order_by, p)
    mom = v["moments"]
    full = v["features"]
    restricted = [f"{y}_lag{lag}" for lag in range(1, p + 1)]
    _, _, ssr_u, _ = solve_moments(mom, y, full)
    _, _, ssr_r, _ = solve_moments(mom, y, restricted)
    dfd = mom.n - len(full) - 1
    f = ((ssr_r - ssr_u) / p) / (ssr_u / dfd)
    return {"f_stat": f, "p_value": dist.f_sf(f, p, dfd), "df_num": p, "df_den": dfd}


def impulse_response(v: dict, cols: list[str], p: int, horizon: int = 10) -> np.ndarray:
    """IRF of a VAR on k x k matrices (unit shocks, non-orthogonalised)."""
    k = len(cols)
    A = []
    for lag in range(1, p + 1):
        m = np.zeros((k, k))
        for i, c in enumerate(cols):
            beta = v["coefs"][c]
            for j, c2 in enumerate(cols):
                m[i, j] = beta[1 + v["features"].index(f"{c2}_lag{lag}")]
        A.append(m)
    psi = [np.eye(k)]
    for h in range(1, horizon + 1):
        psi.append(sum(A[j] @ psi[h - j - 1] for j in range(min(p, h))))
    return np.array(psi)


def engle_granger(df: DataFrame, y: str, x: str, order_by) -> dict:
    """M6: cointegrating OLS, ADF on its residual, then the ECM regression."""
    from .linear import ols
    ob = _ob(order_by)
    data = df.select(*set(ob + [y, x])).dropna()
    step1 = ols(data, y, [x])
    res = data.withColumn("_u", step1.residual())
    a = adf(res, "_u", ob, 0)
    lagged = GlobalOrder(res, ob).with_lags([y, x, "_u"], 1)
    d = lagged.select((F.col(y) - F.col(f"{y}_lag1")).alias("_dy"), (F.col(x) - F.col(f"{x}_lag1")).alias("_dx"),
                      F.col("_u_lag1").alias("_ec"), "_tie").dropna()
    mom = gram(d, ["_dx", "_ec", "_dy", "_tie"])
    check_unique(int(round(mom.s[-1])), ob)
    beta, bread, ssr, _ = solve_moments(mom, "_dy", ["_dx", "_ec"])
    s2 = ssr / (mom.n - 3)
    return {"long_run_beta": step1.beta[1], "adf_resid": a["adf_stat"], "ecm_short_run": beta[1],
            "ecm_adjustment": beta[2], "ecm_adjustment_se": math.sqrt(bread[2, 2] * s2)}


# ----------------------------------------------------------------- M7
def series_features(df: DataFrame, series, ts, x: str) -> DataFrame:
    """Per-series count, mean, sd, trend slope, lag-1 autocorrelation and local peaks.

    Lags come from the series-led global order (a hot series is split across tasks);
    the trend uses the global position, which is consecutive inside a series, so the
    slope equals the one on 1..n. A peak at position j is counted at j + 1 from lags 1, 2.
    """
    series = [series] if isinstance(series, str) else list(series)
    tcols = _ob(ts)
    d = df.select(*series, *tcols, F.col(x).cast("double").alias("_x"))
    lagged = series_lags(d, series, tcols, ["_x"], 2)
    peak = (F.col("_x_lag1") > F.col("_x_lag2")) & (F.col("_x_lag1") > F.col("_x"))
    return lagged.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"),
        F.regr_slope("_x", F.col("_idx").cast("double")).alias("trend"), F.corr("_x", "_x_lag1").alias("acf1"),
        F.sum(F.when(peak, 1).otherwise(0)).alias("peaks"))


# ----------------------------------------------------------------- M4
def arima_hr(df: DataFrame, col: str, series, order_by, p: int = 1, d: int = 0, q: int = 1,
             long_ar: int = 8, horizon: int = 5) -> tuple[DataFrame, DataFrame]:
    """ARIMA(p, d, q) for many series by Hannan-Rissanen and an h-step forecast.

    1. difference d times per series (series-led global order, no single-task series);
    2. long AR(m) per series by grouped GRAM -> residuals as a column;
    3. regress y on p lags of y and q lags of the residuals (grouped GRAM) -> ARMA terms;
    4. forecast: the last max(p, q) values and residuals of each series (a bounded tail)
       are recursed on in ``applyInPandas`` per series.
    Returns (coefficients, forecasts)."""
    series = [series] if isinstance(series, str) else list(series)
    ob = _ob(order_by)
    x = df.select(*series, *ob, F.col(col).cast("double").alias("_x0")).dropna()
    cur = "_x0"
    for k in range(d):
        lagged = series_lags(x, series, ob, [cur], 1)
        x = lagged.withColumn(f"_x{k + 1}", F.col(cur) - F.col(f"{cur}_lag1")).drop(f"{cur}_lag1", "_b", "_idx").dropna()
        cur = f"_x{k + 1}"
    y = cur
    # step 2: long AR
    la = series_lags(x, series, ob, [y], long_ar).drop("_b", "_idx")
    lfe = [f"{y}_lag{i}" for i in range(1, long_ar + 1)]
    coefs_long = _grouped_solve(la.dropna(subset=lfe), series, y, lfe)
    la = la.join(coefs_long, series, "left")
    pred = F.col("_b0")
    for i, c in enumerate(lfe):
        pred = pred + F.col(f"_b{i + 1}") * F.col(c)
    la = la.withColumn("_e", F.col(y) - pred).drop(*[c for c in la.columns if c.startswith("_b") and c[2:].isdigit()])
    # step 3: ARMA regression
    levels = [f"_x{k}" for k in range(d)]
    keep = la.select(*series, *ob, y, "_e", *levels)
    lagged = series_lags(keep, series, ob, [y, "_e"], max(p, q, 1)).drop("_b", "_idx")
    feats = [f"{y}_lag{i}" for i in range(1, p + 1)] + [f"_e_lag{i}" for i in range(1, q + 1)]
    arma = _grouped_solve(lagged.dropna(subset=feats + [y]), series, y, feats)
    terms = ["const"] + [f"ar{i}" for i in range(1, p + 1)] + [f"ma{i}" for i in range(1, q + 1)]
    coef_long = arma.select(*series, F.posexplode(F.array(*[F.col(f"_b{i}") for i in range(len(terms))])).alias("pos", "coefficient"))
    names = F.array(*[F.lit(t) for t in terms])
    coef_table = coef_long.select(*series, F.element_at(names, F.col("pos") + 1).alias("term"), "coefficient")
    # step 4: tail of each series (last L rows by a descending row number inside the series order)
    L = max(p, q, 1)
    tail = _series_tail(keep, series, ob, [y, "_e", *levels], L).join(arma, series)
    key_schema = [df.schema[c] for c in series]
    out_schema = T.StructType(key_schema + [T.StructField("step", T.IntegerType()),
                                            T.StructField("forecast", T.DoubleType())])

    def fc(pdf):
        pdf = pdf.sort_values("_pos")
        hist_y = list(pdf[y].astype(float))
        hist_e = list(pdf["_e"].astype(float))
        b = [float(pdf[f"_b{i}"].iloc[0]) for i in range(len(terms))]
        last = [float(pdf[c].iloc[-1]) for c in levels]  # last value of the series and of each difference
        out = []
        for h in range(1, horizon + 1):
            v = b[0] + sum(b[i] * hist_y[-i] for i in range(1, p + 1) if i <= len(hist_y)) \
                + sum(b[p + j] * hist_e[-j] for j in range(1, q + 1) if j <= len(hist_e))
            hist_y.append(v)
            hist_e.append(0.0)
            for k in reversed(range(d)):  # summed back to the level of the input
                last[k] = v = last[k] + v
            out.append([pdf[c].iloc[0] for c in series] + [h, v])
        return pd.DataFrame(out, columns=series + ["step", "forecast"])

    forecasts = tail.groupBy(*series).applyInPandas(fc, out_schema)
    return coef_table, forecasts


def _grouped_solve(d: DataFrame, series: list[str], y: str, feats: list[str]) -> DataFrame:
    """Per-series OLS from grouped GRAM rows; returns series keys + _b0.._bk (null if singular)."""
    names = feats + [y]
    g = grouped_gram(d, series, names)
    k = len(feats) + 1
    schema = T.StructType([d.schema[c] for c in series] + [T.StructField(f"_b{i}", T.DoubleType()) for i in range(k)])

    def solve(it):
        for pdf in it:
            rows = []
            for _, row in pdf.iterrows():
                mom = moments_from_row(row.to_dict(), names)
                try:
                    beta, _, _, _ = solve_moments(mom, y, feats)
                    vals = [float(v) for v in beta]
                except Exception:  # noqa: BLE001 - short or constant series
                    vals = [None] * k
                rows.append([row[c] for c in series] + vals)
            yield pd.DataFrame(rows, columns=series + [f"_b{i}" for i in range(k)])

    return g.mapInPandas(solve, schema)


def _series_tail(d: DataFrame, series: list[str], ob: list[str], cols: list[str], L: int) -> DataFrame:
    """Last L rows of every series: a per-series max over the order (bounded output);
    rows are selected by comparing with the L-th largest order key found by L rounds of max."""
    keyed = d.withColumn("_ok", F.struct(*[F.col(c) for c in ob]))
    thresh = keyed.groupBy(*series).agg(F.max("_ok").alias("_t"))
    for _ in range(L - 1):  # a series of fewer than L rows keeps its smallest key
        nxt = keyed.join(thresh, series).where(F.col("_ok") < F.col("_t")).groupBy(*series).agg(F.max("_ok").alias("_t2"))
        thresh = thresh.join(nxt, series, "left").select(*series, F.coalesce("_t2", "_t").alias("_t"))
    tail = keyed.join(thresh, series).where(F.col("_ok") >= F.col("_t"))
    w = Window.partitionBy(*series).orderBy("_ok")  # at most L rows per series
    return tail.withColumn("_pos", F.row_number().over(w)).select(*series, "_pos", *cols)
