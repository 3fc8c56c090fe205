"""Registered queries over the driver tables and their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame computed on the
whole tables. Oracles are SQL over the same tables; statistics are compared
after significant-digit rounding written identically in both engines
(:func:`statframe.functions.columns.sig_col` / ``sig_sql``). p-values of t /
F tests are not in the compared columns: DuckDB has no t or F distribution.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import sig, sig_col
from .functions.columns import sig_sql as S
from .operators import diagnostics as diag
from .operators.diagnostics import TEST_SCHEMA
from .functions import dist
from .operators import discrete as disc
from .operators import evaluate as ev
from .operators import features as feat
from .operators import interpret as interp
from .operators import score
from .operators.discrete import glm, grouped_logit, logit, mnlogit, ordered, poisson, probability
from .operators.interpret import effects_frame
from .operators import causal
from .operators import report as rep
from .operators import trees
from .operators import treeshap
from .sources import profile as prof
from .sources import registry as reg
from .operators import monitor as mon
from .operators import panel
from .operators import series
from .operators import linear as lin
from .operators.linear import ols, segmented_ols
from .operators.zeroinfl import zero_inflated
from .session import local_table
from .sources.scan import load
from .streaming import stream

Q: dict = {}
O: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = sql
        return fn
    return deco


# lineitem has repeated (l_orderkey, l_linenumber) pairs; LI_KEY identifies rows in outputs and
# LI_ORDER is a unique order key at every driver scale (checked at sf0.001, 0.01, 0.1)
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_ORDER = LI_KEY + ["l_shipdate", "l_extendedprice"]


def _li(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem")


# ---------------------------------------------------------------- SQL kit
def ols1_cte(src: str, y: str, x: str, name: str = "s") -> str:
    """CTE with the sufficient statistics of a one-feature OLS fit."""
    return (f"{name} AS (SELECT CAST(regr_count({y}, {x}) AS DOUBLE) AS n, regr_slope({y}, {x}) AS b1, "
            f"regr_intercept({y}, {x}) AS b0, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, "
            f"regr_sxy({y}, {x}) AS sxy, regr_avgx({y}, {x}) AS xbar, regr_avgy({y}, {x}) AS ybar "
            f"FROM {src})")


# ------------------------------------------------------------- R1, R5, R10
@register("ols_coefficients", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(s2 * (1.0 / n + xbar * xbar / sxx))')} AS se,
       {S('b0 / sqrt(s2 * (1.0 / n + xbar * xbar / sxx))')} AS t_stat FROM f
UNION ALL
SELECT 'l_quantity', {S('b1')}, {S('sqrt(s2 / sxx)')}, {S('b1 / sqrt(s2 / sxx)')} FROM f
""")
def q_ols_coefficients(spark, sf):
    fit = ols(_li(spark, sf), "l_extendedprice", ["l_quantity"])
    return fit.coefficients(spark).select("term", "coefficient", "se", "t_stat")


def ols2_cte(src: str, y: str, x1: str, x2: str, p: str = "t") -> str:
    """CTEs {p}_f with b0, b1, b2, ssr, syy, det, s11, s22, s12, m1, m2, n for a 2-feature OLS."""
    return (f"{p}_m AS (SELECT count(*) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, "
            f"var_pop({x1}) * count(*) AS s11, var_pop({x2}) * count(*) AS s22, covar_pop({x1}, {x2}) * count(*) AS s12, "
            f"covar_pop({x1}, {y}) * count(*) AS s1y, covar_pop({x2}, {y}) * count(*) AS s2y, "
            f"var_pop({y}) * count(*) AS syy FROM {src}), "
            f"{p}_d AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM {p}_m), "
            f"{p}_b AS (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2 FROM {p}_d), "
            f"{p}_f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, syy - b1 * s1y - b2 * s2y AS ssr FROM {p}_b)")


def norm_sf_sql(z: str) -> str:
    """P(Z > z) in SQL with the same rational approximation as the Spark column."""
    from .functions.columns import _HART_DEN, _HART_NUM
    a = f"abs({z})"

    def horner(cs):
        acc = repr(cs[0])
        for c in cs[1:]:
            acc = f"({acc}) * {a} + {c!r}"
        return acc
    e = f"exp(-{a} * {a} / 2.0)"
    near = f"{e} * ({horner(_HART_NUM)}) / ({horner(_HART_DEN)})"
    cf = f"({a} + 0.65)"
    for k in ("4.0", "3.0", "2.0", "1.0"):
        cf = f"({a} + {k} / {cf})"
    far = f"{e} / {cf} / 2.506628274631"
    tail = f"(CASE WHEN {a} > 37.0 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN ({z}) > 0 THEN {tail} ELSE 1.0 - {tail} END)"


def chi2_even_sf_sql(x: str, df: int) -> str:
    """Survival of chi2 with even df 2m: exp(-x/2) sum_{k<m} (x/2)^k / k!."""
    m = df // 2
    terms = " + ".join(f"pow(({x}) / 2.0, {k}) / {math.factorial(k)}.0" for k in range(m))
    return f"(exp(-({x}) / 2.0) * ({terms}))"


def flag_sql(p: str) -> str:
    return f"(CASE WHEN ({p}) >= 0.05 THEN 'PASS' WHEN ({p}) >= 0.025 THEN 'WARN' ELSE 'FAIL' END)"


def kolmogorov_sql(lam: str) -> str:
    return (f"(SELECT greatest(0.0, least(1.0, 2.0 * sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END "
            f"* exp(-2.0 * j * j * ({lam}) * ({lam}))))) FROM range(1, 101) r(j))")


def metrics_df(spark, pairs, name="metric") -> DataFrame:
    return spark.createDataFrame([(k, sig(float(v))) for k, v in pairs], f"{name} string, value double")


def tests_df(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, TEST_SCHEMA)


# ------------------------------------------------------------- R10, E1
@register("ols_fit_stats", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
f AS (SELECT *, syy - b1 * sxy AS ssr FROM s),
g AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1) AS llf, 1 - ssr / syy AS r2 FROM f)
SELECT * FROM (VALUES ('r_squared', 0), ('adj_r_squared', 1), ('f_stat', 2), ('aic', 3), ('bic', 4),
  ('log_likelihood', 5), ('n_obs', 6), ('n_features', 7), ('rmse', 8)) m(metric, i)
  JOIN (SELECT {S('r2')} AS v0, {S('1 - (1 - r2) * (n - 1) / (n - 2)')} AS v1,
        {S('r2 / ((1 - r2) / (n - 2))')} AS v2, {S('-2 * llf + 4')} AS v3, {S('-2 * llf + 2 * ln(n)')} AS v4,
        {S('llf')} AS v5, {S('n')} AS v6, 2.0 AS v7, {S('sqrt(ssr / (n - 2))')} AS v8 FROM g) ON TRUE
""".replace("SELECT * FROM (VALUES", "SELECT metric, CASE i WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 WHEN 3 THEN v3 "
            "WHEN 4 THEN v4 WHEN 5 THEN v5 WHEN 6 THEN v6 WHEN 7 THEN v7 ELSE v8 END AS value FROM (VALUES"))
def q_ols_fit_stats(spark, sf):
    fit = ols(_li(spark, sf), "l_extendedprice", ["l_quantity"])
    keep = {"r_squared", "adj_r_squared", "f_stat", "aic", "bic", "log_likelihood", "n_obs", "n_features"}
    rows = [(m, v) for m, v in fit.stat_rows() if m in keep] + [("rmse", sig(math.sqrt(fit.sigma2)))]
    return spark.createDataFrame(rows, "metric string, value double")


# ------------------------------------------------------------------ R1
@register("ols_two_features", f"""
WITH {ols2_cte('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount')},
v AS (SELECT *, ssr / (n - 3) AS s2 FROM t_f),
w AS (SELECT *, s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det) AS v0,
      s2 * s22 / det AS v1, s2 * s11 / det AS v2 FROM v)
SELECT 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(v0)')} AS se, {S('b0 / sqrt(v0)')} AS t_stat FROM w
UNION ALL SELECT 'l_quantity', {S('b1')}, {S('sqrt(v1)')}, {S('b1 / sqrt(v1)')} FROM w
UNION ALL SELECT 'l_discount', {S('b2')}, {S('sqrt(v2)')}, {S('b2 / sqrt(v2)')} FROM w
""")
def q_ols_two_features(spark, sf):
    fit = ols(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"])
    return fit.coefficients(spark).select("term", "coefficient", "se", "t_stat")


# ------------------------------------------------------------------ R2
@register("wls_coefficients", f"""
WITH d AS (SELECT 1.0 / l_quantity AS w, l_discount AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity > 0),
s AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx_raw,
      sum(w * x * y) AS sxy_raw, sum(w * y * y) AS syy_raw FROM d),
c AS (SELECT *, sxx_raw - sx * sx / sw AS sxx, sxy_raw - sx * sy / sw AS sxy, syy_raw - sy * sy / sw AS syy,
      sx / sw AS xbar, sy / sw AS ybar FROM s),
f AS (SELECT *, sxy / sxx AS b1, ybar - sxy / sxx * xbar AS b0, (syy - sxy / sxx * sxy) / (n - 2) AS s2 FROM c)
SELECT 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(s2 * (1.0 / sw + xbar * xbar / sxx))')} AS se FROM f
UNION ALL SELECT 'l_discount', {S('b1')}, {S('sqrt(s2 / sxx)')} FROM f
""")
def q_wls_coefficients(spark, sf):
    d = _li(spark, sf).withColumn("w", F.lit(1.0) / F.col("l_quantity"))
    fit = ols(d, "l_extendedprice", ["l_discount"], weight="w")
    return fit.coefficients(spark).select("term", "coefficient", "se")


# --------------------------------------------------------------- R6, R7
def _hc_sql() -> str:
    parts = []
    for kind, f, corr in (("HC0", "e * e", "1.0"), ("HC1", "e * e", "n / (n - 2.0)"),
                          ("HC2", "e * e / (1 - h)", "1.0"), ("HC3", "e * e / ((1 - h) * (1 - h))", "1.0")):
        parts.append(f"""SELECT '{kind}' AS se_type, term, {S('sqrt(v)')} AS se FROM (
  SELECT 'const' AS term, {corr} * (B00 * B00 * M00 + 2 * B00 * B01 * M01 + B01 * B01 * M11) AS v FROM meat_{kind}
  UNION ALL SELECT 'l_quantity', {corr} * (B01 * B01 * M00 + 2 * B01 * B11 * M01 + B11 * B11 * M11) FROM meat_{kind})""")
        parts[-1] = parts[-1]
    meats = ",\n".join(
        f"meat_{kind} AS (SELECT any_value(n) AS n, any_value(B00) AS B00, any_value(B01) AS B01, any_value(B11) AS B11, "
        f"sum({f}) AS M00, sum({f} * x) AS M01, sum({f} * x * x) AS M11 FROM r)"
        for kind, f in (("HC0", "e * e"), ("HC1", "e * e"), ("HC2", "e * e / (1 - h)"),
                        ("HC3", "e * e / ((1 - h) * (1 - h))")))
    return f"""WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
b AS (SELECT *, 1.0 / n + xbar * xbar / sxx AS B00, -xbar / sxx AS B01, 1.0 / sxx AS B11 FROM s),
r AS (SELECT b.*, l_quantity AS x, l_extendedprice - (b0 + b1 * l_quantity) AS e,
      1.0 / n + (l_quantity - xbar) * (l_quantity - xbar) / sxx AS h FROM lineitem, b),
{meats}
""" + "\nUNION ALL\n".join(parts)


@register("ols_robust_se", _hc_sql())
def q_ols_robust_se(spark, sf):
    li = _li(spark, sf)
    out = None
    for kind in ("HC0", "HC1", "HC2", "HC3"):
        fit = ols(li, "l_extendedprice", ["l_quantity"], se_type=kind)
        d = spark.createDataFrame([(kind, t, sig(s)) for t, s in zip(fit.terms, fit.se)],
                                  "se_type string, term string, se double")
        out = d if out is None else out.unionByName(d)
    return out


# ------------------------------------------------------------------ R9
@register("ols_cluster_se", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
b AS (SELECT *, 1.0 / n + xbar * xbar / sxx AS B00, -xbar / sxx AS B01, 1.0 / sxx AS B11 FROM s),
u AS (SELECT l_suppkey, sum(l_extendedprice - (b0 + b1 * l_quantity)) AS u0,
      sum((l_extendedprice - (b0 + b1 * l_quantity)) * l_quantity) AS u1 FROM lineitem, b GROUP BY l_suppkey),
m AS (SELECT count(*) AS g, sum(u0 * u0) AS M00, sum(u0 * u1) AS M01, sum(u1 * u1) AS M11 FROM u),
c AS (SELECT *, g / (g - 1.0) * (n - 1.0) / (n - 2.0) AS corr FROM m, b)
SELECT 'const' AS term, {S('sqrt(corr * (B00 * B00 * M00 + 2 * B00 * B01 * M01 + B01 * B01 * M11))')} AS se FROM c
UNION ALL SELECT 'l_quantity', {S('sqrt(corr * (B01 * B01 * M00 + 2 * B01 * B11 * M01 + B11 * B11 * M11))')} FROM c
""")
def q_ols_cluster_se(spark, sf):
    fit = ols(_li(spark, sf), "l_extendedprice", ["l_quantity"], se_type="cluster", cluster="l_suppkey")
    return spark.createDataFrame([(t, sig(s)) for t, s in zip(fit.terms, fit.se)], "term string, se double")


# ------------------------------------------------------------------ R8
@register("ols_hac_se", f"""
WITH {ols1_cte('events', 'value', 'user_id')},
b AS (SELECT *, 1.0 / n + xbar * xbar / sxx AS B00, -xbar / sxx AS B01, 1.0 / sxx AS B11 FROM s),
r AS (SELECT (value - (b0 + b1 * user_id)) AS u0, (value - (b0 + b1 * user_id)) * user_id AS u1, ts, event_id
      FROM events, b),
l AS (SELECT u0, u1, lag(u0) OVER (ORDER BY ts, event_id) AS v0, lag(u1) OVER (ORDER BY ts, event_id) AS v1 FROM r),
g AS (SELECT sum(u0 * u0) + 0.5 * 2 * sum(u0 * v0) AS M00,
             sum(u0 * u1) + 0.5 * (sum(u0 * v1) + sum(u1 * v0)) AS M01,
             sum(u1 * u1) + 0.5 * 2 * sum(u1 * v1) AS M11 FROM l),
c AS (SELECT * FROM g, b)
SELECT 'const' AS term, {S('sqrt(B00 * B00 * M00 + 2 * B00 * B01 * M01 + B01 * B01 * M11)')} AS se FROM c
UNION ALL SELECT 'user_id', {S('sqrt(B01 * B01 * M00 + 2 * B01 * B11 * M01 + B11 * B11 * M11)')} FROM c
""")
def q_ols_hac_se(spark, sf):
    ev = load(spark, sf, "events")
    fit = ols(ev, "value", ["user_id"], se_type="hac", order_by=["ts", "event_id"], maxlags=1)
    return spark.createDataFrame([(t, sig(s)) for t, s in zip(fit.terms, fit.se)], "term string, se double")


# ------------------------------------------------------------------ R12
@register("segmented_ols", f"""
WITH s AS (SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS b1,
      regr_intercept(l_extendedprice, l_quantity) AS b0, regr_sxx(l_extendedprice, l_quantity) AS sxx,
      regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy,
      regr_avgx(l_extendedprice, l_quantity) AS xbar FROM lineitem GROUP BY l_returnflag),
f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT l_returnflag, 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(s2 * (1.0 / n + xbar * xbar / sxx))')} AS se,
       CAST(n AS BIGINT) AS n_obs FROM f
UNION ALL SELECT l_returnflag, 'l_quantity', {S('b1')}, {S('sqrt(s2 / sxx)')}, CAST(n AS BIGINT) FROM f
""")
def q_segmented_ols(spark, sf):
    return segmented_ols(_li(spark, sf), "l_extendedprice", ["l_quantity"], ["l_returnflag"]).select(
        "l_returnflag", "term", "coefficient", "se", "n_obs")


# ------------------------------------------------------------------ A1
@register("breusch_pagan", f"""
WITH {ols2_cte('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount')},
r AS (SELECT pow(l_extendedprice - (b0 + b1 * l_quantity + b2 * l_discount), 2) AS e2, l_quantity, l_discount
      FROM lineitem, t_f),
{ols2_cte('r', 'e2', 'l_quantity', 'l_discount', 'a')},
z AS (SELECT n * (1 - ssr / syy) AS lm FROM a_f)
SELECT 'breusch_pagan' AS test, {S('lm')} AS statistic, CAST(2.0 AS DOUBLE) AS df, {S(chi2_even_sf_sql('lm', 2))} AS p_value,
       {flag_sql(chi2_even_sf_sql('lm', 2))} AS flag FROM z
""")
def q_breusch_pagan(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity", "l_discount"])
    return tests_df(spark, [diag.breusch_pagan(li, fit)])


# ------------------------------------------------------------------ A2
@register("white_test", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
r AS (SELECT pow(l_extendedprice - (b0 + b1 * l_quantity), 2) AS e2, l_quantity AS x1, l_quantity * l_quantity AS x2
      FROM lineitem, s),
{ols2_cte('r', 'e2', 'x1', 'x2', 'a')},
z AS (SELECT n * (1 - ssr / syy) AS lm FROM a_f)
SELECT 'white' AS test, {S('lm')} AS statistic, CAST(2.0 AS DOUBLE) AS df, {S(chi2_even_sf_sql('lm', 2))} AS p_value,
       {flag_sql(chi2_even_sf_sql('lm', 2))} AS flag FROM z
""")
def q_white_test(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    return tests_df(spark, [diag.white(li, fit)])


# ------------------------------------------------------------------ A6
@register("jarque_bera", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
r AS (SELECT l_extendedprice - (b0 + b1 * l_quantity) AS e FROM lineitem, s),
m AS (SELECT count(*) AS n, avg(e) AS mu FROM r),
c AS (SELECT any_value(n) AS n, avg(pow(e - mu, 2)) AS c2, avg(pow(e - mu, 3)) AS c3, avg(pow(e - mu, 4)) AS c4 FROM r, m),
j AS (SELECT n / 6.0 * (pow(c3 / pow(c2, 1.5), 2) + pow(c4 / (c2 * c2) - 3, 2) / 4) AS jb FROM c)
SELECT 'jarque_bera' AS test, {S('jb')} AS statistic, CAST(2.0 AS DOUBLE) AS df, {S('exp(-jb / 2)')} AS p_value,
       {flag_sql('exp(-jb / 2)')} AS flag FROM j
""")
def q_jarque_bera(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    return tests_df(spark, [diag.jarque_bera(li, fit)])


# ------------------------------------------------------------------ A3
@register("durbin_watson", f"""
WITH {ols1_cte('events', 'value', 'user_id')},
r AS (SELECT value - (b0 + b1 * user_id) AS e, ts, event_id FROM events, s),
l AS (SELECT e, lag(e) OVER (ORDER BY ts, event_id) AS el FROM r),
d AS (SELECT sum(pow(e - el, 2)) / sum(e * e) AS dw FROM l)
SELECT 'durbin_watson' AS test, {S('dw')} AS statistic, CAST(NULL AS DOUBLE) AS df, CAST(NULL AS DOUBLE) AS p_value,
  CASE WHEN dw BETWEEN 1.5 AND 2.5 THEN 'PASS' WHEN (dw >= 1.0 AND dw < 1.5) OR (dw > 2.5 AND dw <= 3.0) THEN 'WARN'
  ELSE 'FAIL' END AS flag FROM d
""")
def q_durbin_watson(spark, sf):
    ev = load(spark, sf, "events")
    fit = ols(ev, "value", ["user_id"])
    return tests_df(spark, [diag.durbin_watson(ev, fit, ["ts", "event_id"])])


# ------------------------------------------------------------------ A4
@register("breusch_godfrey", f"""
WITH m AS (SELECT avg(value) AS mu FROM events),
r AS (SELECT value - mu AS e, ts, event_id FROM events, m),
l AS (SELECT e, coalesce(lag(e, 1) OVER (ORDER BY ts, event_id), 0.0) AS l1,
      coalesce(lag(e, 2) OVER (ORDER BY ts, event_id), 0.0) AS l2 FROM r),
{ols2_cte('l', 'e', 'l1', 'l2', 'a')},
z AS (SELECT n * (1 - ssr / syy) AS lm FROM a_f)
SELECT 'breusch_godfrey' AS test, {S('lm')} AS statistic, CAST(2.0 AS DOUBLE) AS df, {S(chi2_even_sf_sql('lm', 2))} AS p_value,
       {flag_sql(chi2_even_sf_sql('lm', 2))} AS flag FROM z
""")
def q_breusch_godfrey(spark, sf):
    ev = load(spark, sf, "events")
    fit = ols(ev, "value", [])
    return tests_df(spark, [diag.breusch_godfrey(ev, fit, ["ts", "event_id"], n_lags=2)])


# ------------------------------------------------------------------ A5
@register("vif", f"""
SELECT term, {S('1.0 / (1 - r * r)')} AS vif, CASE WHEN 1.0 / (1 - r * r) > 10 THEN 'FAIL'
  WHEN 1.0 / (1 - r * r) > 5 THEN 'WARN' ELSE 'PASS' END AS flag
FROM (SELECT corr(l_quantity, l_discount) AS r FROM lineitem), (VALUES ('l_quantity'), ('l_discount')) t(term)
""")
def q_vif(spark, sf):
    fit = ols(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame(diag.vif(fit), "term string, vif double, flag string")


# ------------------------------------------------------------------ A25
@register("correlation_screen", f"""
SELECT term, {S('r')} AS r, {S('r * r * (n - 2) / (1 - r * r)')} AS f_stat FROM (
  SELECT 'l_quantity' AS term, corr(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem
  UNION ALL SELECT 'l_discount', corr(l_extendedprice, l_discount), count(*) FROM lineitem
  UNION ALL SELECT 'l_tax', corr(l_extendedprice, l_tax), count(*) FROM lineitem)
""")
def q_correlation_screen(spark, sf):
    fit = ols(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(t, r, f) for t, r, f, _ in diag.correlation_screen(fit)],
                                 "term string, r double, f_stat double")


# =========================================================== discrete
Z975 = dist.norm_ppf(0.975)


def _binary_li(spark, sf) -> DataFrame:
    return _li(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice",
                                 (F.col("l_returnflag") == "R").cast("double").alias("is_r"),
                                 (F.col("l_linestatus") == "F").cast("double").alias("status_f"))


SAT_CELLS = """c AS (SELECT CAST(sum(CASE WHEN y = 1 AND x = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n10,
  CAST(sum(CASE WHEN y = 0 AND x = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n00,
  CAST(sum(CASE WHEN y = 1 AND x = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n11,
  CAST(sum(CASE WHEN y = 0 AND x = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n01
  FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS x
        FROM lineitem)),
f AS (SELECT *, ln(n10 / n00) AS b0, ln(n11 / n01) - ln(n10 / n00) AS b1, 1.0 / n10 + 1.0 / n00 AS v00,
      1.0 / n10 + 1.0 / n00 + 1.0 / n11 + 1.0 / n01 AS v11 FROM c)"""


def _coef_sql(rows: list[tuple[str, str, str]], src: str = "f") -> str:
    """term, coefficient, se, z_stat, p_value, ci_lower, ci_upper from (term, b, se) SQL expressions."""
    parts = []
    for term, b, se in rows:
        parts.append(f"SELECT '{term}' AS term, {S(b)} AS coefficient, {S(se)} AS se, {S(f'({b}) / ({se})')} AS z_stat, "
                     f"{S('2 * ' + norm_sf_sql(f'abs(({b}) / ({se}))'))} AS p_value, "
                     f"{S(f'({b}) - {Z975!r} * ({se})')} AS ci_lower, {S(f'({b}) + {Z975!r} * ({se})')} AS ci_upper FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("logit_saturated", f"WITH {SAT_CELLS}\n" + _coef_sql([("const", "b0", "sqrt(v00)"), ("status_f", "b1", "sqrt(v11)")]))
def q_logit_saturated(spark, sf):
    return logit(_binary_li(spark, sf), "is_r", ["status_f"]).coefficients(spark)


@register("logit_fit_stats", f"""WITH {SAT_CELLS},
l AS (SELECT *, n10 * ln(n10 / (n10 + n00)) + n00 * ln(n00 / (n10 + n00)) + n11 * ln(n11 / (n11 + n01))
      + n01 * ln(n01 / (n11 + n01)) AS llf,
      (n10 + n11) * ln((n10 + n11) / (n10 + n00 + n11 + n01)) + (n00 + n01) * ln((n00 + n01) / (n10 + n00 + n11 + n01)) AS lln,
      n10 + n00 + n11 + n01 AS n FROM f)
SELECT 'log_likelihood' AS metric, {S('llf')} AS value FROM l
UNION ALL SELECT 'll_null', {S('lln')} FROM l
UNION ALL SELECT 'aic', {S('-2 * llf + 4')} FROM l
UNION ALL SELECT 'bic', {S('-2 * llf + 2 * ln(n)')} FROM l
UNION ALL SELECT 'lr_stat', {S('2 * (llf - lln)')} FROM l
UNION ALL SELECT 'n_obs', {S('n')} FROM l
""")
def q_logit_fit_stats(spark, sf):
    fit = logit(_binary_li(spark, sf), "is_r", ["status_f"])
    keep = {"log_likelihood", "ll_null", "aic", "bic", "lr_stat", "n_obs"}
    return spark.createDataFrame([r for r in fit.stat_rows() if r[0] in keep], "metric string, value double")


@register("grouped_logit_counts", f"WITH {SAT_CELLS}\n" + _coef_sql([("const", "b0", "sqrt(v00)"), ("status_f", "b1", "sqrt(v11)")]))
def q_grouped_logit_counts(spark, sf):
    counts = feat.to_counts(_binary_li(spark, sf), "is_r", ["status_f"])
    return grouped_logit(counts, "successes", "trials", ["status_f"]).coefficients(spark)


@register("odds_ratios", f"""WITH {SAT_CELLS}
SELECT 'status_f' AS term, {S('exp(b1)')} AS ratio, {S(f'exp(b1 - {Z975!r} * sqrt(v11))')} AS ci_lower,
       {S(f'exp(b1 + {Z975!r} * sqrt(v11))')} AS ci_upper FROM f""")
def q_odds_ratios(spark, sf):
    return logit(_binary_li(spark, sf), "is_r", ["status_f"]).odds_ratios(spark)


def _effects_sql(kind: str) -> str:
    if kind == "ame":
        prof = """p AS (SELECT *, n11 / (n11 + n01) AS p1, n10 / (n10 + n00) AS p0, n10 + n00 + n11 + n01 AS n FROM f),
q AS (SELECT *, ((n10 + n00) * p0 * (1 - p0) + (n11 + n01) * p1 * (1 - p1)) / n AS mf,
      ((n10 + n00) * p0 * (1 - p0) * (1 - 2 * p0) + (n11 + n01) * p1 * (1 - p1) * (1 - 2 * p1)) / n AS g0,
      ((n11 + n01) * p1 * (1 - p1) * (1 - 2 * p1)) / n AS g1 FROM p)"""
    else:
        prof = """p AS (SELECT *, (n11 + n01) / (n10 + n00 + n11 + n01) AS xbar FROM f),
pp AS (SELECT *, 1.0 / (1.0 + exp(-(b0 + b1 * xbar))) AS pm FROM p),
q AS (SELECT *, pm * (1 - pm) AS mf, pm * (1 - pm) * (1 - 2 * pm) AS g0, pm * (1 - pm) * (1 - 2 * pm) * xbar AS g1 FROM pp)"""
    return f"""WITH {SAT_CELLS},
{prof},
j AS (SELECT *, b1 * mf AS eff, b1 * g0 AS j0, mf + b1 * g1 AS j1 FROM q),
v AS (SELECT *, sqrt(j0 * j0 * v00 - 2 * j0 * j1 * v00 + j1 * j1 * v11) AS se FROM j)
SELECT 'status_f' AS term, {S('eff')} AS effect, {S('se')} AS se, {S('eff / se')} AS z_stat FROM v"""


@register("logit_ame", _effects_sql("ame"))
def q_logit_ame(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["status_f"])
    return effects_frame(spark, interp.average_marginal_effects(d, fit)).select("term", "effect", "se", "z_stat")


@register("logit_mem", _effects_sql("mem"))
def q_logit_mem(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["status_f"])
    return effects_frame(spark, interp.effects_at(d, fit, "mean")).select("term", "effect", "se", "z_stat")


@register("logit_prediction_metrics", f"""WITH {SAT_CELLS},
r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y,
      CASE WHEN l_linestatus = 'F' THEN n11 / (n11 + n01) ELSE n10 / (n10 + n00) END AS p FROM lineitem, f),
m AS (SELECT count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, avg((p - y) * (p - y)) AS bs,
      avg(CASE WHEN (CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) = y THEN 1.0 ELSE 0.0 END) AS acc FROM r),
g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY p),
a AS (SELECT sum(pos * (cn - 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM
      (SELECT *, sum(neg) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS cn FROM g))
SELECT 'log_loss' AS metric, {S('ll')} AS value FROM m UNION ALL SELECT 'brier', {S('bs')} FROM m
UNION ALL SELECT 'accuracy', {S('acc')} FROM m UNION ALL SELECT 'auc', {S('auc')} FROM a
UNION ALL SELECT 'n', {S('n')} FROM m""")
def q_logit_prediction_metrics(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["status_f"])
    scored = d.withColumn("p", probability(fit))
    m = ev.probability_metrics(scored, "is_r", "p")
    m["auc"] = ev.auc(scored, "is_r", "p")
    return metrics_df(spark, [(k, m[k]) for k in ("log_loss", "brier", "accuracy", "auc", "n")])


@register("predict_logit", f"""WITH {SAT_CELLS}
SELECT l_orderkey, l_linenumber, {S("1.0 / (1.0 + exp(-(b0 + b1 * CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END)))")}
  AS prediction FROM lineitem, f""")
def q_predict_logit(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["status_f"])
    out = score.predict_discrete(fit, d, keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", sig_col("prediction").alias("prediction"))


@register("quasi_binomial_scale", f"""WITH {SAT_CELLS},
r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y,
      CASE WHEN l_linestatus = 'F' THEN n11 / (n11 + n01) ELSE n10 / (n10 + n00) END AS p FROM lineitem, f)
SELECT 'pearson_scale' AS metric, {S('sum((y - p) * (y - p) / (p * (1 - p))) / (count(*) - 2)')} AS value FROM r""")
def q_quasi_binomial_scale(spark, sf):
    fit = glm(_binary_li(spark, sf), "is_r", ["status_f"], "binomial", "logit", scale="pearson")
    return metrics_df(spark, [("pearson_scale", fit.scale)])


@register("prior_corrected_logit", f"""WITH {SAT_CELLS},
s AS (SELECT *, (n10 + n11) / (n10 + n00 + n11 + n01) AS share FROM f)
SELECT 'const' AS term, {S('b0 - ln((share / (1 - share)) * ((1 - 0.05) / 0.05))')} AS coefficient FROM s
UNION ALL SELECT 'status_f', {S('b1')} FROM s""")
def q_prior_corrected_logit(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["status_f"])
    share = d.agg(F.avg("is_r")).collect()[0][0]
    pc = disc.prior_correct(fit, share, 0.05)
    return spark.createDataFrame([(t, sig(b)) for t, b in zip(pc.terms, pc.theta)], "term string, coefficient double")


@register("poisson_saturated", f"""
WITH d AS (SELECT CAST(count(*) AS DOUBLE) AS y, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS x
           FROM events GROUP BY user_id, event_type),
c AS (SELECT sum(CASE WHEN x = 0 THEN y END) AS s0, sum(CASE WHEN x = 1 THEN y END) AS s1,
      CAST(sum(1 - x) AS DOUBLE) AS m0, CAST(sum(x) AS DOUBLE) AS m1 FROM d),
f AS (SELECT *, ln(s0 / m0) AS b0, ln((s1 / m1) / (s0 / m0)) AS b1, 1.0 / s0 AS v0, 1.0 / s1 + 1.0 / s0 AS v1 FROM c)
""" + _coef_sql([("const", "b0", "sqrt(v0)"), ("is_click", "b1", "sqrt(v1)")]))
def q_poisson_saturated(spark, sf):
    evs = load(spark, sf, "events")
    d = evs.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n_events")).withColumn(
        "is_click", (F.col("event_type") == "click").cast("double"))
    return poisson(d, "n_events", ["is_click"]).coefficients(spark)


@register("gamma_saturated", f"""
WITH d AS (SELECT l_extendedprice AS y, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS x FROM lineitem),
m AS (SELECT avg(CASE WHEN x = 0 THEN y END) AS mu0, avg(CASE WHEN x = 1 THEN y END) AS mu1,
      CAST(sum(1 - x) AS DOUBLE) AS n0, CAST(sum(x) AS DOUBLE) AS n1 FROM d),
p AS (SELECT sum(pow((y - CASE WHEN x = 1 THEN mu1 ELSE mu0 END) / CASE WHEN x = 1 THEN mu1 ELSE mu0 END, 2))
      / (count(*) - 2) AS phi FROM d, m),
f AS (SELECT *, ln(mu0) AS b0, ln(mu1 / mu0) AS b1, phi / n0 AS v0, phi * (1.0 / n0 + 1.0 / n1) AS v1 FROM m, p)
SELECT 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(v0)')} AS se FROM f
UNION ALL SELECT 'status_f', {S('b1')}, {S('sqrt(v1)')} FROM f""")
def q_gamma_saturated(spark, sf):
    fit = glm(_binary_li(spark, sf), "l_extendedprice", ["status_f"], "gamma", "log")
    return fit.coefficients(spark).select("term", "coefficient", "se")


@register("gamma_inverse_link", f"""
WITH d AS (SELECT l_extendedprice AS y, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS x FROM lineitem),
m AS (SELECT avg(CASE WHEN x = 0 THEN y END) AS mu0, avg(CASE WHEN x = 1 THEN y END) AS mu1,
      CAST(sum(1 - x) AS DOUBLE) AS n0, CAST(sum(x) AS DOUBLE) AS n1 FROM d)
SELECT CAST(0.0 AS DOUBLE) AS status_f, CAST(n0 AS BIGINT) AS n, {S('mu0')} AS mean_score FROM m
UNION ALL SELECT 1.0, CAST(n1 AS BIGINT), {S('mu1')} FROM m""")
def q_gamma_inverse_link(spark, sf):
    """A gamma fit with the inverse link scored through that link (cell means)."""
    d = _binary_li(spark, sf)
    fit = glm(d, "l_extendedprice", ["status_f"], "gamma", "inverse")
    return d.groupBy("status_f").agg(F.count(F.lit(1)).alias("n"), sig_col(F.avg(probability(fit))).alias("mean_score"))


def _target_cells(target: str, weight: str = "1.0") -> str:
    w = f"CAST({weight} AS DOUBLE)"
    return SAT_CELLS.replace("THEN 1 ELSE 0 END) AS DOUBLE)", "THEN w ELSE 0 END) AS DOUBLE)").replace(
        "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", f"SELECT {w} AS w, CASE WHEN l_returnflag = '{target}' THEN 1 ELSE 0 END AS y")


@register("logit_text_target", "WITH " + _target_cells('N').replace("l_linestatus = 'F'", "l_quantity <= 25") + "\n" + _coef_sql(
    [("const", "b0", "sqrt(v00)"), ("is_cheap", "b1", "sqrt(v11)")]))
def q_logit_text_target(spark, sf):
    """A text target of three labels; the second sorted one is coded 1."""
    d = _li(spark, sf).withColumn("is_cheap", (F.col("l_quantity") <= 25).cast("double"))
    return logit(d, "l_returnflag", ["is_cheap"]).coefficients(spark)


@register("logit_weighted", f"WITH {_target_cells('R', 'l_quantity')}\n" + _coef_sql([("const", "b0", "sqrt(v00)"), ("status_f", "b1", "sqrt(v11)")]))
def q_logit_weighted(spark, sf):
    """Sample weights in the binary fit."""
    return logit(_binary_li(spark, sf), "is_r", ["status_f"], weight="l_quantity").coefficients(spark)


@register("registry_scored_logit", f"""WITH {SAT_CELLS}
SELECT CAST(0.0 AS DOUBLE) AS status_f, CAST(n10 + n00 AS BIGINT) AS n, {S('n10 / (n10 + n00)')} AS mean_probability FROM f
UNION ALL SELECT 1.0, CAST(n11 + n01 AS BIGINT), {S('n11 / (n11 + n01)')} FROM f""")
def q_registry_scored_logit(spark, sf):
    """A registered logit, loaded and scored to probabilities."""
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["status_f"])
    fp = reg.dataset_fingerprint(d, ["is_r", "status_f"])
    path = stream.scratch(spark, "registry-logit")
    mid = reg.save_model(spark, fit, reg.make_model_id("returned", "logit", fp["hash"]), fp, path=path)
    score = reg.score_expression(reg.load_model(spark, mid, path))
    return d.groupBy("status_f").agg(F.count(F.lit(1)).alias("n"), sig_col(F.avg(score)).alias("mean_probability"))


@register("ordered_logit_null", f"""
WITH c AS (SELECT o_orderpriority AS lvl, CAST(count(*) AS DOUBLE) AS k FROM orders GROUP BY 1),
q AS (SELECT lvl, sum(k) OVER (ORDER BY lvl ROWS UNBOUNDED PRECEDING) / sum(k) OVER () AS fc,
      lead(lvl) OVER (ORDER BY lvl) AS nxt, sum(k) OVER () AS n FROM c)
SELECT 'cut_' || lvl || '|' || nxt AS term, {S('ln(fc / (1 - fc))')} AS coefficient, {S('1.0 / sqrt(n * fc * (1 - fc))')} AS se
FROM q WHERE nxt IS NOT NULL""")
def q_ordered_logit_null(spark, sf):
    fit = ordered(load(spark, sf, "orders"), "o_orderpriority", [], "logit")
    return fit.coefficients(spark).select("term", "coefficient", "se")


def _mn_sql() -> str:
    return f"""
WITH d AS (SELECT c_mktsegment AS y, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS x FROM customer),
c AS (SELECT y, CAST(sum(1 - x) AS DOUBLE) AS c0, CAST(sum(x) AS DOUBLE) AS c1 FROM d GROUP BY y),
b AS (SELECT c0 AS b0n, c1 AS b1n FROM c ORDER BY y LIMIT 1),
f AS (SELECT y, ln(c0 / b0n) AS a0, ln(c1 / b1n) - ln(c0 / b0n) AS a1, 1.0 / c0 + 1.0 / b0n AS v0,
      1.0 / c0 + 1.0 / b0n + 1.0 / c1 + 1.0 / b1n AS v1 FROM c, b WHERE y > (SELECT min(y) FROM c))
SELECT y || ':const' AS term, {S('a0')} AS coefficient, {S('sqrt(v0)')} AS se FROM f
UNION ALL SELECT y || ':pos_balance', {S('a1')}, {S('sqrt(v1)')} FROM f"""


@register("mnlogit_saturated", _mn_sql())
def q_mnlogit_saturated(spark, sf):
    d = load(spark, sf, "customer").withColumn("pos_balance", (F.col("c_acctbal") > 0).cast("double"))
    return mnlogit(d, "c_mktsegment", ["pos_balance"]).coefficients(spark).select("term", "coefficient", "se")


@register("mnlogit_confusion", """
WITH d AS (SELECT c_mktsegment AS y, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS x FROM customer),
m AS (SELECT x, arg_max(y, k) AS pred FROM (SELECT x, y, count(*) AS k FROM d GROUP BY x, y) GROUP BY x)
SELECT y AS actual, pred AS predicted, count(*) AS n FROM d JOIN m USING (x) GROUP BY y, pred""")
def q_mnlogit_confusion(spark, sf):
    d = load(spark, sf, "customer").withColumn("pos_balance", (F.col("c_acctbal") > 0).cast("double"))
    fit = mnlogit(d, "c_mktsegment", ["pos_balance"])
    labels = F.array(*[F.lit(x) for x in fit.classes])
    p = score.predict_discrete(fit, d, keep=["c_mktsegment"]).withColumn(
        "pred", F.element_at(labels, (F.col("predicted_class") + 1).cast("int")))
    return ev.confusion(p, "c_mktsegment", "pred")


# ========================================================== evaluation
def _y_r(spark, sf):
    return _binary_li(spark, sf)


@register("auc_exact", f"""
WITH g AS (SELECT l_discount AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS pos,
           sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END) AS neg FROM lineitem GROUP BY l_discount),
c AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cn FROM g)
SELECT {S('sum(pos * (cn - 0.5 * neg)) / (sum(pos) * sum(neg))')} AS auc FROM c""")
def q_auc_exact(spark, sf):
    return spark.createDataFrame([(sig(ev.auc(_y_r(spark, sf), "is_r", "l_discount")),)], "auc double")


@register("roc_points", f"""
WITH g AS (SELECT l_discount AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS pos,
           sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END) AS neg FROM lineitem GROUP BY l_discount),
c AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / sum(pos) OVER () AS tpr,
      sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / sum(neg) OVER () AS fpr FROM g)
SELECT {S('s')} AS threshold, {S('fpr')} AS fpr, {S('tpr')} AS tpr FROM c""")
def q_roc_points(spark, sf):
    r = ev.roc_points(_y_r(spark, sf), "is_r", "l_discount")
    return r.select(*[sig_col(c).alias(c) for c in ("threshold", "fpr", "tpr")])


LPM_SQL = ols1_cte("(SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_quantity AS x FROM lineitem)",
                   "y", "x", "s")


def _lpm(spark, sf):
    d = _y_r(spark, sf)
    fit = ols(d, "is_r", ["l_quantity"])
    return d.withColumn("p", fit.linear_predictor())


DECILES_SQL = f"""WITH {LPM_SQL},
r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, b0 + b1 * l_quantity AS p FROM lineitem, s),
v AS (SELECT p, count(*) AS k FROM r GROUP BY p),
cum AS (SELECT p, sum(k) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS ck, sum(k) OVER () AS n FROM v),
cuts AS (SELECT i, (SELECT min(p) FROM cum WHERE ck * 10 >= i * n) AS cut FROM range(1, 10) t(i)),
dc AS (SELECT DISTINCT cut FROM cuts),
b AS (SELECT r.*, (SELECT count(*) FROM dc WHERE r.p >= dc.cut) AS bin FROM r),
cal AS (SELECT bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS obs_rate FROM b GROUP BY bin)"""


@register("calibration_table", DECILES_SQL + f"""
SELECT CAST(bin AS INTEGER) AS bin, n, {S('mean_pred')} AS mean_pred, {S('obs_rate')} AS obs_rate FROM cal""")
def q_calibration_table(spark, sf):
    c = ev.calibration(_lpm(spark, sf), "is_r", "p", 10)
    return c.select(F.col("bin").cast("int").alias("bin"), "n", sig_col("mean_pred").alias("mean_pred"),
                    sig_col("obs_rate").alias("obs_rate"))


@register("hosmer_lemeshow", DECILES_SQL + f""",
h AS (SELECT count(*) AS g, sum(pow(obs_rate * n - mean_pred * n, 2) / (mean_pred * n * (1 - mean_pred))) AS hl FROM cal)
SELECT 'hosmer_lemeshow' AS test, {S('hl')} AS statistic, CAST(g - 2 AS DOUBLE) AS df,
  {S(chi2_even_sf_sql('hl', 8))} AS p_value, {flag_sql(chi2_even_sf_sql('hl', 8))} AS flag FROM h""")
def q_hosmer_lemeshow(spark, sf):
    h = ev.hosmer_lemeshow(_lpm(spark, sf), "is_r", "p", 10)
    return tests_df(spark, [("hosmer_lemeshow", sig(h["hl_stat"]), float(h["df"]), sig(h["p_value"]),
                             diag.flag_p(h["p_value"]))])


@register("out_of_sample_metrics", f"""
WITH {ols1_cte("(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')", 'l_extendedprice', 'l_quantity')},
t AS (SELECT l_extendedprice - (b0 + b1 * l_quantity) AS e, l_extendedprice AS y FROM lineitem, s
      WHERE l_shipdate >= TIMESTAMP '2000-01-01')
SELECT 'n' AS metric, {S('count(*)')} AS value FROM t
UNION ALL SELECT 'rmse', {S('sqrt(avg(e * e))')} FROM t
UNION ALL SELECT 'mae', {S('avg(abs(e))')} FROM t
UNION ALL SELECT 'r_squared', {S('1 - sum(e * e) / (count(*) * var_pop(y))')} FROM t""")
def q_out_of_sample_metrics(spark, sf):
    li = _li(spark, sf)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    fit = ols(li.where(F.col("l_shipdate") < cut), "l_extendedprice", ["l_quantity"])
    test = li.where(F.col("l_shipdate") >= cut)
    m = ev.regression_metrics(test, "l_extendedprice", fit.linear_predictor())
    return metrics_df(spark, [(k, m[k]) for k in ("n", "rmse", "mae", "r_squared")])


@register("baseline_comparison", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
r AS (SELECT abs(l_extendedprice - (b0 + b1 * l_quantity)) AS am, abs(l_extendedprice - ybar) AS a0 FROM lineitem, s),
m AS (SELECT avg(am) AS mae_m, avg(a0) AS mae_0 FROM r)
SELECT 'rmse_model' AS metric, {S('sqrt((syy - b1 * sxy) / (n - 2))')} AS value FROM s
UNION ALL SELECT 'rmse_null', {S('sqrt(syy / n)')} FROM s
UNION ALL SELECT 'mae_model', {S('mae_m')} FROM m UNION ALL SELECT 'mae_null', {S('mae_0')} FROM m""")
def q_baseline_comparison(spark, sf):
    li = _li(spark, sf)
    b = ev.baseline(ols(li, "l_extendedprice", ["l_quantity"]), li)
    return metrics_df(spark, [(k, b[k]) for k in ("rmse_model", "rmse_null", "mae_model", "mae_null")])


@register("grouped_cv_by_year", f"""
WITH d AS (SELECT year(l_shipdate) AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
tr AS (SELECT f.fold, regr_slope(d.y, d.x) AS b1, regr_intercept(d.y, d.x) AS b0
       FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold)
SELECT CAST(d.fold AS INTEGER) AS fold, count(*) AS n_test, {S('sqrt(avg(pow(d.y - (b0 + b1 * d.x), 2)))')} AS rmse
FROM d JOIN tr USING (fold) GROUP BY d.fold""")
def q_grouped_cv_by_year(spark, sf):
    res = ev.cross_validate_linear(_li(spark, sf), "l_extendedprice", ["l_quantity"], key_cols=["l_shipdate"],
                                   fold=F.year("l_shipdate"))
    return spark.createDataFrame([(int(r["fold"]), int(r["n_test"]), sig(r["rmse"])) for r in res],
                                 "fold int, n_test bigint, rmse double")


@register("expanding_cv_by_year", f"""
WITH d AS (SELECT year(l_shipdate) AS p, l_quantity AS x, l_extendedprice AS y FROM lineitem),
ps AS (SELECT DISTINCT p FROM d),
tr AS (SELECT ps.p, regr_slope(d.y, d.x) AS b1, regr_intercept(d.y, d.x) AS b0, count(*) AS n_train
       FROM ps JOIN d ON d.p < ps.p GROUP BY ps.p)
SELECT CAST(d.p AS INTEGER) AS period, any_value(n_train) AS n_train, count(*) AS n_test,
       {S('sqrt(avg(pow(d.y - (b0 + b1 * d.x), 2)))')} AS rmse FROM d JOIN tr USING (p) GROUP BY d.p""")
def q_expanding_cv_by_year(spark, sf):
    res = ev.time_cv_linear(_li(spark, sf), "l_extendedprice", ["l_quantity"], F.year("l_shipdate"), "expanding")
    return spark.createDataFrame([(int(r["period"]), int(r["n_train"]), int(r["n_test"]), sig(r["rmse"])) for r in res],
                                 "period int, n_train bigint, n_test bigint, rmse double")


@register("rolling_cv_by_year", f"""
WITH d AS (SELECT year(l_shipdate) AS p, l_quantity AS x, l_extendedprice AS y FROM lineitem),
ps AS (SELECT p, dense_rank() OVER (ORDER BY p) AS r FROM (SELECT DISTINCT p FROM d)),
dr AS (SELECT d.*, r FROM d JOIN ps USING (p)),
tr AS (SELECT ps.r, regr_slope(dr.y, dr.x) AS b1, regr_intercept(dr.y, dr.x) AS b0, count(*) AS n_train
       FROM ps JOIN dr ON dr.r < ps.r AND dr.r >= ps.r - 2 GROUP BY ps.r)
SELECT CAST(p AS INTEGER) AS period, any_value(n_train) AS n_train, count(*) AS n_test,
       {S('sqrt(avg(pow(dr.y - (b0 + b1 * dr.x), 2)))')} AS rmse FROM dr JOIN tr USING (r) GROUP BY p""")
def q_rolling_cv_by_year(spark, sf):
    """E17 rolling mode: each year predicted from the two before it."""
    res = ev.time_cv_linear(_li(spark, sf), "l_extendedprice", ["l_quantity"], F.year("l_shipdate"), "rolling", window=2)
    return spark.createDataFrame([(int(r["period"]), int(r["n_train"]), int(r["n_test"]), sig(r["rmse"])) for r in res],
                                 "period int, n_train bigint, n_test bigint, rmse double")


@register("logit_cv_by_year", f"""
WITH d AS (SELECT year(l_shipdate) AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y,
           CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END AS x FROM lineitem),
c AS (SELECT p, x, sum(y) AS k, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY p, x),
t AS (SELECT x, sum(k) AS k, sum(n) AS n FROM c GROUP BY x),
q AS (SELECT c.p, c.k, c.n, greatest((t.k - c.k) / (t.n - c.n), 1e-15) AS pr FROM c JOIN t USING (x))
SELECT CAST(p AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n,
       {S('-sum(k * ln(pr) + (n - k) * ln(1 - pr)) / sum(n)')} AS log_loss,
       {S('sum(k * pow(1 - pr, 2) + (n - k) * pow(pr, 2)) / sum(n)')} AS brier FROM q GROUP BY p""")
def q_logit_cv_by_year(spark, sf):
    """E14 for a binary model: year folds, saturated feature."""
    d = _li(spark, sf).select((F.col("l_returnflag") == "R").cast("double").alias("is_r"), (F.col("l_quantity") <= 25).cast("double").alias("few"),
                              F.year("l_shipdate").alias("yr"))
    res = ev.cross_validate_binary(d, "is_r", ["few"], F.col("yr"))
    return spark.createDataFrame([(int(r["fold"]), int(r["n"]), sig(r["log_loss"]), sig(r["brier"])) for r in res],
                                 "fold int, n bigint, log_loss double, brier double")


@register("predict_observation_interval", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')}, f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT l_orderkey, l_linenumber, {S('b0 + b1 * l_quantity')} AS prediction,
  {S('sqrt(s2 * (1.0 + 1.0 / n + pow(l_quantity - xbar, 2) / sxx))')} AS se FROM lineitem, f""")
def q_predict_observation_interval(spark, sf):
    """The observation interval's standard error."""
    li = _li(spark, sf)
    o = score.predict_linear(ols(li, "l_extendedprice", ["l_quantity"]), li, "obs", keep=["l_orderkey", "l_linenumber"])
    return o.select("l_orderkey", "l_linenumber", sig_col("prediction").alias("prediction"), sig_col("se").alias("se"))


@register("encode_priority", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS label_code,
       CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS INTEGER) AS status_rank FROM orders""")
def q_encode_priority(spark, sf):
    """label codes by sorted level, ordinal codes by a given order."""
    d = feat.label_encode(load(spark, sf, "orders"), "o_orderpriority", "label_code")
    return feat.ordinal_encode(d, "o_orderstatus", ["P", "O", "F"], "status_rank").select("o_orderkey", "label_code", "status_rank")


@register("artifact_roundtrip", """
SELECT l_returnflag AS actual, l_linestatus AS predicted, count(*) AS n FROM lineitem GROUP BY ALL""")
def q_artifact_roundtrip(spark, sf):
    """A result table as a JSON artifact in the shared folder, read back."""
    path = stream.scratch(spark, "artifact")
    reg.write_artifact(ev.confusion(_li(spark, sf), "l_returnflag", "l_linestatus"), path, "json")
    return spark.read.schema("actual string, predicted string, n bigint").json(path)


@register("loo_press", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
r AS (SELECT pow((l_extendedprice - (b0 + b1 * l_quantity)) / (1 - (1.0 / n + pow(l_quantity - xbar, 2) / sxx)), 2) AS q
      FROM lineitem, s)
SELECT 'press' AS metric, {S('sum(q)')} AS value FROM r UNION ALL SELECT 'loo_rmse', {S('sqrt(avg(q))')} FROM r""")
def q_loo_press(spark, sf):
    li = _li(spark, sf)
    r = ev.loo_linear(li, ols(li, "l_extendedprice", ["l_quantity"]))
    return metrics_df(spark, [("press", r["press"]), ("loo_rmse", r["loo_rmse"])])


@register("partial_f_test", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')}, {ols2_cte('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount')}
SELECT 'partial_f' AS test, {S('((s.syy - s.b1 * s.sxy) - t_f.ssr) / (t_f.ssr / (t_f.n - 3))')} AS f_stat FROM s, t_f""")
def q_partial_f_test(spark, sf):
    r = ev.partial_f(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], ["l_discount"])
    return spark.createDataFrame([("partial_f", sig(r["f_stat"]))], "test string, f_stat double")


@register("ridge_path", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
l AS (SELECT CAST(lam AS DOUBLE) AS lam FROM (VALUES (0.0), (100.0), (10000.0)) t(lam)),
b AS (SELECT lam, sxy / (sxx * (n + lam) / n) AS b1, ybar, xbar FROM s, l)
SELECT lam AS lambda, 'const' AS term, {S('ybar - b1 * xbar')} AS coefficient FROM b
UNION ALL SELECT lam, 'l_quantity', {S('b1')} FROM b""")
def q_ridge_path(spark, sf):
    res = ev.ridge(_li(spark, sf), "l_extendedprice", ["l_quantity"], [0.0, 100.0, 10000.0])
    rows = [(float(r["lambda"]), t, sig(b)) for r in res for t, b in zip(["const", "l_quantity"], r["coef"])]
    return spark.createDataFrame(rows, "lambda double, term string, coefficient double")


# ========================================================== prediction
@register("predict_linear_intervals", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')}, f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT l_orderkey, l_linenumber, {S('b0 + b1 * l_quantity')} AS prediction,
  {S('sqrt(s2 * (1.0 / n + pow(l_quantity - xbar, 2) / sxx))')} AS se_mean,
  {S('sqrt(s2 * (1.0 + 1.0 / n + pow(l_quantity - xbar, 2) / sxx))')} AS se_obs FROM lineitem, f""")
def q_predict_linear_intervals(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    m = score.predict_linear(fit, li, "mean", keep=["l_orderkey", "l_linenumber"])
    return m.select("l_orderkey", "l_linenumber", sig_col("prediction").alias("prediction"),
                    sig_col("se").alias("se_mean"),
                    sig_col(F.sqrt(F.col("se") ** 2 + F.lit(fit.sigma2))).alias("se_obs"))


# ====================================================== interpretation
@register("elasticities", f"""
WITH {ols2_cte('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount')}
SELECT 'l_quantity' AS term, {S('b1 * m1 / my')} AS elasticity FROM t_f
UNION ALL SELECT 'l_discount', {S('b2 * m2 / my')} FROM t_f""")
def q_elasticities(spark, sf):
    fit = ols(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame(interp.elasticities(fit), "term string, elasticity double")


@register("partial_dependence", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
g AS (SELECT i, lo + (hi - lo) * i / 19 AS v FROM r, range(0, 20) t(i))
SELECT CAST(i AS INTEGER) AS grid_index, {S('v')} AS grid_value, {S('b0 + b1 * v')} AS partial_dependence FROM g, s""")
def q_partial_dependence(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    pd_ = interp.partial_dependence(li, fit, "l_quantity", 20)
    return pd_.select(F.col("grid_index").cast("int").alias("grid_index"), sig_col("grid_value").alias("grid_value"),
                      sig_col("partial_dependence").alias("partial_dependence"))


@register("driver_scenario", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
d AS (SELECT stddev_pop(l_quantity) AS sd FROM lineitem)
SELECT 'base' AS metric, {S('ybar')} AS value FROM s UNION ALL SELECT 'scenario', {S('ybar + b1 * sd')} FROM s, d
UNION ALL SELECT 'delta', {S('b1 * sd')} FROM s, d""")
def q_driver_scenario(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    sd = li.agg(F.stddev_pop("l_quantity")).collect()[0][0]
    return interp.scenario(li, fit, {"l_quantity": sd})


@register("linear_attribution_summary", f"""
WITH {ols2_cte('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount')}
SELECT {S('avg(abs(b1 * (l_quantity - m1)))')} AS l_quantity, {S('avg(abs(b2 * (l_discount - m2)))')} AS l_discount
FROM lineitem, t_f""")
def q_linear_attribution_summary(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity", "l_discount"])
    m = interp.mean_abs_attribution(li, fit)
    return m.select(*[sig_col(c).alias(c) for c in m.columns])


@register("influence_top10", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')}, f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s),
r AS (SELECT l_orderkey, l_linenumber, 1.0 / n + pow(l_quantity - xbar, 2) / sxx AS h,
      l_extendedprice - (b0 + b1 * l_quantity) AS e, s2 FROM lineitem, f),
c AS (SELECT *, e * e / (s2 * (1 - h)) / 2.0 * h / (1 - h) AS d FROM r)
SELECT l_orderkey, l_linenumber, {S('h')} AS leverage, {S('d')} AS cooks_d FROM c ORDER BY d DESC, l_orderkey, l_linenumber LIMIT 10""")
def q_influence_top10(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    inf = diag.influence(li, fit, keep=["l_orderkey", "l_linenumber"])
    top = inf.orderBy(F.col("cooks_d").desc(), "l_orderkey", "l_linenumber").limit(10)
    return top.select("l_orderkey", "l_linenumber", sig_col("leverage").alias("leverage"),
                      sig_col("cooks_d").alias("cooks_d"))


# =========================================================== series
EV_ORDER = ["ts", "event_id"]


def _ev(spark, sf):
    return load(spark, sf, "events")


@register("acf_events", f"""
WITH m AS (SELECT avg(value) AS mu, sum((value - avg_v) * (value - avg_v)) AS den FROM events,
           (SELECT avg(value) AS avg_v FROM events)),
l AS (SELECT value, """ + ", ".join(f"lag(value, {k}) OVER (ORDER BY ts, event_id) AS l{k}" for k in range(1, 6)) + f""" FROM events)
""" + "\nUNION ALL\n".join(
    f"SELECT {k} AS lag, {S(f'sum((value - mu) * (l{k} - mu)) / any_value(den)')} AS acf FROM l, m WHERE l{k} IS NOT NULL"
    for k in range(1, 6)).replace("WITH m AS (SELECT avg(value) AS mu,", "WITH m AS (SELECT any_value(avg_v) AS mu,"))
def q_acf_events(spark, sf):
    rho = series.acf(_ev(spark, sf), "value", EV_ORDER, 5)
    return spark.createDataFrame([(k, sig(rho[k])) for k in range(1, 6)], "lag int, acf double")


@register("adf_events", f"""
WITH l AS (SELECT value - lag(value) OVER (ORDER BY ts, event_id) AS dy, lag(value) OVER (ORDER BY ts, event_id) AS yl
           FROM events),
{ols1_cte('(SELECT * FROM l WHERE dy IS NOT NULL)', 'dy', 'yl')},
f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT {S('b1')} AS gamma, {S('b1 / sqrt(s2 / sxx)')} AS adf_stat, CAST(n AS BIGINT) AS n_obs FROM f""")
def q_adf_events(spark, sf):
    a = series.adf(_ev(spark, sf), "value", EV_ORDER, 0)
    return spark.createDataFrame([(sig(a["gamma"]), sig(a["adf_stat"]), int(a["n_obs"]))],
                                 "gamma double, adf_stat double, n_obs bigint")


@register("cusum_events", f"""
WITH m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM events),
c AS (SELECT sum(value - mu) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events, m),
x AS (SELECT max(abs(s)) / (any_value(sd) * sqrt(any_value(n))) AS stat FROM c, m)
SELECT {S('stat')} AS cusum_stat, {S(kolmogorov_sql('x.stat'))} AS p_value FROM x""")
def q_cusum_events(spark, sf):
    c = series.cusum(_ev(spark, sf), "value", EV_ORDER)
    return spark.createDataFrame([(sig(c["cusum_stat"]), sig(c["p_value"]))], "cusum_stat double, p_value double")


@register("lags_diffs_by_user", f"""
SELECT event_id, {S('lag(value) OVER w')} AS value_lag1, {S('value - lag(value) OVER w')} AS value_diff1
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_lags_diffs_by_user(spark, sf):
    d = series.lags_and_diffs(_ev(spark, sf), "value", "user_id", EV_ORDER, lags=1, diff=1)
    return d.select("event_id", sig_col("value_lag1").alias("value_lag1"), sig_col("value_diff1").alias("value_diff1"))


@register("resample_hourly", f"""
WITH b AS (SELECT event_type, date_trunc('hour', ts) AS slot, sum(value) AS v FROM events GROUP BY ALL),
r AS (SELECT event_type, min(slot) AS lo, max(slot) AS hi FROM b GROUP BY event_type),
sp AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS slot FROM r)
SELECT sp.event_type, sp.slot, {S('coalesce(b.v, 0.0)')} AS value FROM sp LEFT JOIN b USING (event_type, slot)""")
def q_resample_hourly(spark, sf):
    r = series.resample(_ev(spark, sf), "ts", "1 hour", "value", "event_type", "sum")
    return r.select("event_type", F.col("slot").cast("timestamp_ntz").alias("slot"), sig_col("value").alias("value"))


@register("series_features_by_user", f"""
WITH d AS (SELECT user_id, value AS x, row_number() OVER w AS t, lag(value) OVER w AS xl, lead(value) OVER w AS xd
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n, {S('avg(x)')} AS mean, {S('stddev_samp(x)')} AS sd, {S('regr_slope(x, t)')} AS trend,
       {S('corr(x, xl)')} AS acf1, CAST(sum(CASE WHEN x > xl AND x > xd THEN 1 ELSE 0 END) AS BIGINT) AS peaks
FROM d GROUP BY user_id""")
def q_series_features_by_user(spark, sf):
    f = series.series_features(_ev(spark, sf), "user_id", EV_ORDER, "value")
    return f.select("user_id", "n", *[sig_col(c).alias(c) for c in ("mean", "sd", "trend", "acf1")],
                    F.col("peaks").cast("long").alias("peaks"))


@register("ar1_by_event_type", f"""
WITH l AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS x FROM events),
s AS (SELECT event_type, regr_count(y, x) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0,
      regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_avgx(y, x) AS xbar FROM l GROUP BY 1),
f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT event_type, 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(s2 * (1.0 / n + xbar * xbar / sxx))')} AS se FROM f
UNION ALL SELECT event_type, 'value_l1', {S('b1')}, {S('sqrt(s2 / sxx)')} FROM f""")
def q_ar1_by_event_type(spark, sf):
    return series.ar_by_series(_ev(spark, sf), "value", "event_type", EV_ORDER, 1).select(
        "event_type", "term", "coefficient", "se")


# ============================================================ panel
@register("panel_within", f"""
WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem GROUP BY 1),
d AS (SELECT l_extendedprice - my AS y, l_quantity - mx AS x FROM lineitem JOIN m USING (l_suppkey)),
s AS (SELECT sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy, count(*) AS n FROM d),
g AS (SELECT count(*) AS gcount FROM m),
f AS (SELECT *, sxy / sxx AS b, (syy - sxy * sxy / sxx) / (n - gcount - 1) AS s2 FROM s, g)
SELECT 'l_quantity' AS term, {S('b')} AS coefficient, {S('sqrt(s2 / sxx)')} AS se FROM f""")
def q_panel_within(spark, sf):
    fit = panel.within(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return spark.createDataFrame([(t, b, s) for t, b, s, _, _ in fit.coef_rows()], "term string, coefficient double, se double")


@register("panel_two_way", f"""
WITH d AS (SELECT l_suppkey AS g, l_extendedprice AS y, l_quantity AS x, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS t FROM lineitem),
m AS (SELECT g, avg(y) AS my, avg(x) AS mx, avg(t) AS mt FROM d GROUP BY g),
w AS (SELECT y - my AS y, x - mx AS x, t - mt AS t FROM d JOIN m USING (g)),
s AS (SELECT sum(x * x) AS xx, sum(x * t) AS xt, sum(t * t) AS tt, sum(x * y) AS xy, sum(t * y) AS ty, sum(y * y) AS yy, count(*) AS n FROM w),
b AS (SELECT *, (xy * tt - ty * xt) / (xx * tt - xt * xt) AS bx, (ty * xx - xy * xt) / (xx * tt - xt * xt) AS bt FROM s),
v AS (SELECT *, (yy - bx * xy - bt * ty) / (n - (SELECT count(*) FROM m) - 2) AS s2 FROM b)
SELECT 'l_quantity' AS term, {S('bx')} AS coefficient, {S('sqrt(s2 * tt / (xx * tt - xt * xt))')} AS se FROM v""")
def q_panel_two_way(spark, sf):
    """N1 two-way: supplier and line-status effects (the second partialled out exactly)."""
    fit = panel.within(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey", "l_linestatus")
    return fit.coefficients(spark).select("term", "coefficient", "se")


@register("panel_between", f"""
WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem GROUP BY l_suppkey),
{ols1_cte('m', 'y', 'x')}, f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(s2 * (1.0 / n + xbar * xbar / sxx))')} AS se FROM f
UNION ALL SELECT 'l_quantity', {S('b1')}, {S('sqrt(s2 / sxx)')} FROM f""")
def q_panel_between(spark, sf):
    fit = panel.between(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return spark.createDataFrame([(t, b, s) for t, b, s, _, _ in fit.coef_rows()], "term string, coefficient double, se double")


@register("panel_first_difference", f"""
WITH d AS (SELECT l_extendedprice - lag(l_extendedprice) OVER w AS y, l_quantity - lag(l_quantity) OVER w AS x
           FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_shipdate, l_extendedprice)),
s AS (SELECT sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy, count(*) AS n FROM d WHERE y IS NOT NULL),
f AS (SELECT *, sxy / sxx AS b, (syy - sxy * sxy / sxx) / (n - 1) AS s2 FROM s)
SELECT 'l_quantity' AS term, {S('b')} AS coefficient, {S('sqrt(s2 / sxx)')} AS se FROM f""")
def q_panel_first_difference(spark, sf):
    fit = panel.first_difference(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey", LI_ORDER)
    return spark.createDataFrame([(t, b, s) for t, b, s, _, _ in fit.coef_rows()], "term string, coefficient double, se double")


@register("panel_fe_f_test", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
m AS (SELECT l_suppkey, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem GROUP BY 1),
d AS (SELECT l_extendedprice - my AS y, l_quantity - mx AS x FROM lineitem JOIN m USING (l_suppkey)),
w AS (SELECT sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS ssr_fe, count(*) AS nn FROM d),
g AS (SELECT count(*) AS gcount FROM m)
SELECT {S('((s.syy - s.b1 * s.sxy) - ssr_fe) / (gcount - 1) / (ssr_fe / (nn - gcount - 1))')} AS f_stat,
       CAST(gcount - 1 AS BIGINT) AS df_num, CAST(nn - gcount - 1 AS BIGINT) AS df_den FROM s, w, g""")
def q_panel_fe_f_test(spark, sf):
    r = panel.fe_f_test(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return spark.createDataFrame([(sig(r["f_stat"]), int(r["df_num"]), int(r["df_den"]))],
                                 "f_stat double, df_num bigint, df_den bigint")


@register("panel_random_effects_hausman", None)
def q_panel_random_effects_hausman(spark, sf):
    li = _li(spark, sf)
    fe = panel.within(li, "l_extendedprice", ["l_quantity"], "l_suppkey")
    re_ = panel.random_effects(li, "l_extendedprice", ["l_quantity"], "l_suppkey")
    h = panel.hausman(fe, re_)
    rows = [("re:" + t, b, s) for t, b, s, _, _ in re_.coef_rows()] + [("hausman", sig(h["hausman"]), sig(h["p_value"]))]
    return spark.createDataFrame(rows, "term string, value double, extra double")


# =========================================================== causal
@register("iv2sls_just_identified", f"""
WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(l_tax) AS sz, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy,
      sum(l_tax * l_quantity) AS szx, sum(l_tax * l_extendedprice) AS szy, sum(l_tax * l_tax) AS szz FROM lineitem),
b AS (SELECT *, n * szx - sz * sx AS det, (n * szy - sz * sy) / (n * szx - sz * sx) AS b1 FROM s),
c AS (SELECT *, sy / n - b1 * sx / n AS b0 FROM b),
r AS (SELECT sum(pow(l_extendedprice - b0 - b1 * l_quantity, 2)) / (any_value(n) - 2) AS s2 FROM lineitem, c),
v AS (SELECT *, s2 * (sz * sz * n - 2 * sz * n * sz + n * n * szz) / (det * det) AS v11 FROM c, r)
SELECT 'l_quantity' AS term, {S('b1')} AS coefficient, {S('sqrt(v11)')} AS se FROM v""")
def q_iv2sls_just_identified(spark, sf):
    r = causal.iv2sls(_li(spark, sf), "l_extendedprice", [], ["l_quantity"], ["l_tax"])
    i = r["terms"].index("l_quantity")
    return spark.createDataFrame([("l_quantity", sig(r["beta"][i]), sig(r["se"][i]))],
                                 "term string, coefficient double, se double")


DID_SRC = ("(SELECT l_extendedprice AS y, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, "
           "CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS p FROM lineitem)")


@register("did_2x2", f"""
WITH c AS (SELECT t, p, avg(y) AS m, count(*) AS k, sum(y * y) - count(*) * avg(y) * avg(y) AS ss FROM {DID_SRC} GROUP BY t, p),
e AS (SELECT sum(CASE WHEN t = 1 AND p = 1 THEN m WHEN t = 1 AND p = 0 THEN -m WHEN t = 0 AND p = 1 THEN -m ELSE m END) AS did,
      sum(ss) / (sum(k) - 4) AS s2, sum(1.0 / k) AS ik FROM c)
SELECT {S('did')} AS did, {S('sqrt(s2 * ik)')} AS se FROM e""")
def q_did_2x2(spark, sf):
    d = _li(spark, sf).select(
        "l_extendedprice", (F.col("l_returnflag") == "R").cast("double").alias("treat"),
        (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("double").alias("post"))
    r = causal.did(d, "l_extendedprice", "treat", "post")
    return spark.createDataFrame([(sig(r["did"]), sig(r["se"]))], "did double, se double")


def _rdd_side(cond: str, name: str) -> str:
    return f"""{name}_d AS (SELECT l_extendedprice AS y, l_quantity - 25.0 AS x, 1 - abs(l_quantity - 25.0) / 10.0 AS w
  FROM lineitem WHERE abs(l_quantity - 25.0) < 10.0 AND {cond}),
{name}_s AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx_r,
  sum(w * x * y) AS sxy_r, sum(w * y * y) AS syy_r FROM {name}_d),
{name} AS (SELECT *, (sxy_r - sx * sy / sw) / (sxx_r - sx * sx / sw) AS b1, sx / sw AS xb, sy / sw AS yb,
  sxx_r - sx * sx / sw AS sxx, syy_r - sy * sy / sw AS syy, sxy_r - sx * sy / sw AS sxy FROM {name}_s),
{name}_f AS (SELECT *, yb - b1 * xb AS b0, (syy - b1 * sxy) / (n - 2) * (1.0 / sw + xb * xb / sxx) AS v0 FROM {name})"""


@register("rdd_local_linear", f"""
WITH {_rdd_side('l_quantity - 25.0 >= 0', 'rt')}, {_rdd_side('l_quantity - 25.0 < 0', 'lf')}
SELECT {S('rt_f.b0 - lf_f.b0')} AS jump, {S('sqrt(rt_f.v0 + lf_f.v0)')} AS se, CAST(lf_f.n AS BIGINT) AS n_left,
       CAST(rt_f.n AS BIGINT) AS n_right FROM rt_f, lf_f""")
def q_rdd_local_linear(spark, sf):
    r = causal.rdd(_li(spark, sf), "l_extendedprice", "l_quantity", 25.0, 10.0)
    return spark.createDataFrame([(sig(r["jump"]), sig(r["se"]), int(r["n_left"]), int(r["n_right"]))],
                                 "jump double, se double, n_left bigint, n_right bigint")


@register("covariate_balance", f"""
WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, l_quantity, l_discount FROM lineitem)
SELECT 'l_quantity' AS covariate, {S('avg(CASE WHEN t = 1 THEN l_quantity END)')} AS mean_treated,
  {S('avg(CASE WHEN t = 0 THEN l_quantity END)')} AS mean_control,
  {S('(avg(CASE WHEN t = 1 THEN l_quantity END) - avg(CASE WHEN t = 0 THEN l_quantity END)) / sqrt((var_pop(CASE WHEN t = 1 THEN l_quantity END) + var_pop(CASE WHEN t = 0 THEN l_quantity END)) / 2)')} AS smd FROM d
UNION ALL
SELECT 'l_discount', {S('avg(CASE WHEN t = 1 THEN l_discount END)')}, {S('avg(CASE WHEN t = 0 THEN l_discount END)')},
  {S('(avg(CASE WHEN t = 1 THEN l_discount END) - avg(CASE WHEN t = 0 THEN l_discount END)) / sqrt((var_pop(CASE WHEN t = 1 THEN l_discount END) + var_pop(CASE WHEN t = 0 THEN l_discount END)) / 2)')} FROM d""")
def q_covariate_balance(spark, sf):
    b = causal.balance(_binary_li(spark, sf), "is_r", ["l_quantity", "l_discount"])
    return b.select("covariate", *[sig_col(c).alias(c) for c in ("mean_treated", "mean_control", "smd")])


@register("ipw_ate", f"""
WITH d AS (SELECT l_extendedprice AS y, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS t,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS z FROM lineitem),
p AS (SELECT z, avg(t) AS ps FROM d GROUP BY z),
r AS (SELECT y, t, ps FROM d JOIN p USING (z))
SELECT {S('sum(t * y / ps) / sum(t / ps) - sum((1 - t) * y / (1 - ps)) / sum((1 - t) / (1 - ps))')} AS ate FROM r""")
def q_ipw_ate(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "status_f", ["is_r"])
    return spark.createDataFrame([(sig(causal.ipw_ate(d, "l_extendedprice", "status_f", probability(fit))),)], "ate double")


@register("psm_att")
def q_psm_att(spark, sf):
    d = _li(spark, sf).select(*LI_ORDER, "l_quantity", "l_discount",
                              (F.col("l_linestatus") == "F").cast("double").alias("status_f"))
    r = causal.psm_att(d, "status_f", "l_extendedprice", ["l_quantity", "l_discount"], LI_ORDER, caliper=0.01)
    return spark.createDataFrame([(sig(r["att"]), sig(r["se"]), int(r["matched"]), int(r["unmatched"]))],
                                 "att double, se double, matched bigint, unmatched bigint")


@register("t_learner_uplift", f"""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t FROM lineitem),
a AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM d WHERE t = 1),
b AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM d WHERE t = 0)
SELECT {S('avg((a.b0 + a.b1 * d.x) - (b.b0 + b.b1 * d.x))')} AS mean_uplift FROM d, a, b""")
def q_t_learner_uplift(spark, sf):
    d = _binary_li(spark, sf)
    up, _ = causal.t_learner(d, "l_extendedprice", "is_r", ["l_quantity"])
    return d.agg(sig_col(F.avg(up)).alias("mean_uplift"))


# ========================================================== monitors
SPLIT = "TIMESTAMP '2024-01-15 00:00:00'"


def _ev_halves(spark, sf):
    e = _ev(spark, sf)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)


@register("ks_drift_events", f"""
WITH a AS (SELECT value AS v FROM events WHERE ts < {SPLIT}), b AS (SELECT value AS v FROM events WHERE ts >= {SPLIT}),
na AS (SELECT count(*) AS n FROM a), nb AS (SELECT count(*) AS n FROM b),
u AS (SELECT v, count(*) AS ca, 0 AS cb FROM a GROUP BY v UNION ALL SELECT v, 0, count(*) FROM b GROUP BY v),
g AS (SELECT v, sum(ca) AS ca, sum(cb) AS cb FROM u GROUP BY v),
c AS (SELECT sum(ca) OVER w AS fa, sum(cb) OVER w AS fb FROM g WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
d AS (SELECT max(abs(fa / na.n - fb / nb.n)) AS ks, any_value(na.n) AS n1, any_value(nb.n) AS n2 FROM c, na, nb),
e AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * ks AS lam FROM d)
SELECT {S('ks')} AS ks_stat, {S(kolmogorov_sql('e.lam'))} AS p_value FROM e""")
def q_ks_drift_events(spark, sf):
    a, b = _ev_halves(spark, sf)
    r = ev.ks_two_sample(a, b, "value")
    return spark.createDataFrame([(sig(r["ks_stat"]), sig(r["p_value"]))], "ks_stat double, p_value double")


@register("psi_events", f"""
WITH a AS (SELECT value AS v FROM events WHERE ts < {SPLIT}), b AS (SELECT value AS v FROM events WHERE ts >= {SPLIT}),
va AS (SELECT v, count(*) AS k FROM a GROUP BY v),
cum AS (SELECT v, sum(k) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ck, sum(k) OVER () AS n FROM va),
cuts AS (SELECT DISTINCT (SELECT min(v) FROM cum WHERE ck * 10 >= i * n) AS cut FROM range(1, 10) t(i)),
ba AS (SELECT (SELECT count(*) FROM cuts WHERE a.v >= cut) AS bin FROM a),
bb AS (SELECT (SELECT count(*) FROM cuts WHERE b.v >= cut) AS bin FROM b),
ca AS (SELECT bin, count(*) AS na FROM ba GROUP BY bin), cb AS (SELECT bin, count(*) AS nb FROM bb GROUP BY bin),
j AS (SELECT coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM ca FULL JOIN cb USING (bin)),
s AS (SELECT greatest(na / sum(na) OVER (), 1e-4) AS sa, greatest(nb / sum(nb) OVER (), 1e-4) AS sb FROM j)
SELECT {S('sum((sb - sa) * ln(sb / sa))')} AS psi FROM s""")
def q_psi_events(spark, sf):
    a, b = _ev_halves(spark, sf)
    return spark.createDataFrame([(sig(mon.psi(a, b, "value")["psi"]),)], "psi double")


@register("auc_decay_by_year", f"""
WITH g AS (SELECT year(l_shipdate) AS period, l_discount AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS pos,
           sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END) AS neg FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY period ORDER BY s ROWS UNBOUNDED PRECEDING) AS cn FROM g),
a AS (SELECT period, sum(pos * (cn - 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc, CAST(sum(pos + neg) AS BIGINT) AS n
      FROM c GROUP BY period),
l AS (SELECT *, auc < 0.5 AS low FROM a),
gr AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS grp FROM l),
r AS (SELECT *, CASE WHEN low THEN count(*) OVER (PARTITION BY grp, low ORDER BY period ROWS UNBOUNDED PRECEDING) ELSE 0 END AS low_run FROM gr)
SELECT CAST(period AS INTEGER) AS period, {S('auc')} AS auc, n, low, CAST(low_run AS INTEGER) AS low_run, low_run >= 2 AS alarm FROM r""")
def q_auc_decay_by_year(spark, sf):
    d = _li(spark, sf).select((F.col("l_returnflag") == "R").cast("double").alias("is_r"), "l_discount",
                              F.year("l_shipdate").alias("yr"))
    a = mon.auc_decay(d, "is_r", "l_discount", F.col("yr"), floor=0.5, runs=2)
    return a.select(F.col("period").cast("int").alias("period"), sig_col("auc").alias("auc"), "n", "low",
                    "low_run", "alarm")


# ========================================================== streaming
def _events_schema(spark, sf):
    return _ev(spark, sf).schema


@register("stream_window_stats", f"""
WITH d AS (SELECT date_trunc('day', ts) AS window_start, value FROM events),
w AS (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS n, sum(value) AS s, min(value) AS mn,
      max(value) AS mx FROM d GROUP BY window_start)
SELECT window_start, window_end, n, {S('s')} AS sum, {S('mn')} AS min, {S('mx')} AS max FROM w
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_window_stats(spark, sf):
    s = stream.file_stream(spark, sf, "events.parquet", _events_schema(spark, sf), ts="ts")
    out = stream.run_to_table(stream.window_stats(s, "ts", "value", "1 day", watermark="1 hour"),
                              stream.scratch(spark, "window-stats"))
    r = spark.read.parquet(out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n",
                    sig_col("sum").alias("sum"), sig_col("min").alias("min"), sig_col("max").alias("max"))


@register("stream_score", f"""
WITH {ols1_cte('events', 'value', 'user_id')}
SELECT event_id, {S('b0 + b1 * user_id')} AS prediction FROM events, s""")
def q_stream_score(spark, sf):
    fit = ols(_ev(spark, sf), "value", ["user_id"])
    s = stream.file_stream(spark, sf, "events.parquet", _events_schema(spark, sf))
    out = stream.run_to_table(stream.score_stream(s, fit.linear_predictor(), ["event_id"]), stream.scratch(spark, "score"))
    return spark.read.parquet(out).select("event_id", sig_col("prediction").alias("prediction"))


@register("stream_gram_fit", f"""
WITH {ols1_cte('events', 'value', 'user_id')}
SELECT 'const' AS term, {S('b0')} AS coefficient FROM s UNION ALL SELECT 'user_id', {S('b1')} FROM s""")
def q_stream_gram_fit(spark, sf):
    s = stream.file_stream(spark, sf, "events.parquet", _events_schema(spark, sf), ts="ts")
    out = stream.gram_stream(s, "ts", "value", ["user_id"], "1 day", stream.scratch(spark, "gram"))
    (beta, _, _, _), _ = stream.fit_from_gram_rows(spark.read.parquet(out), "value", ["user_id"])
    return spark.createDataFrame([("const", sig(beta[0])), ("user_id", sig(beta[1]))], "term string, coefficient double")


@register("stream_cusum_by_type", f"""
WITH c AS (SELECT event_type, sum(value - 100.0) OVER (PARTITION BY event_type ORDER BY ts, event_id
           ROWS UNBOUNDED PRECEDING) AS s FROM events)
SELECT event_type AS key, count(*) AS n, {S('max(abs(least(s, 0.0)))')} AS neg_excursion,
       {S('max(greatest(s, 0.0))')} AS pos_excursion FROM c GROUP BY event_type""")
def q_stream_cusum_by_type(spark, sf):
    s = stream.file_stream(spark, sf, "events.parquet", _events_schema(spark, sf))
    path = stream.cusum_stream_batches(s, "event_type", "value", EV_ORDER, 100.0, 1e9, stream.scratch(spark, "cusum"))
    r = spark.read.parquet(path)
    return r.select(F.col("event_type").alias("key"), "n", sig_col(F.abs(F.col("smin"))).alias("neg_excursion"),
                    sig_col("smax").alias("pos_excursion"))


# ========================================================== features
@register("dummies_segment", f"""
SELECT c_custkey, """ + ", ".join(
    f"CAST(CASE WHEN c_mktsegment = '{v}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS \"c_mktsegment_{v}\""
    for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def q_dummies_segment(spark, sf):
    d, names = feat.dummies(load(spark, sf, "customer"), "c_mktsegment")
    return d.select("c_custkey", *names)


@register("feature_transforms", f"""
WITH m AS (SELECT avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd, min(l_discount) AS lo,
           max(l_discount) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, {S('ln(1 + l_extendedprice)')} AS log1p_price,
  {S('l_quantity * l_discount')} AS qty_x_disc, {S('(l_extendedprice - mu) / sd')} AS z_price,
  {S('(l_discount - lo) / (hi - lo)')} AS mm_discount,
  CAST((CASE WHEN l_extendedprice >= 10000 THEN 1 ELSE 0 END) + (CASE WHEN l_extendedprice >= 30000 THEN 1 ELSE 0 END)
   + (CASE WHEN l_extendedprice >= 50000 THEN 1 ELSE 0 END) + (CASE WHEN l_extendedprice >= 70000 THEN 1 ELSE 0 END)
   AS INTEGER) AS price_bin
FROM lineitem, m""")
def q_feature_transforms(spark, sf):
    li = _li(spark, sf)
    d = feat.log1p(li, "l_extendedprice", "log1p_price")
    d = feat.interact(d, "l_quantity", "l_discount", "qty_x_disc")
    d = feat.scale(d, ["l_extendedprice"], "zscore")
    d = feat.scale(d, ["l_discount"], "minmax")
    d = d.withColumn("price_bin", feat.bin_edges("l_extendedprice", [10000, 30000, 50000, 70000]))
    return d.select("l_orderkey", "l_linenumber", sig_col("log1p_price").alias("log1p_price"),
                    sig_col("qty_x_disc").alias("qty_x_disc"), sig_col("z_l_extendedprice").alias("z_price"),
                    sig_col("mm_l_discount").alias("mm_discount"), "price_bin")


@register("nps3_counts", """
SELECT CASE WHEN s <= 6 THEN 0 WHEN s <= 8 THEN 1 ELSE 2 END AS nps3, count(*) AS n
FROM (SELECT round(l_discount * 100) AS s FROM lineitem) GROUP BY 1""")
def q_nps3_counts(spark, sf):
    d = _li(spark, sf).withColumn("score", F.round(F.col("l_discount") * 100))
    return d.groupBy(feat.nps3("score").alias("nps3")).agg(F.count(F.lit(1)).alias("n"))


@register("strata_weights", """
WITH s AS (SELECT o_orderpriority, count(*) AS n_sample FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
p AS (SELECT o_orderpriority, count(*) AS n_pop FROM orders GROUP BY 1)
SELECT o_orderpriority, n_sample, n_pop, CAST(n_pop AS DOUBLE) / n_sample AS weight FROM s JOIN p USING (o_orderpriority)""")
def q_strata_weights(spark, sf):
    o = load(spark, sf, "orders")
    return feat.strata_weights(o.where(F.col("o_orderstatus") == "F"), o, "o_orderpriority").select(
        "o_orderpriority", "n_sample", "n_pop", "weight")


@register("counts_by_cell", """
SELECT l_linestatus, l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS successes,
       count(*) AS trials FROM lineitem GROUP BY 1, 2""")
def q_counts_by_cell(spark, sf):
    d = _li(spark, sf).withColumn("is_r", (F.col("l_returnflag") == "R").cast("double"))
    return feat.to_counts(d, "is_r", ["l_linestatus", "l_linenumber"])


@register("target_encoding_by_year", f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year(l_shipdate) AS fold,
           CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
cf AS (SELECT l_suppkey, fold, sum(y) AS s, count(*) AS k FROM d GROUP BY 1, 2),
ct AS (SELECT l_suppkey, sum(s) AS st, sum(k) AS kt FROM cf GROUP BY 1),
ff AS (SELECT fold, sum(y) AS fs, count(*) AS fk FROM d GROUP BY 1),
tt AS (SELECT sum(y) AS ts, count(*) AS tk FROM d),
enc AS (SELECT l_suppkey, fold, ((st - s) + 10.0 * ((ts - fs) / (tk - fk))) / ((kt - k) + 10.0) AS te
        FROM cf JOIN ct USING (l_suppkey) JOIN ff USING (fold), tt)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {S('te')} AS te_supp FROM d JOIN enc USING (l_suppkey, fold)""")
def q_target_encoding_by_year(spark, sf):
    d = _li(spark, sf).select(*LI_KEY, F.year("l_shipdate").alias("yr"),
                              (F.col("l_returnflag") == "R").cast("double").alias("is_r"))
    te = feat.target_encode(d, "l_suppkey", "is_r", smoothing=10.0, fold=F.col("yr"), out="te_supp")
    return te.select(*LI_KEY, sig_col("te_supp").alias("te_supp"))


@register("child_aggregates", f"""
SELECT o_orderkey, count(l_orderkey) AS n_children, {S('sum(l_quantity)')} AS sum_l_quantity,
       {S('avg(l_extendedprice)')} AS avg_l_extendedprice
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_child_aggregates(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    c = feat.child_features(o, _li(spark, sf), "o_orderkey", "l_orderkey", ["l_quantity", "l_extendedprice"],
                            aggs=("sum", "avg"))
    return c.select("o_orderkey", F.col("n_children"), sig_col("sum_l_quantity").alias("sum_l_quantity"),
                    sig_col("avg_l_extendedprice").alias("avg_l_extendedprice"))


# =========================================================== sources
@register("profile_lineitem", f"""
SELECT * FROM (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", "
    f"{S(f'min({c})')} AS \"min\", {S(f'max({c})')} AS \"max\", {S(f'avg({c})')} AS mean, {S(f'stddev_samp({c})')} AS sd FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")")
def q_profile_lineitem(spark, sf):
    p = prof.profile(_li(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], exact_distinct=True)
    return p.select("column", "n", "nulls", "distinct", *[sig_col(c).alias(c) for c in ("min", "max", "mean", "sd")])


@register("constraint_violations", """
SELECT * FROM (VALUES ('quantity_1_50', 0), ('discount_0_0.1', 1), ('returnflag_set', 2), ('shipdate_not_null', 3)) r(rule, i)
JOIN (SELECT count(*) AS n,
  sum(CASE WHEN l_quantity BETWEEN 1 AND 50 THEN 0 ELSE 1 END) AS v0,
  sum(CASE WHEN l_discount BETWEEN 0 AND 0.1 THEN 0 ELSE 1 END) AS v1,
  sum(CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN 0 ELSE 1 END) AS v2,
  sum(CASE WHEN l_shipdate IS NOT NULL THEN 0 ELSE 1 END) AS v3 FROM lineitem) ON TRUE
""".replace("SELECT * FROM (VALUES", "SELECT rule, CAST(CASE i WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END AS BIGINT)"
            " AS violations, n FROM (VALUES"))
def q_constraint_violations(spark, sf):
    return prof.check(_li(spark, sf), {
        "quantity_1_50": prof.in_range("l_quantity", 1, 50), "discount_0_0.1": prof.in_range("l_discount", 0, 0.1),
        "returnflag_set": prof.in_set("l_returnflag", ["A", "N", "R"]), "shipdate_not_null": prof.not_null("l_shipdate")})


@register("csv_source_ols", O["ols_coefficients"])
def q_csv_source_ols(spark, sf):
    out = stream.scratch(spark, "lineitem-csv") + ".csv"
    _li(spark, sf).select("l_extendedprice", "l_quantity").write.option("header", True).csv(out)
    from .sources.scan import scan
    d = scan(spark, out, "auto", schema="l_extendedprice double, l_quantity double")
    fit = ols(d, "l_extendedprice", ["l_quantity"])
    return fit.coefficients(spark).select("term", "coefficient", "se", "t_stat")


@register("sql_source_ols", f"""
WITH {ols1_cte("(SELECT l_extendedprice, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
               'l_extendedprice', 'o_totalprice')}, f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(s2 * (1.0 / n + xbar * xbar / sxx))')} AS se FROM f
UNION ALL SELECT 'o_totalprice', {S('b1')}, {S('sqrt(s2 / sxx)')} FROM f""")
def q_sql_source_ols(spark, sf):
    from .sources.scan import register_tables, scan
    register_tables(spark, sf, ["lineitem", "orders"])
    d = scan(spark, "", sql_query="SELECT l_extendedprice, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    fit = ols(d, "l_extendedprice", ["o_totalprice"])
    return fit.coefficients(spark).select("term", "coefficient", "se")


@register("registry_roundtrip")
def q_registry_roundtrip(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    fp = reg.dataset_fingerprint(li, ["l_extendedprice", "l_quantity"], "l_shipdate")
    mid = reg.make_model_id("lineitem price", "ols", fp["hash"])
    path = stream.scratch(spark, "registry")
    reg.save_model(spark, fit, mid, fp, {"r_squared": fit.r2}, {"se_type": "nonrobust"}, path=path)
    row = reg.load_model(spark, mid, path)
    pred = li.select(reg.score_expression(row).alias("prediction"))
    reg.write_predictions(pred, path + "-predictions", mid)
    back = spark.read.parquet(path + "-predictions")
    ids = reg.load_registry(spark, path).select("model_id", F.col("model_id").rlike(reg.MODEL_ID_RE).alias("valid_id"))
    return back.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_predictions"),
                                        sig_col(F.avg("prediction")).alias("mean_prediction")).join(ids, "model_id")


# ============================================================ report
@register("resid_vs_fitted_bins", DECILES_SQL.replace(
    "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, b0 + b1 * l_quantity AS p FROM lineitem, s",
    "l_extendedprice - (b0 + b1 * l_quantity) AS y, b0 + b1 * l_quantity AS p FROM lineitem, s").replace(
    LPM_SQL, ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')) + f"""
SELECT CAST(bin AS INTEGER) AS bin, n, {S('mean_pred')} AS mean_fitted, {S('obs_rate')} AS mean_resid FROM cal""")
def q_resid_vs_fitted_bins(spark, sf):
    li = _li(spark, sf)
    r = rep.resid_vs_fitted(li, ols(li, "l_extendedprice", ["l_quantity"]), 10)
    return r.select(F.col("bin").cast("int").alias("bin"), "n", sig_col("mean_fitted").alias("mean_fitted"),
                    sig_col("mean_resid").alias("mean_resid"))


@register("resid_histogram", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
r AS (SELECT l_extendedprice - (b0 + b1 * l_quantity) AS e FROM lineitem, s),
m AS (SELECT min(e) AS lo, max(e) AS hi FROM r)
SELECT CAST(least(floor((e - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS count FROM r, m GROUP BY 1""")
def q_resid_histogram(spark, sf):
    li = _li(spark, sf)
    h = rep.resid_histogram(li, ols(li, "l_extendedprice", ["l_quantity"]), 30)
    return h.select("bin", "count")


@register("report_record")
def q_report_record(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity", "l_discount"])
    tests = [diag.breusch_pagan(li, fit), diag.jarque_bera(li, fit)]
    s = diag.summary(tests)
    parts = {"fit": [(m, v) for m, v in fit.stat_rows()],
             "tests": [(t[0], t[1], t[4]) for t in tests],
             "summary": [("overall", None, s["overall"]), ("confidence_adjustment", s["confidence_adjustment"])],
             "verdict": [("fit_quality", fit.r2, rep.fit_verdict(fit.r2, fit.n))]}
    return rep.report_record(spark, "lineitem_ols", parts)


# ============================================================= trees
@register("forest_importance")
def q_forest_importance(spark, sf):
    li = _li(spark, sf)
    m = trees.train_tree_model(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "forest",
                               numTrees=20, maxDepth=5)
    return spark.createDataFrame([(f, sig(v)) for f, v in trees.importance(m, ["l_quantity", "l_discount", "l_tax"])],
                                 "feature string, importance double")


@register("gbt_classifier_auc")
def q_gbt_classifier_auc(spark, sf):
    d = _binary_li(spark, sf)
    m = trees.train_tree_model(d, "is_r", ["l_quantity", "l_discount", "status_f"], "gbt", "classification", maxIter=10)
    return metrics_df(spark, list(trees.evaluate_tree(m, d, "is_r", "classification").items()))


# ================================================= diagnostics (more)
@register("ljung_box_events", f"""
WITH m AS (SELECT avg(value) AS mu, count(*) AS n FROM events),
d AS (SELECT sum((value - mu) * (value - mu)) AS den FROM events, m),
l AS (SELECT value, lag(value, 1) OVER (ORDER BY ts, event_id) AS l1, lag(value, 2) OVER (ORDER BY ts, event_id) AS l2 FROM events),
r AS (SELECT sum((value - mu) * (l1 - mu)) / any_value(den) AS r1, sum(CASE WHEN l2 IS NOT NULL THEN (value - mu) * (l2 - mu) END)
      / any_value(den) AS r2, any_value(n) AS n FROM l, m, d),
q AS (SELECT n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)) AS q FROM r)
SELECT 'ljung_box' AS test, {S('q')} AS statistic, CAST(2.0 AS DOUBLE) AS df, {S('exp(-q / 2)')} AS p_value, {flag_sql('exp(-q / 2)')} AS flag FROM q""")
def q_ljung_box_events(spark, sf):
    return tests_df(spark, [diag.ljung_box(_ev(spark, sf), "value", EV_ORDER, 2)])


@register("sparse_cells_segment", f"""
SELECT c_mktsegment, count(*) AS n, {S('count(*) / sum(count(*)) OVER ()')} AS share,
       count(*) / sum(count(*)) OVER () < 0.05 AS sparse FROM customer GROUP BY 1""")
def q_sparse_cells_segment(spark, sf):
    s = diag.sparse_cells(load(spark, sf, "customer"), "c_mktsegment", 0.05)
    return s.select("c_mktsegment", "n", sig_col("share").alias("share"), "sparse")


@register("deviance_by_status", f"""WITH {SAT_CELLS},
r AS (SELECT CAST(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS status_f, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y,
      CASE WHEN l_linestatus = 'F' THEN n11 / (n11 + n01) ELSE n10 / (n10 + n00) END AS p FROM lineitem, f)
SELECT status_f, count(*) AS n, {S('sum(-2 * (y * ln(p) + (1 - y) * ln(1 - p)))')} AS deviance,
       {S('sum((y - p) * (y - p) / (p * (1 - p)))')} AS pearson_chi2 FROM r GROUP BY status_f""")
def q_deviance_by_status(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["status_f"])
    t = diag.deviance_table(d, "is_r", probability(fit), "binomial", by=["status_f"])
    return t.select("status_f", "n", sig_col("deviance").alias("deviance"), sig_col("pearson_chi2").alias("pearson_chi2"))


RESET_SQL = f"""
WITH {ols2_cte('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount')},
h AS (SELECT l_extendedprice AS y, l_quantity AS v0, l_discount AS v1, b0 + b1 * l_quantity + b2 * l_discount AS yh, ssr AS ssr_r
      FROM lineitem, t_f),
hs AS (SELECT avg(yh) AS mu, stddev_pop(yh) AS sd FROM h),
z AS (SELECT y, v0, v1, pow((yh - mu) / sd, 2) AS v2, pow((yh - mu) / sd, 3) AS v3, ssr_r FROM h, hs),
c AS (SELECT count(*) AS n, var_pop(y) * count(*) AS syy, any_value(ssr_r) AS ssr_r, covar_pop(v0, v0) * count(*) AS c00, covar_pop(v0, v1) * count(*) AS c01, covar_pop(v0, v2) * count(*) AS c02, covar_pop(v0, v3) * count(*) AS c03, covar_pop(v1, v1) * count(*) AS c11, covar_pop(v1, v2) * count(*) AS c12, covar_pop(v1, v3) * count(*) AS c13, covar_pop(v2, v2) * count(*) AS c22, covar_pop(v2, v3) * count(*) AS c23, covar_pop(v3, v3) * count(*) AS c33, covar_pop(v0, y) * count(*) AS c0y, covar_pop(v1, y) * count(*) AS c1y, covar_pop(v2, y) * count(*) AS c2y, covar_pop(v3, y) * count(*) AS c3y FROM z),
d AS (SELECT *, (+ (c00) * (+ (c11) * ((c22) * (c33) - (c23) * (c23)) - (c12) * ((c12) * (c33) - (c23) * (c13)) + (c13) * ((c12) * (c23) - (c22) * (c13))) - (c01) * (+ (c01) * ((c22) * (c33) - (c23) * (c23)) - (c12) * ((c02) * (c33) - (c23) * (c03)) + (c13) * ((c02) * (c23) - (c22) * (c03))) + (c02) * (+ (c01) * ((c12) * (c33) - (c23) * (c13)) - (c11) * ((c02) * (c33) - (c23) * (c03)) + (c13) * ((c02) * (c13) - (c12) * (c03))) - (c03) * (+ (c01) * ((c12) * (c23) - (c22) * (c13)) - (c11) * ((c02) * (c23) - (c22) * (c03)) + (c12) * ((c02) * (c13) - (c12) * (c03)))) AS dt FROM c),
b AS (SELECT *, (+ (c0y) * (+ (c11) * ((c22) * (c33) - (c23) * (c23)) - (c12) * ((c12) * (c33) - (c23) * (c13)) + (c13) * ((c12) * (c23) - (c22) * (c13))) - (c01) * (+ (c1y) * ((c22) * (c33) - (c23) * (c23)) - (c12) * ((c2y) * (c33) - (c23) * (c3y)) + (c13) * ((c2y) * (c23) - (c22) * (c3y))) + (c02) * (+ (c1y) * ((c12) * (c33) - (c23) * (c13)) - (c11) * ((c2y) * (c33) - (c23) * (c3y)) + (c13) * ((c2y) * (c13) - (c12) * (c3y))) - (c03) * (+ (c1y) * ((c12) * (c23) - (c22) * (c13)) - (c11) * ((c2y) * (c23) - (c22) * (c3y)) + (c12) * ((c2y) * (c13) - (c12) * (c3y)))) / dt AS b0, (+ (c00) * (+ (c1y) * ((c22) * (c33) - (c23) * (c23)) - (c12) * ((c2y) * (c33) - (c23) * (c3y)) + (c13) * ((c2y) * (c23) - (c22) * (c3y))) - (c0y) * (+ (c01) * ((c22) * (c33) - (c23) * (c23)) - (c12) * ((c02) * (c33) - (c23) * (c03)) + (c13) * ((c02) * (c23) - (c22) * (c03))) + (c02) * (+ (c01) * ((c2y) * (c33) - (c23) * (c3y)) - (c1y) * ((c02) * (c33) - (c23) * (c03)) + (c13) * ((c02) * (c3y) - (c2y) * (c03))) - (c03) * (+ (c01) * ((c2y) * (c23) - (c22) * (c3y)) - (c1y) * ((c02) * (c23) - (c22) * (c03)) + (c12) * ((c02) * (c3y) - (c2y) * (c03)))) / dt AS b1, (+ (c00) * (+ (c11) * ((c2y) * (c33) - (c23) * (c3y)) - (c1y) * ((c12) * (c33) - (c23) * (c13)) + (c13) * ((c12) * (c3y) - (c2y) * (c13))) - (c01) * (+ (c01) * ((c2y) * (c33) - (c23) * (c3y)) - (c1y) * ((c02) * (c33) - (c23) * (c03)) + (c13) * ((c02) * (c3y) - (c2y) * (c03))) + (c0y) * (+ (c01) * ((c12) * (c33) - (c23) * (c13)) - (c11) * ((c02) * (c33) - (c23) * (c03)) + (c13) * ((c02) * (c13) - (c12) * (c03))) - (c03) * (+ (c01) * ((c12) * (c3y) - (c2y) * (c13)) - (c11) * ((c02) * (c3y) - (c2y) * (c03)) + (c1y) * ((c02) * (c13) - (c12) * (c03)))) / dt AS b2, (+ (c00) * (+ (c11) * ((c22) * (c3y) - (c2y) * (c23)) - (c12) * ((c12) * (c3y) - (c2y) * (c13)) + (c1y) * ((c12) * (c23) - (c22) * (c13))) - (c01) * (+ (c01) * ((c22) * (c3y) - (c2y) * (c23)) - (c12) * ((c02) * (c3y) - (c2y) * (c03)) + (c1y) * ((c02) * (c23) - (c22) * (c03))) + (c02) * (+ (c01) * ((c12) * (c3y) - (c2y) * (c13)) - (c11) * ((c02) * (c3y) - (c2y) * (c03)) + (c1y) * ((c02) * (c13) - (c12) * (c03))) - (c0y) * (+ (c01) * ((c12) * (c23) - (c22) * (c13)) - (c11) * ((c02) * (c23) - (c22) * (c03)) + (c12) * ((c02) * (c13) - (c12) * (c03)))) / dt AS b3 FROM d),
f AS (SELECT *, syy - (b0 * c0y + b1 * c1y + b2 * c2y + b3 * c3y) AS ssr_u FROM b),
t AS (SELECT ((ssr_r - ssr_u) / 2) / (ssr_u / (n - 5)) AS fs, n - 5 AS dd FROM f)
SELECT 'reset' AS test, {S('fs')} AS statistic, CAST(2.0 AS DOUBLE) AS df, {S('pow(1 + 2 * fs / dd, -dd / 2.0)')} AS p_value,
       {flag_sql('pow(1 + 2 * fs / dd, -dd / 2.0)')} AS flag FROM t"""


@register("reset_test", RESET_SQL)
def q_reset_test(spark, sf):
    li = _li(spark, sf)
    return tests_df(spark, [diag.reset(li, ols(li, "l_extendedprice", ["l_quantity", "l_discount"]))])


@register("linktest_logit")
def q_linktest_logit(spark, sf):
    d = _binary_li(spark, sf)
    return tests_df(spark, [diag.linktest(d, logit(d, "is_r", ["l_quantity", "l_discount"]), "logit")])


@register("brant_priority")
def q_brant_priority(spark, sf):
    r = diag.brant(load(spark, sf, "orders"), "o_orderpriority", ["o_totalprice"])
    return tests_df(spark, [("brant", sig(r["brant_stat"]), float(r["df"]), sig(r["p_value"]), diag.flag_p(r["p_value"]))])



def _acklam_sql(p: str) -> str:
    """Inverse-normal start as SQL (same fixed constants as the Spark column)."""
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)

    def poly(cs, x):
        acc = repr(cs[0])
        for v in cs[1:]:
            acc = f"({acc}) * {x} + {v!r}"
        return acc
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    central = f"({poly(a, r)}) * {q} / (({poly(b, r)}) * {r} + 1.0)"
    ql = f"sqrt(-2.0 * ln({p}))"
    low = f"({poly(c, ql)}) / (({poly(d, ql)}) * {ql} + 1.0)"
    qh = f"sqrt(-2.0 * ln(1.0 - {p}))"
    high = f"-({poly(c, qh)}) / (({poly(d, qh)}) * {qh} + 1.0)"
    return f"(CASE WHEN {p} < 0.02425 THEN {low} WHEN {p} > {1 - 0.02425!r} THEN {high} ELSE {central} END)"


def _sw_sql() -> str:
    p = "((i - 0.375) / (n + 0.25))"
    m0 = _acklam_sql(p)
    cdf = "(1.0 - " + norm_sf_sql("m0") + ")"
    u = "(1.0 / sqrt(CAST(n AS DOUBLE)))"
    an = (f"mn / sqrt(ssq) + 0.221157 * {u} - 0.147981 * pow({u}, 2) - 2.07119 * pow({u}, 3) + 4.434685 * pow({u}, 4)"
          f" - 2.706056 * pow({u}, 5)")
    an1 = (f"mn1 / sqrt(ssq) + 0.042981 * {u} - 0.293762 * pow({u}, 2) - 1.752461 * pow({u}, 3) + 5.682633 * pow({u}, 4)"
           f" - 3.582633 * pow({u}, 5)")
    ln = "ln(CAST(n AS DOUBLE))"
    z = (f"(CASE WHEN n >= 12 THEN (ln(1.0 - w) - (0.0038915 * pow({ln}, 3) - 0.083751 * pow({ln}, 2) - 0.31082 * {ln} - 1.5861))"
         f" / exp(0.0030302 * pow({ln}, 2) - 0.082676 * {ln} - 0.4803) ELSE (-ln((-2.273 + 0.459 * n) - ln(1.0 - w))"
         f" - (0.544 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n)) / exp(1.3822 - 0.77857 * n + 0.062767 * n * n"
         f" - 0.0020322 * n * n * n) END)")
    return f"""
WITH sz AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT e.event_type, value AS x, row_number() OVER (PARTITION BY e.event_type ORDER BY value) AS i, n
      FROM events e JOIN sz USING (event_type) WHERE n >= 4),
r0 AS (SELECT *, {m0} AS m0 FROM r),
r1 AS (SELECT *, m0 - ({cdf} - {p}) * {math.sqrt(2 * math.pi)!r} * exp(m0 * m0 / 2) AS m FROM r0),
sg AS (SELECT event_type, any_value(n) AS n, sum(m * m) AS ssq, max_by(m, i) AS mn,
       max(CASE WHEN i = n - 1 THEN m END) AS mn1 FROM r1 GROUP BY 1),
sa AS (SELECT *, {an} AS an, {an1} AS an1 FROM sg),
sp AS (SELECT *, CASE WHEN n > 5 THEN (ssq - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)
       ELSE (ssq - 2 * mn * mn) / (1 - 2 * an * an) END AS phi FROM sa),
wa AS (SELECT r1.event_type, r1.x, CASE WHEN i = r1.n THEN an WHEN i = 1 THEN -an WHEN i = r1.n - 1 AND r1.n > 5 THEN an1
       WHEN i = 2 AND r1.n > 5 THEN -an1 ELSE m / sqrt(phi) END AS a FROM r1 JOIN sp USING (event_type)),
st AS (SELECT event_type, count(*) AS n, sum(a * x) AS num, var_pop(x) AS v FROM wa GROUP BY 1),
ww AS (SELECT *, least(num * num / (v * n), 1.0) AS w FROM st),
zz AS (SELECT *, {z} AS z FROM ww)
SELECT event_type, n, {S('w')} AS W, {S(norm_sf_sql('z'))} AS p_value FROM zz"""


def _ppf_step(src: str, ps: dict[str, str], name: str) -> str:
    """CTEs that add inverse-normal columns: the rational start and one Newton step on the cdf."""
    start = ", ".join(f"{_acklam_sql(p)} AS {c}_0" for c, p in ps.items())
    step = ", ".join(f"{c}_0 - ((1.0 - {norm_sf_sql(f'{c}_0')}) - ({p})) * {math.sqrt(2 * math.pi)!r} * exp({c}_0 * {c}_0 / 2) AS {c}"
                     for c, p in ps.items())
    return f"{name}_s AS (SELECT *, {start} FROM {src}), {name} AS (SELECT *, {step} FROM {name}_s)"


def _phi2(z: str) -> str:
    return f"(exp(-{z} * {z}) / (2 * {math.pi!r}))"


@register("probit_saturated", f"""WITH {SAT_CELLS},
r AS (SELECT *, n10 / (n10 + n00) AS p0, n11 / (n11 + n01) AS p1 FROM c), {_ppf_step('r', {'z0': 'p0', 'z1': 'p1'}, 'z')},
g AS (SELECT z0 AS b0, z1 - z0 AS b1, p0 * (1 - p0) / ((n10 + n00) * {_phi2('z0')}) AS v00,
      p0 * (1 - p0) / ((n10 + n00) * {_phi2('z0')}) + p1 * (1 - p1) / ((n11 + n01) * {_phi2('z1')}) AS v11 FROM z)
""" + _coef_sql([("const", "b0", "sqrt(v00)"), ("status_f", "b1", "sqrt(v11)")], "g"))
def q_probit_saturated(spark, sf):
    return disc.probit(_binary_li(spark, sf), "is_r", ["status_f"]).coefficients(spark)


@register("ordered_probit_null", f"""
WITH c AS (SELECT o_orderpriority AS lvl, CAST(count(*) AS DOUBLE) AS k FROM orders GROUP BY 1),
q AS (SELECT lvl, sum(k) OVER (ORDER BY lvl ROWS UNBOUNDED PRECEDING) / sum(k) OVER () AS fc,
      lead(lvl) OVER (ORDER BY lvl) AS nxt, sum(k) OVER () AS n FROM c),
qq AS (SELECT * FROM q WHERE nxt IS NOT NULL), {_ppf_step('qq', {'tau': 'fc'}, 't')}
SELECT 'cut_' || lvl || '|' || nxt AS term, {S('tau')} AS coefficient, {S(f"sqrt(fc * (1 - fc) / (n * {_phi2('tau')}))")} AS se FROM t""")
def q_ordered_probit_null(spark, sf):
    """D4 without features: the cut points are normal quantiles of the cumulative shares."""
    fit = ordered(load(spark, sf, "orders"), "o_orderpriority", [], "probit")
    return fit.coefficients(spark).select("term", "coefficient", "se")


@register("lasso_one_feature", f"""
WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) AS c, stddev_pop(l_quantity) AS sd, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem),
b AS (SELECT *, sign(c) * greatest(abs(c / sd) - 1000.0, 0.0) / sd AS b1 FROM m)
SELECT 'const' AS term, {S('my - b1 * mx')} AS coefficient FROM b UNION ALL SELECT 'l_quantity', {S('b1')} FROM b""")
def q_lasso_one_feature(spark, sf):
    """One feature, where LASSO is a soft threshold."""
    b = ev.lasso(_li(spark, sf), "l_extendedprice", ["l_quantity"], lam=1000.0)
    return spark.createDataFrame([(t, sig(v)) for t, v in zip(["const", "l_quantity"], b)], "term string, coefficient double")


@register("shapiro_wilk_by_type", _sw_sql())
def q_shapiro_wilk_by_type(spark, sf):
    s = diag.shapiro_wilk(_ev(spark, sf), "value", "event_type")
    return s.select("event_type", "n", sig_col("W").alias("W"), sig_col("p_value").alias("p_value"))


WOOLDRIDGE_SQL = f"""
WITH l AS (SELECT l_suppkey AS g, l_extendedprice - lag(l_extendedprice) OVER w AS dy, l_quantity - lag(l_quantity) OVER w AS dx,
           row_number() OVER w AS rn
           FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_shipdate, l_extendedprice)),
b AS (SELECT sum(dx * dy) / sum(dx * dx) AS bfd FROM l WHERE dy IS NOT NULL),
e AS (SELECT g, rn, dy - bfd * dx AS e FROM l, b WHERE dy IS NOT NULL),
el AS (SELECT g, e, lag(e) OVER (PARTITION BY g ORDER BY rn) AS el FROM e),
x AS (SELECT * FROM el WHERE el IS NOT NULL),
r AS (SELECT sum(e * el) / sum(el * el) AS rho, sum(el * el) AS sll FROM x),
u AS (SELECT g, sum(el * (e - rho * el)) AS ug FROM x, r GROUP BY g),
f AS (SELECT rho, sqrt(sum(ug * ug)) / any_value(sll) AS se FROM u, r GROUP BY rho)
SELECT {S('rho')} AS rho, {S('pow((rho + 0.5) / se, 2)')} AS f_stat FROM f"""


@register("wooldridge_serial_panel", WOOLDRIDGE_SQL)
def q_wooldridge_serial_panel(spark, sf):
    r = panel.wooldridge_ac(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey", LI_ORDER)
    return local_table(spark, [(sig(r["rho"]), sig(r["f_stat"]))], "rho double, f_stat double")


@register("vuong_logit_probit")
def q_vuong_logit_probit(spark, sf):
    d = _binary_li(spark, sf)
    f1 = logit(d, "is_r", ["l_quantity", "l_discount"])
    f2 = disc.probit(d, "is_r", ["l_quantity", "l_discount"])
    y = F.col("is_r")
    ll = lambda p: y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p)
    return tests_df(spark, [diag.vuong(d, ll(probability(f1)), ll(probability(f2)))])


@register("overdispersion_poisson", f"""
WITH d AS (SELECT CAST(count(*) AS DOUBLE) AS y, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS x
           FROM events GROUP BY user_id, event_type),
m AS (SELECT x, avg(y) AS mu FROM d GROUP BY x),
r AS (SELECT y, mu, pow(y - mu, 2) / mu AS p, (pow(y - mu, 2) - y) / mu AS z FROM d JOIN m USING (x)),
a AS (SELECT count(*) AS n, sum(p) AS x2, sum(z * mu) AS zm, sum(mu * mu) AS mm, sum(z * z) AS zz FROM r),
b AS (SELECT *, zm / mm AS slope FROM a)
SELECT 'pearson_dispersion' AS test, {S('x2 / (n - 2)')} AS statistic, CAST(n - 2 AS DOUBLE) AS df FROM b
UNION ALL SELECT 'cameron_trivedi', {S('slope / sqrt((zz - slope * zm) / (n - 1) / mm)')}, CAST(n - 1 AS DOUBLE) FROM b""")
def q_overdispersion_poisson(spark, sf):
    d = _ev(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n_events")) \
        .withColumn("is_click", (F.col("event_type") == "click").cast("double"))
    fit = poisson(d, "n_events", ["is_click"])
    return tests_df(spark, diag.overdispersion(d, "n_events", probability(fit), fit.k)).select("test", "statistic", "df")


@register("sample_size_and_cutpoints")
def q_sample_size_and_cutpoints(spark, sf):
    o = load(spark, sf, "orders")
    fit = ordered(o, "o_orderpriority", ["o_totalprice"], "logit")
    counts = [r["n"] for r in diag.sparse_cells(o, "o_orderpriority").collect()]
    rows = diag.sample_size_check(fit.n, fit.k, min_class=min(counts))
    rows.append(("cutpoints_monotone", float(diag.cutpoints_monotone(list(fit.theta[1:]))), 1.0, "PASS"))
    return spark.createDataFrame(rows, "rule string, value double, threshold double, flag string")


# ================================================= models (more)
@register("probit_fit")
def q_probit_fit(spark, sf):
    return disc.probit(_binary_li(spark, sf), "is_r", ["l_quantity", "l_discount"]).coefficients(spark)


@register("ordered_probit_priority")
def q_ordered_probit_priority(spark, sf):
    return ordered(load(spark, sf, "orders"), "o_orderpriority", ["o_totalprice"], "probit").coefficients(spark)


@register("negbin_counts")
def q_negbin_counts(spark, sf):
    d = _ev(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n_events")) \
        .withColumn("is_click", (F.col("event_type") == "click").cast("double"))
    fit = disc.negbin(d, "n_events", ["is_click"])
    return fit.coefficients(spark).unionByName(spark.createDataFrame(
        [("alpha", sig(fit.extra["alpha"]), None, None, None, None, None)], fit.coefficients(spark).schema))


@register("tobit_discount")
def q_tobit_discount(spark, sf):
    return disc.tobit(_li(spark, sf), "l_discount", ["l_quantity"], lower=0.0).coefficients(spark)


@register("heckman_two_step")
def q_heckman_two_step(spark, sf):
    r = disc.heckman(_binary_li(spark, sf), "l_extendedprice", ["l_quantity"], "status_f", ["l_discount"])
    return r["outcome"].coefficients(spark)


@register("clogit_orders")
def q_clogit_orders(spark, sf):
    return disc.clogit(_binary_li(spark, sf), "is_r", ["l_quantity", "l_discount"], "l_orderkey").coefficients(spark)


@register("gologit_priority")
def q_gologit_priority(spark, sf):
    d = load(spark, sf, "orders").withColumn("status_f", (F.col("o_orderstatus") == "F").cast("double"))
    return disc.gologit(d, "o_orderpriority", ["o_totalprice", "status_f"], ["status_f"]).coefficients(spark)


@register("zip_discount_points")
def q_zip_discount_points(spark, sf):
    d = _li(spark, sf).withColumn("disc_points", F.round(F.col("l_discount") * 100))
    fit = zero_inflated(d, "disc_points", ["l_quantity"], ["l_tax"])
    rows = [(t, sig(b)) for t, b in zip(fit.terms, fit.theta)] + [("llf", sig(fit.llf))]
    return spark.createDataFrame(rows, "term string, value double")


def _nc2_sql(src: str, c: str, x: str, y: str) -> str:
    """term/coefficient/se/t_stat of a no-intercept regression of y on (c, x) by Cramer's rule."""
    return f"""z AS (SELECT sum({c} * {c}) AS a, sum({c} * {x}) AS b, sum({x} * {x}) AS d, sum({c} * {y}) AS u,
      sum({x} * {y}) AS v, sum({y} * {y}) AS yy, count(*) AS n FROM {src}),
zb AS (SELECT *, a * d - b * b AS det FROM z),
zc AS (SELECT *, (d * u - b * v) / det AS bc, (a * v - b * u) / det AS bx FROM zb),
zs AS (SELECT *, (yy - bc * u - bx * v) / (n - 2) AS s2 FROM zc)"""


def _nc2_select(xname: str) -> str:
    return (f"SELECT 'const' AS term, {S('bc')} AS coefficient, {S('sqrt(s2 * d / det)')} AS se, "
            f"{S('bc / sqrt(s2 * d / det)')} AS t_stat FROM zs UNION ALL SELECT '{xname}', {S('bx')}, "
            f"{S('sqrt(s2 * a / det)')}, {S('bx / sqrt(s2 * a / det)')} FROM zs")


@register("gls_ar1_events", f"""
WITH {ols1_cte('events', 'value', 'user_id')},
r AS (SELECT value AS y, user_id AS x, value - (b0 + b1 * user_id) AS e, ts, event_id FROM events, s),
l AS (SELECT y, x, e, lag(y) OVER w AS yl, lag(x) OVER w AS xl, lag(e) OVER w AS el FROM r WINDOW w AS (ORDER BY ts, event_id)),
rh AS (SELECT greatest(least(sum(e * el) / sum(el * el), 0.999999), -0.999999) AS rho FROM l WHERE el IS NOT NULL),
t AS (SELECT CASE WHEN yl IS NULL THEN sqrt(1 - rho * rho) ELSE 1 - rho END AS c,
      CASE WHEN yl IS NULL THEN sqrt(1 - rho * rho) * y ELSE y - rho * yl END AS ty,
      CASE WHEN yl IS NULL THEN sqrt(1 - rho * rho) * x ELSE x - rho * xl END AS tx FROM l, rh),
{_nc2_sql('t', 'c', 'tx', 'ty')}
{_nc2_select('user_id')} UNION ALL SELECT 'rho', {S('rho')}, NULL, NULL FROM rh""")
def q_gls_ar1_events(spark, sf):
    fit = lin.gls_ar1(_ev(spark, sf), "value", ["user_id"], EV_ORDER)
    t = fit.coefficients(spark).select("term", "coefficient", "se", "t_stat")
    return t.unionByName(spark.createDataFrame([("rho", sig(fit.rho), None, None)], t.schema))


@register("gls_block_equicorrelated", f"""
WITH g AS (SELECT l_suppkey, count(*) AS ng, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem GROUP BY 1),
th AS (SELECT l_suppkey, 1 - sqrt(0.9 / (0.9 + ng * 0.1)) AS theta, my, mx FROM g),
t AS (SELECT 1 - theta AS c, l_extendedprice - theta * my AS ty, l_quantity - theta * mx AS tx
      FROM lineitem JOIN th USING (l_suppkey)),
{_nc2_sql('t', 'c', 'tx', 'ty')}
{_nc2_select('l_quantity')}""")
def q_gls_block_equicorrelated(spark, sf):
    fit = lin.gls_equicorrelated(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey", 0.1)
    return fit.coefficients(spark).select("term", "coefficient", "se", "t_stat")


@register("irr_poisson", f"""
WITH d AS (SELECT CAST(count(*) AS DOUBLE) AS y, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS x
           FROM events GROUP BY user_id, event_type),
c AS (SELECT sum(CASE WHEN x = 0 THEN y END) AS s0, sum(CASE WHEN x = 1 THEN y END) AS s1,
      CAST(sum(1 - x) AS DOUBLE) AS m0, CAST(sum(x) AS DOUBLE) AS m1 FROM d),
f AS (SELECT ln((s1 / m1) / (s0 / m0)) AS b1, sqrt(1.0 / s1 + 1.0 / s0) AS se FROM c)
SELECT 'is_click' AS term, {S('exp(b1)')} AS ratio, {S(f'exp(b1 - {Z975!r} * se)')} AS ci_lower,
       {S(f'exp(b1 + {Z975!r} * se)')} AS ci_upper FROM f""")
def q_irr_poisson(spark, sf):
    d = _ev(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n_events")) \
        .withColumn("is_click", (F.col("event_type") == "click").cast("double"))
    return poisson(d, "n_events", ["is_click"]).odds_ratios(spark)


@register("predict_logit_ci", f"""WITH {SAT_CELLS},
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS x FROM lineitem),
e AS (SELECT r.*, b0 + b1 * x AS eta, sqrt(v00 - 2 * x * v00 + x * x * v11) AS se FROM r, f)
SELECT l_orderkey, l_linenumber, {S('1.0 / (1.0 + exp(-eta))')} AS prediction, {S('se')} AS se_link,
  {S(f'1.0 / (1.0 + exp(-(eta - {Z975!r} * se)))')} AS ci_lower, {S(f'1.0 / (1.0 + exp(-(eta + {Z975!r} * se)))')} AS ci_upper FROM e""")
def q_predict_logit_ci(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["status_f"])
    p = score.predict_discrete(fit, d, interval=True, keep=["l_orderkey", "l_linenumber"])
    return p.select("l_orderkey", "l_linenumber", *[sig_col(c).alias(c) for c in ("prediction", "se_link", "ci_lower", "ci_upper")])


@register("predict_skips_missing", f"""
WITH {ols1_cte('(SELECT l_extendedprice, nullif(l_discount, 0.0) AS d FROM lineitem)', 'l_extendedprice', 'd')}
SELECT count(*) FILTER (WHERE nullif(l_discount, 0.0) IS NOT NULL) AS predicted,
       count(*) FILTER (WHERE nullif(l_discount, 0.0) IS NULL) AS skipped,
       {S('avg(b0 + b1 * nullif(l_discount, 0.0))')} AS mean_prediction FROM lineitem, s""")
def q_predict_skips_missing(spark, sf):
    from pyspark.sql import Observation
    d = _li(spark, sf).withColumn("d", F.when(F.col("l_discount") != 0.0, F.col("l_discount")))
    fit = ols(d, "l_extendedprice", ["d"])
    obs = Observation("skipped")
    p = score.predict_linear(fit, d, observation=obs)
    r = p.agg(F.count(F.lit(1)).alias("predicted"), F.avg("prediction").alias("m")).collect()[0]
    skipped = obs.get["skipped"]
    return spark.createDataFrame([(int(r["predicted"]), int(skipped), sig(r["m"]))],
                                 "predicted bigint, skipped bigint, mean_prediction double")


# ================================================== evaluation (more)
@register("class_report_mnlogit", f"""
WITH d AS (SELECT c_mktsegment AS y, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS x FROM customer),
m AS (SELECT x, arg_max(y, k) AS pred FROM (SELECT x, y, count(*) AS k FROM d GROUP BY x, y) GROUP BY x),
c AS (SELECT y AS actual, pred AS predicted, count(*) AS n FROM d JOIN m USING (x) GROUP BY y, pred),
cls AS (SELECT actual AS cls FROM c UNION SELECT predicted FROM c),
t AS (SELECT cls, coalesce((SELECT sum(n) FROM c WHERE actual = cls AND predicted = cls), 0) AS tp,
      coalesce((SELECT sum(n) FROM c WHERE actual = cls), 0) AS support,
      coalesce((SELECT sum(n) FROM c WHERE predicted = cls), 0) AS npred FROM cls),
p AS (SELECT cls, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
      CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM t)
SELECT cls, {S('precision')} AS precision, {S('recall')} AS recall,
  {S('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1,
  CAST(support AS BIGINT) AS support FROM p""")
def q_class_report_mnlogit(spark, sf):
    d = load(spark, sf, "customer").withColumn("pos_balance", (F.col("c_acctbal") > 0).cast("double"))
    fit = mnlogit(d, "c_mktsegment", ["pos_balance"])
    labels = F.array(*[F.lit(x) for x in fit.classes])
    p = score.predict_discrete(fit, d, keep=["c_mktsegment"]).withColumn(
        "pred", F.element_at(labels, (F.col("predicted_class") + 1).cast("int")))
    r = ev.class_report(p, "c_mktsegment", "pred")
    return r.select("cls", *[sig_col(c).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long"))


@register("compare_models_ic", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')}, {ols2_cte('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount')},
l AS (SELECT -s.n / 2.0 * (ln(2 * pi()) + ln((s.syy - s.b1 * s.sxy) / s.n) + 1) AS l1,
      -t_f.n / 2.0 * (ln(2 * pi()) + ln(t_f.ssr / t_f.n) + 1) AS l2, s.n AS n FROM s, t_f)
SELECT 'm1' AS model, {S('-2 * l1 + 4')} AS aic, {S('-2 * l1 + 2 * ln(n)')} AS bic, {S('-2 * l1 + 4 * ln(ln(n))')} AS hqic FROM l
UNION ALL SELECT 'm2', {S('-2 * l2 + 6')}, {S('-2 * l2 + 3 * ln(n)')}, {S('-2 * l2 + 6 * ln(ln(n))')} FROM l
UNION ALL SELECT 'lr_m2_vs_m1', {S('2 * (l2 - l1)')}, NULL, NULL FROM l""")
def q_compare_models_ic(spark, sf):
    li = _li(spark, sf)
    m1 = ols(li, "l_extendedprice", ["l_quantity"])
    m2 = ols(li, "l_extendedprice", ["l_quantity", "l_discount"])
    rows = []
    for name, m in (("m1", m1), ("m2", m2)):
        ic = ev.information_criteria(m.llf, m.k, m.n)
        rows.append((name, sig(ic["aic"]), sig(ic["bic"]), sig(ic["hqic"])))
    rows.append(("lr_m2_vs_m1", sig(ev.lr_test(m2.llf, m1.llf, 1)["lr_stat"]), None, None))
    return spark.createDataFrame(rows, "model string, aic double, bic double, hqic double")


@register("ovr_auc_by_flag", f"""
WITH g AS (SELECT cls, l_quantity AS s, sum(CASE WHEN l_returnflag = cls THEN 1.0 ELSE 0.0 END) AS pos,
           sum(CASE WHEN l_returnflag = cls THEN 0.0 ELSE 1.0 END) AS neg
           FROM lineitem, (VALUES ('A'), ('N'), ('R')) v(cls) GROUP BY cls, l_quantity),
c AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY s ROWS UNBOUNDED PRECEDING) AS cn FROM g)
SELECT cls, {S('sum(pos * (cn - 0.5 * neg)) / (sum(pos) * sum(neg))')} AS auc FROM c GROUP BY cls""")
def q_ovr_auc_by_flag(spark, sf):
    li = _li(spark, sf)
    rows = [(c, sig(ev.auc(li, (F.col("l_returnflag") == c).cast("double"), "l_quantity"))) for c in ("A", "N", "R")]
    return spark.createDataFrame(rows, "cls string, auc double")


@register("lasso_fit")
def q_lasso_fit(spark, sf):
    b = ev.lasso(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], lam=0.001)
    return spark.createDataFrame([(t, sig(v)) for t, v in zip(["const", "l_quantity", "l_discount", "l_tax"], b)],
                                 "term string, coefficient double")


@register("bootstrap_632_error")
def q_bootstrap_632_error(spark, sf):
    r = ev.bootstrap_632(_li(spark, sf), "l_extendedprice", ["l_quantity"], LI_ORDER, B=30)
    return metrics_df(spark, [(k, r[k]) for k in ("err_train", "err_oob", "err_632", "err_632_plus", "no_information", "replicates")])


NESTED_CV_SQL = f"""
WITH d AS (SELECT year(l_shipdate) AS o, l_returnflag AS i, l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem),
c AS (SELECT o, i, CAST(count(*) AS DOUBLE) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11,
      sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy FROM d GROUP BY o, i),
lams AS (SELECT CAST(lam AS DOUBLE) AS lam FROM (VALUES (0.0), (10.0), (1000.0)) t(lam)),
oi AS (SELECT DISTINCT a.o AS oo, b.i AS ii FROM c a, c b WHERE b.o <> a.o),
tr AS (SELECT oo, ii, sum(c.n) AS n, sum(c.s1) AS s1, sum(c.s2) AS s2, sum(c.sy) AS sy, sum(c.s11) AS s11, sum(c.s22) AS s22, sum(c.s12) AS s12, sum(c.s1y) AS s1y, sum(c.s2y) AS s2y, sum(c.syy) AS syy FROM oi JOIN c ON c.o <> oi.oo AND c.i <> oi.ii GROUP BY oo, ii),
va AS (SELECT oo, ii, sum(c.n) AS n, sum(c.s1) AS s1, sum(c.s2) AS s2, sum(c.sy) AS sy, sum(c.s11) AS s11, sum(c.s22) AS s22, sum(c.s12) AS s12, sum(c.s1y) AS s1y, sum(c.s2y) AS s2y, sum(c.syy) AS syy FROM oi JOIN c ON c.o <> oi.oo AND c.i = oi.ii GROUP BY oo, ii),
t1 AS (SELECT *, s11 - s1 * s1 / n AS c11, s22 - s2 * s2 / n AS c22, s12 - s1 * s2 / n AS c12,
      s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM tr),
t2 AS (SELECT *, sqrt(c11 / n) AS sd1, sqrt(c22 / n) AS sd2 FROM t1),
t3 AS (SELECT *, (a22 * g1 - a12 * g2) / (a11 * a22 - a12 * a12) / sd1 AS b1,
      (a11 * g2 - a12 * g1) / (a11 * a22 - a12 * a12) / sd2 AS b2 FROM
      (SELECT *, c11 / (sd1 * sd1) + lam AS a11, c22 / (sd2 * sd2) + lam AS a22, c12 / (sd1 * sd2) AS a12,
              c1y / sd1 AS g1, c2y / sd2 AS g2 FROM (SELECT * FROM t2, lams))),
t4 AS (SELECT *, sy / n - b1 * s1 / n - b2 * s2 / n AS b0 FROM t3),
sc AS (SELECT t4.oo, t4.lam, sum((v_syy - 2 * b0 * v_sy - 2 * b1 * v_s1y - 2 * b2 * v_s2y + v_n * b0 * b0 + 2 * b0 * b1 * v_s1 + 2 * b0 * b2 * v_s2 + b1 * b1 * v_s11 + 2 * b1 * b2 * v_s12 + b2 * b2 * v_s22)) AS score FROM t4 JOIN (SELECT oo, ii, n AS v_n, s1 AS v_s1, s2 AS v_s2, sy AS v_sy, s11 AS v_s11, s22 AS v_s22, s12 AS v_s12, s1y AS v_s1y, s2y AS v_s2y, syy AS v_syy FROM va) v
       ON t4.oo = v.oo AND t4.ii = v.ii GROUP BY t4.oo, t4.lam),
best AS (SELECT oo, arg_min(lam, score) AS lam FROM sc GROUP BY oo),
ftr AS (SELECT best.oo, best.lam, sum(c.n) AS n, sum(c.s1) AS s1, sum(c.s2) AS s2, sum(c.sy) AS sy, sum(c.s11) AS s11, sum(c.s22) AS s22, sum(c.s12) AS s12, sum(c.s1y) AS s1y, sum(c.s2y) AS s2y, sum(c.syy) AS syy FROM best JOIN c ON c.o <> best.oo GROUP BY best.oo, best.lam),
f1 AS (SELECT *, s11 - s1 * s1 / n AS c11, s22 - s2 * s2 / n AS c22, s12 - s1 * s2 / n AS c12,
      s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM ftr),
f2 AS (SELECT *, sqrt(c11 / n) AS sd1, sqrt(c22 / n) AS sd2 FROM f1),
f3 AS (SELECT *, (a22 * g1 - a12 * g2) / (a11 * a22 - a12 * a12) / sd1 AS b1,
      (a11 * g2 - a12 * g1) / (a11 * a22 - a12 * a12) / sd2 AS b2 FROM
      (SELECT *, c11 / (sd1 * sd1) + lam AS a11, c22 / (sd2 * sd2) + lam AS a22, c12 / (sd1 * sd2) AS a12,
              c1y / sd1 AS g1, c2y / sd2 AS g2 FROM f2)),
f4 AS (SELECT *, sy / n - b1 * s1 / n - b2 * s2 / n AS b0 FROM f3),
te AS (SELECT o AS oo, sum(c.n) AS n, sum(c.s1) AS s1, sum(c.s2) AS s2, sum(c.sy) AS sy, sum(c.s11) AS s11, sum(c.s22) AS s22, sum(c.s12) AS s12, sum(c.s1y) AS s1y, sum(c.s2y) AS s2y, sum(c.syy) AS syy FROM c GROUP BY o),
fin AS (SELECT f4.oo, f4.lam, f4.b0, f4.b1, f4.b2, te.n AS v_n, te.s1 AS v_s1, te.s2 AS v_s2, te.sy AS v_sy, te.s11 AS v_s11, te.s22 AS v_s22, te.s12 AS v_s12, te.s1y AS v_s1y, te.s2y AS v_s2y, te.syy AS v_syy FROM f4 JOIN te ON f4.oo = te.oo)
SELECT CAST(oo AS INTEGER) AS outer, lam AS lambda, {S('sqrt((v_syy - 2 * b0 * v_sy - 2 * b1 * v_s1y - 2 * b2 * v_s2y + v_n * b0 * b0 + 2 * b0 * b1 * v_s1 + 2 * b0 * b2 * v_s2 + b1 * b1 * v_s11 + 2 * b1 * b2 * v_s12 + b2 * b2 * v_s22) / v_n)')} AS test_rmse, CAST(v_n AS BIGINT) AS n_test
FROM fin"""


@register("nested_cv_ridge", NESTED_CV_SQL)
def q_nested_cv_ridge(spark, sf):
    res = ev.nested_cv_ridge(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], F.year("l_shipdate"),
                             F.col("l_returnflag"), [0.0, 10.0, 1000.0])
    return spark.createDataFrame([(int(r["outer"]), float(r["lambda"]), sig(r["test_rmse"]), int(r["n_test"])) for r in res],
                                 "outer int, lambda double, test_rmse double, n_test bigint")


@register("learning_curve")
def q_learning_curve(spark, sf):
    res = ev.learning_curve(_li(spark, sf), "l_extendedprice", ["l_quantity"], LI_ORDER)
    return spark.createDataFrame([(float(r["share"]), int(r["n_train"]), sig(r["train_rmse"]), sig(r["test_rmse"]))
                                  for r in res], "share double, n_train bigint, train_rmse double, test_rmse double")


# ============================================== interpretation (more)
@register("ice_curves", f"""
WITH {ols1_cte('customer', 'c_acctbal', 'c_nationkey')},
r AS (SELECT min(c_nationkey) AS lo, max(c_nationkey) AS hi FROM customer),
g AS (SELECT lo + (hi - lo) * i / 4.0 AS v FROM r, range(0, 5) t(i))
SELECT c_custkey, {S('v')} AS grid_value, {S('b0 + b1 * v')} AS prediction FROM customer, g, s""")
def q_ice_curves(spark, sf):
    c = load(spark, sf, "customer")
    fit = ols(c, "c_acctbal", ["c_nationkey"])
    i = interp.ice(c, fit, "c_nationkey", "c_custkey", grid=5)
    return i.select("c_custkey", sig_col("grid_value").alias("grid_value"), sig_col("prediction").alias("prediction"))


@register("effects_at_median")
def q_effects_at_median(spark, sf):
    d = _binary_li(spark, sf)
    return effects_frame(spark, interp.effects_at(d, logit(d, "is_r", ["l_quantity", "l_discount"]), "median"))


@register("effects_by_level_ordered")
def q_effects_by_level_ordered(spark, sf):
    o = load(spark, sf, "orders")
    return spark.createDataFrame(interp.effects_by_level(o, ordered(o, "o_orderpriority", ["o_totalprice"])),
                                 "term string, level string, effect double")


@register("probability_curves_ordered")
def q_probability_curves_ordered(spark, sf):
    o = load(spark, sf, "orders")
    pc = interp.probability_curves(o, ordered(o, "o_orderpriority", ["o_totalprice"]), "o_totalprice", 10)
    return pc.select("grid_index", sig_col("grid_value").alias("grid_value"),
                     F.transform("probabilities", lambda x: sig_col(x)).alias("probabilities"))


@register("importance_rank_ame")
def q_importance_rank_ame(spark, sf):
    d = _binary_li(spark, sf)
    rows = interp.average_marginal_effects(d, logit(d, "is_r", ["l_quantity", "l_discount", "status_f"]))
    return spark.createDataFrame(interp.importance_rank(rows), "rank int, term string, effect double")


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    li = _li(spark, sf).withColumn("row_key", F.xxhash64(*[F.col(c) for c in LI_ORDER]))
    fit = ols(li, "l_extendedprice", ["l_quantity", "l_discount"])
    return local_table(spark, interp.permutation_importance(li, fit, "row_key"), "term string, mse_increase double")


@register("bootstrap_coefficients")
def q_bootstrap_coefficients(spark, sf):
    b = interp.poisson_bootstrap_linear(_li(spark, sf), "l_extendedprice", ["l_quantity"], B=50, key_cols=LI_ORDER)
    return b.select("term", *[sig_col(c).alias(c) for c in ("mean", "se", "ci_lower", "ci_upper")])


# ============================================== series / panel / causal (more)
KPSS_LAGS = 12


@register("kpss_events", f"""
WITH m AS (SELECT avg(value) AS mu, count(*) AS n FROM events),
e AS (SELECT value - mu AS e, ts, event_id FROM events, m),
c AS (SELECT sum(e) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e),
l AS (SELECT e, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2, lag(e, 3) OVER w AS l3, lag(e, 4) OVER w AS l4, lag(e, 5) OVER w AS l5, lag(e, 6) OVER w AS l6, lag(e, 7) OVER w AS l7, lag(e, 8) OVER w AS l8, lag(e, 9) OVER w AS l9, lag(e, 10) OVER w AS l10, lag(e, 11) OVER w AS l11, lag(e, 12) OVER w AS l12 FROM e WINDOW w AS (ORDER BY ts, event_id)),
g AS (SELECT sum(e * e) AS g0, sum(e * l1) AS g1, sum(e * l2) AS g2, sum(e * l3) AS g3, sum(e * l4) AS g4, sum(e * l5) AS g5, sum(e * l6) AS g6, sum(e * l7) AS g7, sum(e * l8) AS g8, sum(e * l9) AS g9, sum(e * l10) AS g10, sum(e * l11) AS g11, sum(e * l12) AS g12 FROM l),
v AS (SELECT (g0 + 2 * (0.9230769230769231 * g1 + 0.8461538461538461 * g2 + 0.7692307692307692 * g3 + 0.6923076923076923 * g4 + 0.6153846153846154 * g5 + 0.5384615384615384 * g6 + 0.46153846153846156 * g7 + 0.3846153846153846 * g8 + 0.3076923076923077 * g9 + 0.23076923076923073 * g10 + 0.15384615384615385 * g11 + 0.07692307692307687 * g12)) / n AS lrv, n FROM g, m),
q AS (SELECT sum(s * s) AS ss FROM c)
SELECT {S('ss / (n * n * lrv)')} AS kpss_stat, 12 AS lags, CAST(n AS BIGINT) AS n_obs FROM q, v""")
def q_kpss_events(spark, sf):
    r = series.kpss(_ev(spark, sf), "value", EV_ORDER, lags=KPSS_LAGS)
    return spark.createDataFrame([(sig(r["kpss_stat"]), int(r["lags"]), int(r["n_obs"]))], "kpss_stat double, lags int, n_obs bigint")


ACF_PACF_SQL = f"""
WITH m AS (SELECT avg(value) AS mu, count(*) AS n FROM events),
d AS (SELECT sum((value - mu) * (value - mu)) AS den FROM events, m),
l AS (SELECT value, lag(value, 1) OVER (ORDER BY ts, event_id) AS l1, lag(value, 2) OVER (ORDER BY ts, event_id) AS l2, lag(value, 3) OVER (ORDER BY ts, event_id) AS l3, lag(value, 4) OVER (ORDER BY ts, event_id) AS l4, lag(value, 5) OVER (ORDER BY ts, event_id) AS l5, lag(value, 6) OVER (ORDER BY ts, event_id) AS l6 FROM events),
rr AS (SELECT sum(CASE WHEN l1 IS NOT NULL THEN (value - mu) * (l1 - mu) END) / any_value(den) AS r1, sum(CASE WHEN l2 IS NOT NULL THEN (value - mu) * (l2 - mu) END) / any_value(den) AS r2, sum(CASE WHEN l3 IS NOT NULL THEN (value - mu) * (l3 - mu) END) / any_value(den) AS r3, sum(CASE WHEN l4 IS NOT NULL THEN (value - mu) * (l4 - mu) END) / any_value(den) AS r4, sum(CASE WHEN l5 IS NOT NULL THEN (value - mu) * (l5 - mu) END) / any_value(den) AS r5, sum(CASE WHEN l6 IS NOT NULL THEN (value - mu) * (l6 - mu) END) / any_value(den) AS r6, any_value(n) AS n FROM l, m, d),
c1 AS (SELECT *, r1 AS f1_1 FROM rr),
c2a AS (SELECT *, (r2 - (f1_1 * r1)) / (1 - (f1_1 * r1)) AS f2_2 FROM c1),
c2 AS (SELECT *, f1_1 - f2_2 * f1_1 AS f2_1 FROM c2a),
c3a AS (SELECT *, (r3 - (f2_1 * r2 + f2_2 * r1)) / (1 - (f2_1 * r1 + f2_2 * r2)) AS f3_3 FROM c2),
c3 AS (SELECT *, f2_1 - f3_3 * f2_2 AS f3_1, f2_2 - f3_3 * f2_1 AS f3_2 FROM c3a),
c4a AS (SELECT *, (r4 - (f3_1 * r3 + f3_2 * r2 + f3_3 * r1)) / (1 - (f3_1 * r1 + f3_2 * r2 + f3_3 * r3)) AS f4_4 FROM c3),
c4 AS (SELECT *, f3_1 - f4_4 * f3_3 AS f4_1, f3_2 - f4_4 * f3_2 AS f4_2, f3_3 - f4_4 * f3_1 AS f4_3 FROM c4a),
c5a AS (SELECT *, (r5 - (f4_1 * r4 + f4_2 * r3 + f4_3 * r2 + f4_4 * r1)) / (1 - (f4_1 * r1 + f4_2 * r2 + f4_3 * r3 + f4_4 * r4)) AS f5_5 FROM c4),
c5 AS (SELECT *, f4_1 - f5_5 * f4_4 AS f5_1, f4_2 - f5_5 * f4_3 AS f5_2, f4_3 - f5_5 * f4_2 AS f5_3, f4_4 - f5_5 * f4_1 AS f5_4 FROM c5a),
c6a AS (SELECT *, (r6 - (f5_1 * r5 + f5_2 * r4 + f5_3 * r3 + f5_4 * r2 + f5_5 * r1)) / (1 - (f5_1 * r1 + f5_2 * r2 + f5_3 * r3 + f5_4 * r4 + f5_5 * r5)) AS f6_6 FROM c5),
c6 AS (SELECT *, f5_1 - f6_6 * f5_5 AS f6_1, f5_2 - f6_6 * f5_4 AS f6_2, f5_3 - f6_6 * f5_3 AS f6_3, f5_4 - f6_6 * f5_2 AS f6_4, f5_5 - f6_6 * f5_1 AS f6_5 FROM c6a)
SELECT CAST(lag AS INTEGER) AS lag, {S('acf')} AS acf, {S('pacf')} AS pacf, {S('band')} AS band FROM (
SELECT 0 AS lag, 1.0 AS acf, 1.0 AS pacf, 1.96 / sqrt(n) AS band FROM c6
UNION ALL SELECT 1, r1, f1_1, 1.96 / sqrt(n) FROM c6
UNION ALL SELECT 2, r2, f2_2, 1.96 / sqrt(n) FROM c6
UNION ALL SELECT 3, r3, f3_3, 1.96 / sqrt(n) FROM c6
UNION ALL SELECT 4, r4, f4_4, 1.96 / sqrt(n) FROM c6
UNION ALL SELECT 5, r5, f5_5, 1.96 / sqrt(n) FROM c6
UNION ALL SELECT 6, r6, f6_6, 1.96 / sqrt(n) FROM c6)"""


@register("acf_pacf_table", ACF_PACF_SQL)
def q_acf_pacf_table(spark, sf):
    return series.acf_table(spark, _ev(spark, sf), "value", EV_ORDER, 6)


def _hourly_pair(spark, sf):
    """Hourly value of clicks and of all other events."""
    kind = F.when(F.col("event_type") == "click", "click").otherwise("rest")
    r = series.resample(_ev(spark, sf).withColumn("event_type", kind), "ts", "1 hour", "value", "event_type", "sum")
    return (r.groupBy("slot").pivot("event_type", ["click", "rest"]).agg(F.first("value"))
            .fillna(0.0, ["click", "rest"]))


HOURLY_PAIR_SQL = """b AS (SELECT CASE WHEN event_type = 'click' THEN 'click' ELSE 'rest' END AS event_type, date_trunc('hour', ts) AS slot,
      sum(value) AS v FROM events GROUP BY ALL),
r AS (SELECT event_type, min(slot) AS lo, max(slot) AS hi FROM b GROUP BY event_type),
sp AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS slot FROM r),
f AS (SELECT sp.event_type, sp.slot, coalesce(b.v, 0.0) AS v FROM sp LEFT JOIN b USING (event_type, slot)),
hp AS (SELECT slot, coalesce(max(CASE WHEN event_type = 'click' THEN v END), 0.0) AS click,
       coalesce(max(CASE WHEN event_type = 'rest' THEN v END), 0.0) AS rest FROM f GROUP BY slot),
hl AS (SELECT click, lag(click) OVER (ORDER BY slot) AS cl, lag(rest) OVER (ORDER BY slot) AS vl FROM hp),
hx AS (SELECT * FROM hl WHERE cl IS NOT NULL)"""


@register("granger_click_view", f"""
WITH {HOURLY_PAIR_SQL}, {ols1_cte('hx', 'click', 'cl')}, {ols2_cte('hx', 'click', 'cl', 'vl')}
SELECT {S('((s.syy - s.b1 * s.sxy) - t_f.ssr) / (t_f.ssr / (t_f.n - 3))')} AS f_stat, CAST(t_f.n - 3 AS BIGINT) AS df_den
FROM s, t_f""")
def q_granger_click_view(spark, sf):
    r = series.granger(_hourly_pair(spark, sf), "click", "rest", ["slot"], 1)
    return spark.createDataFrame([(sig(r["f_stat"]), int(r["df_den"]))], "f_stat double, df_den bigint")


VAR_IRF_SQL = f"""
WITH {HOURLY_PAIR_SQL},
hl2 AS (SELECT click, rest, lag(click) OVER (ORDER BY slot) AS cl, lag(rest) OVER (ORDER BY slot) AS vl FROM hp),
hx2 AS (SELECT * FROM hl2 WHERE cl IS NOT NULL),
{ols2_cte('hx2', 'click', 'cl', 'vl', 'e1')}, {ols2_cte('hx2', 'rest', 'cl', 'vl', 'e2')},
a AS (SELECT e1_f.b1 AS a11, e1_f.b2 AS a12, e2_f.b1 AS a21, e2_f.b2 AS a22 FROM e1_f, e2_f),
p0 AS (SELECT 1.0 AS p11, 0.0 AS p12, 0.0 AS p21, 1.0 AS p22),
p1 AS (SELECT a11 * p11 + a12 * p21 AS p11, a11 * p12 + a12 * p22 AS p12, a21 * p11 + a22 * p21 AS p21, a21 * p12 + a22 * p22 AS p22 FROM a, p0),
p2 AS (SELECT a11 * p11 + a12 * p21 AS p11, a11 * p12 + a12 * p22 AS p12, a21 * p11 + a22 * p21 AS p21, a21 * p12 + a22 * p22 AS p22 FROM a, p1),
p3 AS (SELECT a11 * p11 + a12 * p21 AS p11, a11 * p12 + a12 * p22 AS p12, a21 * p11 + a22 * p21 AS p21, a21 * p12 + a22 * p22 AS p22 FROM a, p2),
p4 AS (SELECT a11 * p11 + a12 * p21 AS p11, a11 * p12 + a12 * p22 AS p12, a21 * p11 + a22 * p21 AS p21, a21 * p12 + a22 * p22 AS p22 FROM a, p3),
p5 AS (SELECT a11 * p11 + a12 * p21 AS p11, a11 * p12 + a12 * p22 AS p12, a21 * p11 + a22 * p21 AS p21, a21 * p12 + a22 * p22 AS p22 FROM a, p4)
SELECT CAST(horizon AS INTEGER) AS horizon, CAST(response AS INTEGER) AS response, CAST(shock AS INTEGER) AS shock, CAST(value AS DOUBLE) AS value FROM (
SELECT 0 AS horizon, 0 AS response, 0 AS shock, {S('p11')} AS value FROM p0
UNION ALL SELECT 0 AS horizon, 0 AS response, 1 AS shock, {S('p12')} AS value FROM p0
UNION ALL SELECT 0 AS horizon, 1 AS response, 0 AS shock, {S('p21')} AS value FROM p0
UNION ALL SELECT 0 AS horizon, 1 AS response, 1 AS shock, {S('p22')} AS value FROM p0
UNION ALL SELECT 1 AS horizon, 0 AS response, 0 AS shock, {S('p11')} AS value FROM p1
UNION ALL SELECT 1 AS horizon, 0 AS response, 1 AS shock, {S('p12')} AS value FROM p1
UNION ALL SELECT 1 AS horizon, 1 AS response, 0 AS shock, {S('p21')} AS value FROM p1
UNION ALL SELECT 1 AS horizon, 1 AS response, 1 AS shock, {S('p22')} AS value FROM p1
UNION ALL SELECT 2 AS horizon, 0 AS response, 0 AS shock, {S('p11')} AS value FROM p2
UNION ALL SELECT 2 AS horizon, 0 AS response, 1 AS shock, {S('p12')} AS value FROM p2
UNION ALL SELECT 2 AS horizon, 1 AS response, 0 AS shock, {S('p21')} AS value FROM p2
UNION ALL SELECT 2 AS horizon, 1 AS response, 1 AS shock, {S('p22')} AS value FROM p2
UNION ALL SELECT 3 AS horizon, 0 AS response, 0 AS shock, {S('p11')} AS value FROM p3
UNION ALL SELECT 3 AS horizon, 0 AS response, 1 AS shock, {S('p12')} AS value FROM p3
UNION ALL SELECT 3 AS horizon, 1 AS response, 0 AS shock, {S('p21')} AS value FROM p3
UNION ALL SELECT 3 AS horizon, 1 AS response, 1 AS shock, {S('p22')} AS value FROM p3
UNION ALL SELECT 4 AS horizon, 0 AS response, 0 AS shock, {S('p11')} AS value FROM p4
UNION ALL SELECT 4 AS horizon, 0 AS response, 1 AS shock, {S('p12')} AS value FROM p4
UNION ALL SELECT 4 AS horizon, 1 AS response, 0 AS shock, {S('p21')} AS value FROM p4
UNION ALL SELECT 4 AS horizon, 1 AS response, 1 AS shock, {S('p22')} AS value FROM p4
UNION ALL SELECT 5 AS horizon, 0 AS response, 0 AS shock, {S('p11')} AS value FROM p5
UNION ALL SELECT 5 AS horizon, 0 AS response, 1 AS shock, {S('p12')} AS value FROM p5
UNION ALL SELECT 5 AS horizon, 1 AS response, 0 AS shock, {S('p21')} AS value FROM p5
UNION ALL SELECT 5 AS horizon, 1 AS response, 1 AS shock, {S('p22')} AS value FROM p5)"""


@register("var_impulse_response", VAR_IRF_SQL)
def q_var_impulse_response(spark, sf):
    v = series.var_fit(_hourly_pair(spark, sf), ["click", "rest"], ["slot"], 1)
    psi = series.impulse_response(v, ["click", "rest"], 1, 5)
    rows = [(h, i, j, sig(float(psi[h, i, j]))) for h in range(psi.shape[0]) for i in range(2) for j in range(2)]
    return spark.createDataFrame(rows, "horizon int, response int, shock int, value double")


@register("engle_granger_ecm", f"""
WITH {HOURLY_PAIR_SQL},
{ols1_cte('hp', 'click', 'rest', 'c1')},
u AS (SELECT slot, click, rest, click - (c1.b0 + c1.b1 * rest) AS u FROM hp, c1),
ul AS (SELECT u - lag(u) OVER (ORDER BY slot) AS du, lag(u) OVER (ORDER BY slot) AS u1,
       click - lag(click) OVER (ORDER BY slot) AS dy, rest - lag(rest) OVER (ORDER BY slot) AS dx FROM u),
ux AS (SELECT * FROM ul WHERE u1 IS NOT NULL),
{ols1_cte('ux', 'du', 'u1', 'a1')}, a2 AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM a1),
{ols2_cte('ux', 'dy', 'dx', 'u1', 'e')}
SELECT 'long_run_beta' AS metric, {S('c1.b1')} AS value FROM c1
UNION ALL SELECT 'adf_resid', {S('b1 / sqrt(s2 / sxx)')} FROM a2
UNION ALL SELECT 'ecm_short_run', {S('b1')} FROM e_f
UNION ALL SELECT 'ecm_adjustment', {S('b2')} FROM e_f
UNION ALL SELECT 'ecm_adjustment_se', {S('sqrt(ssr / (n - 3) * s11 / det)')} FROM e_f""")
def q_engle_granger_ecm(spark, sf):
    r = series.engle_granger(_hourly_pair(spark, sf), "click", "rest", ["slot"])
    return metrics_df(spark, list(r.items()))


@register("arima_forecast_by_type")
def q_arima_forecast_by_type(spark, sf):
    _, fc = series.arima_hr(_ev(spark, sf), "value", "event_type", EV_ORDER, p=1, d=0, q=1, long_ar=4, horizon=3)
    return fc.select("event_type", "step", sig_col("forecast").alias("forecast"))


DGMM_SQL = f"""
WITH l AS (SELECT l_extendedprice AS y, l_quantity AS x, lag(l_extendedprice, 1) OVER w AS y1,
           lag(l_extendedprice, 2) OVER w AS y2, lag(l_quantity, 1) OVER w AS x1
           FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_shipdate, l_extendedprice)),
d AS (SELECT y - y1 AS dy, x - x1 AS dx, y1 - y2 AS dly, y2 AS z FROM l WHERE y2 IS NOT NULL AND x1 IS NOT NULL),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(dx) AS sdx, sum(dly) AS sdly, sum(z) AS sz, sum(dy) AS sdy,
      sum(dx * dx) AS sdxdx, sum(dx * dly) AS sdxdly, sum(z * dx) AS szdx, sum(z * dly) AS szdly, sum(dx * dy) AS sdxdy,
      sum(z * dy) AS szdy, sum(dx * z) AS sdxz, sum(z * z) AS szz FROM d),
iv AS (SELECT *, (((sdxdx) * (szdly) - (sdxdly) * (szdx))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i00, (-((sdx) * (szdly) - (sdly) * (szdx))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i01, (((sdx) * (sdxdly) - (sdly) * (sdxdx))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i02, (-((sdx) * (szdly) - (sdxdly) * (sz))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i10, (((n) * (szdly) - (sdly) * (sz))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i11, (-((n) * (sdxdly) - (sdly) * (sdx))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i12, (((sdx) * (szdx) - (sdxdx) * (sz))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i20, (-((n) * (szdx) - (sdx) * (sz))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i21, (((n) * (sdxdx) - (sdx) * (sdx))) / ((n) * (((sdxdx) * (szdly) - (sdxdly) * (szdx))) + (sdx) * (-((sdx) * (szdly) - (sdxdly) * (sz))) + (sdly) * (((sdx) * (szdx) - (sdxdx) * (sz)))) AS i22 FROM m),
bt AS (SELECT *, (i00 * sdy + i01 * sdxdy + i02 * szdy) AS b0, (i10 * sdy + i11 * sdxdy + i12 * szdy) AS b1, (i20 * sdy + i21 * sdxdy + i22 * szdy) AS b2 FROM iv),
r AS (SELECT sum(pow(dy - (b0 + b1 * dx + b2 * dly), 2)) / (any_value(n) - 3) AS s2 FROM d, bt),
v AS (SELECT * FROM bt, r)
SELECT 'const' AS term, {S('b0')} AS coefficient, {S('sqrt(s2 * (i00 * (n) * i00 + i00 * (sdx) * i01 + i00 * (sz) * i02 + i01 * (sdx) * i00 + i01 * (sdxdx) * i01 + i01 * (sdxz) * i02 + i02 * (sz) * i00 + i02 * (sdxz) * i01 + i02 * (szz) * i02))')} AS se FROM v
UNION ALL SELECT '_d_l_quantity' AS term, {S('b1')} AS coefficient, {S('sqrt(s2 * (i10 * (n) * i10 + i10 * (sdx) * i11 + i10 * (sz) * i12 + i11 * (sdx) * i10 + i11 * (sdxdx) * i11 + i11 * (sdxz) * i12 + i12 * (sz) * i10 + i12 * (sdxz) * i11 + i12 * (szz) * i12))')} AS se FROM v
UNION ALL SELECT '_dly' AS term, {S('b2')} AS coefficient, {S('sqrt(s2 * (i20 * (n) * i20 + i20 * (sdx) * i21 + i20 * (sz) * i22 + i21 * (sdx) * i20 + i21 * (sdxdx) * i21 + i21 * (sdxz) * i22 + i22 * (sz) * i20 + i22 * (sdxz) * i21 + i22 * (szz) * i22))')} AS se FROM v"""


@register("difference_gmm_panel", DGMM_SQL)
def q_difference_gmm_panel(spark, sf):
    r = panel.difference_gmm(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey", LI_ORDER)
    return spark.createDataFrame([(t, sig(b), sig(s)) for t, b, s in zip(r["terms"], r["beta"], r["se"])],
                                 "term string, coefficient double, se double")


PRE_SQL = ("(SELECT l_extendedprice AS y, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS g, "
           "CAST(year(l_shipdate) AS DOUBLE) AS t FROM lineitem WHERE year(l_shipdate) < 1998)")


@register("pre_trends_check", f"""
WITH s AS (SELECT g, regr_count(y, t) AS n, regr_slope(y, t) AS b, regr_sxx(y, t) AS sxx, regr_syy(y, t) - regr_slope(y, t)
           * regr_sxy(y, t) AS ssr FROM {PRE_SQL} GROUP BY g),
p AS (SELECT sum(CASE WHEN g = 1 THEN b ELSE -b END) AS d, sum(ssr) / (sum(n) - 4) AS s2, sum(1.0 / sxx) AS isx FROM s)
SELECT 'trend_diff' AS metric, {S('d')} AS value FROM p
UNION ALL SELECT 'se', {S('sqrt(s2 * isx)')} FROM p
UNION ALL SELECT 't', {S('d / sqrt(s2 * isx)')} FROM p""")
def q_pre_trends_check(spark, sf):
    d = _li(spark, sf).select("l_extendedprice", (F.col("l_returnflag") == "R").cast("double").alias("treat"),
                              F.year("l_shipdate").alias("yr"))
    r = causal.pre_trends(d, "l_extendedprice", "treat", "yr", F.col("yr") < 1998)
    return metrics_df(spark, [(k, r[k]) for k in ("trend_diff", "se", "t")])


# ======================================================= report (more)
QQ_PROBS = [i / 20 for i in range(1, 20)]


def _qq_sql() -> str:
    lits = ", ".join(f"({i}, {sig(dist.norm_ppf(i / 20))!r})" for i in range(1, 20))
    return f"""WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
r AS (SELECT l_extendedprice - (b0 + b1 * l_quantity) AS e FROM lineitem, s),
v AS (SELECT e, count(*) AS k FROM r GROUP BY e),
cum AS (SELECT e, sum(k) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS ck, sum(k) OVER () AS n FROM v),
t AS (SELECT * FROM (VALUES {lits}) q(i, tq))
SELECT i / 20.0 AS p, {S('(SELECT min(e) FROM cum WHERE ck * 20 >= i * n)')} AS sample_q,
  CAST(tq AS DOUBLE) AS theoretical_q FROM t"""


@register("qq_points", _qq_sql())
def q_qq_points(spark, sf):
    li = _li(spark, sf)
    return rep.qq_points(li, ols(li, "l_extendedprice", ["l_quantity"]), 20)


@register("scale_location_bins", DECILES_SQL.replace(
    "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, b0 + b1 * l_quantity AS p FROM lineitem, s",
    "sqrt(abs((l_extendedprice - (b0 + b1 * l_quantity)) / sqrt((syy - b1 * sxy) / (n - 2)))) AS y, "
    "b0 + b1 * l_quantity AS p FROM lineitem, s").replace(
    LPM_SQL, ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')) + f"""
SELECT CAST(bin AS INTEGER) AS bin, n, {S('mean_pred')} AS mean_fitted, {S('obs_rate')} AS mean_sqrt_abs FROM cal""")
def q_scale_location_bins(spark, sf):
    li = _li(spark, sf)
    r = rep.scale_location(li, ols(li, "l_extendedprice", ["l_quantity"]), 10)
    return r.select(F.col("bin").cast("int").alias("bin"), "n", sig_col("mean_fitted").alias("mean_fitted"),
                    sig_col("mean_sqrt_abs").alias("mean_sqrt_abs"))


@register("residuals_per_row", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')}
SELECT l_orderkey, l_linenumber, {S('l_extendedprice - (b0 + b1 * l_quantity)')} AS resid FROM lineitem, s""")
def q_residuals_per_row(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    return li.select("l_orderkey", "l_linenumber", sig_col(fit.residual()).alias("resid"))


@register("confidence_scores", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
g AS (SELECT l_discount AS sc, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS pos,
      sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END) AS neg FROM lineitem GROUP BY 1),
a AS (SELECT sum(pos * (cn - 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM
      (SELECT *, sum(neg) OVER (ORDER BY sc ROWS UNBOUNDED PRECEDING) AS cn FROM g)),
c AS (SELECT 0.5 + least(0.2, 0.05 * pow(n, 0.3)) + least(0.15, 0.15 * greatest(1 - (syy - b1 * sxy) / syy, 0)) AS lin,
      n, 1 - (syy - b1 * sxy) / syy AS r2 FROM s)
SELECT 'linear' AS kind, round(least(1.0, greatest(0.0, lin)), 4) AS confidence FROM c
UNION ALL SELECT 'binary_eval', round(least(1.0, greatest(0.0, 0.5 + least(0.2, 0.05 * pow(n, 0.3)) + least(0.15, 0.15 * r2)
  + least(0.2, 0.4 * (auc - 0.5)))), 4) FROM c, a""")
def q_confidence_scores(spark, sf):
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    a = ev.auc(_binary_li(spark, sf), "is_r", "l_discount")
    return spark.createDataFrame([("linear", ev.confidence_linear(fit.n, fit.r2)),
                                  ("binary_eval", ev.confidence_binary(fit.n, fit.r2, a))], "kind string, confidence double")


@register("predict_class_probabilities", f"""
WITH d AS (SELECT c_custkey, c_mktsegment AS y, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS x FROM customer),
c AS (SELECT x, y, count(*) / sum(count(*)) OVER (PARTITION BY x) AS p FROM d GROUP BY x, y)
SELECT d.c_custkey, c.y AS class, {S('c.p')} AS probability FROM d JOIN c ON d.x = c.x""")
def q_predict_class_probabilities(spark, sf):
    d = load(spark, sf, "customer").withColumn("pos_balance", (F.col("c_acctbal") > 0).cast("double"))
    fit = mnlogit(d, "c_mktsegment", ["pos_balance"])
    p = score.predict_discrete(fit, d, keep=["c_custkey"])
    labels = F.array(*[F.lit(x) for x in fit.classes])
    z = p.select("c_custkey", F.posexplode("probabilities").alias("k", "probability"))
    return z.select("c_custkey", F.element_at(labels, (F.col("k") + 1).cast("int")).alias("class"),
                    sig_col("probability").alias("probability"))


# ====================================================== sources (more)
@register("json_source_ols", O["ols_coefficients"])
def q_json_source_ols(spark, sf):
    from .sources.scan import scan
    out = stream.scratch(spark, "lineitem-json") + ".json"
    _li(spark, sf).select("l_extendedprice", "l_quantity").write.json(out)
    d = scan(spark, out, "json", schema="l_extendedprice double, l_quantity double")
    return ols(d, "l_extendedprice", ["l_quantity"]).coefficients(spark).select("term", "coefficient", "se", "t_stat")


@register("tsv_source_ols", O["ols_coefficients"])
def q_tsv_source_ols(spark, sf):
    from .sources.scan import scan
    out = stream.scratch(spark, "lineitem-tsv") + ".tsv"
    _li(spark, sf).select("l_extendedprice", "l_quantity").write.option("header", True).option("sep", "\\t").csv(out)
    d = scan(spark, out, "auto", schema="l_extendedprice double, l_quantity double")
    return ols(d, "l_extendedprice", ["l_quantity"]).coefficients(spark).select("term", "coefficient", "se", "t_stat")


# ====================================================== trees (more)
@register("grid_search_forest")
def q_grid_search_forest(spark, sf):
    r = trees.grid_search(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], "forest", "regression",
                          {"maxDepth": [2, 4]}, folds=2)
    rows = [(f"maxDepth={g}", sig(s)) for g, s in zip([2, 4], r["scores"])] + \
        [("chosen_maxDepth", float(r["chosen"]["maxDepth"]))]
    return spark.createDataFrame(rows, "candidate string, rmse double")


@register("recalibration_platt")
def q_recalibration_platt(spark, sf):
    d = _binary_li(spark, sf)
    fit = logit(d, "is_r", ["l_quantity", "l_discount"])
    scored = d.withColumn("p", probability(fit))
    m = trees.recalibrate(scored, "is_r", "p", "platt")
    lr = m.stages[-1]
    iso = trees.recalibrate(scored, "is_r", "p", "isotonic")
    return spark.createDataFrame([("platt_slope", sig(float(lr.coefficients[0]))), ("platt_intercept", sig(lr.intercept)),
                                  ("isotonic_knots", float(iso.knots().count()))], "metric string, value double")


@register("forest_prediction_intervals")
def q_forest_prediction_intervals(spark, sf):
    feats = ["l_quantity", "l_discount"]
    li = _li(spark, sf).withColumns({f"_id{i}": F.col(c) for i, c in enumerate(LI_ORDER)})
    keys = [f"_id{i}" for i in range(len(LI_ORDER))]
    m = trees.train_tree_model(li, "l_extendedprice", feats, "forest", numTrees=10, maxDepth=4)
    iv = trees.forest_interval(m, li, li.select(*keys, *feats), "l_extendedprice", feats, 0.1, keys)
    return iv.agg(F.count(F.lit(1)).alias("rows"), sig_col(F.avg(F.col("q")[2] - F.col("q")[0])).alias("mean_width"))


@register("gbt_early_stopping")
def q_gbt_early_stopping(spark, sf):
    li = _li(spark, sf).withColumn("is_val", F.year("l_shipdate") >= 2000)
    m = trees.train_tree_model(li, "l_extendedprice", ["l_quantity", "l_discount"], "gbt", validation_col="is_val",
                               maxIter=30, validationTol=0.01)
    return spark.createDataFrame([("trees_used", float(m.stages[-1].getNumTrees))], "metric string, value double")


# ====================================================== monitors (more)
@register("retrain_triggers")
def q_retrain_triggers(spark, sf):
    a, b = _ev_halves(spark, sf)
    drift = ev.ks_two_sample(a, b, "value")
    d = _li(spark, sf).select((F.col("l_returnflag") == "R").cast("double").alias("is_r"), "l_discount",
                              F.year("l_shipdate").alias("yr"))
    decay = mon.auc_decay(d, "is_r", "l_discount", F.col("yr"), floor=0.5, runs=2)
    cs = series.cusum(_ev(spark, sf), "value", EV_ORDER)
    path = stream.scratch(spark, "registry-w")
    li = _li(spark, sf)
    fit = ols(li, "l_extendedprice", ["l_quantity"])
    fp = reg.dataset_fingerprint(li, ["l_extendedprice", "l_quantity"])
    reg.save_model(spark, fit, reg.make_model_id("price", "ols", fp["hash"]), fp, path=path)
    stale = mon.stale_models(reg.load_registry(spark, path)).collect()[0]
    rows = mon.retrain_triggers(drift, decay, cs, int(stale["age_days"]))
    return spark.createDataFrame([(t, sig(v), bool(f)) for t, v, f in rows], "trigger string, value double, fire boolean")


@register("stream_sliding_windows", f"""
WITH e AS (SELECT ts, value, time_bucket(INTERVAL 12 HOUR, ts) AS b FROM events),
w AS (SELECT b AS window_start, value FROM e UNION ALL SELECT b - INTERVAL 12 HOUR, value FROM e),
g AS (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS n, sum(value) AS s FROM w GROUP BY 1)
SELECT window_start, window_end, n, {S('s')} AS sum FROM g WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_sliding_windows(spark, sf):
    s = stream.file_stream(spark, sf, "events.parquet", _events_schema(spark, sf), ts="ts")
    out = stream.run_to_table(stream.window_stats(s, "ts", "value", "1 day", slide="12 hours", watermark="1 hour"),
                              stream.scratch(spark, "sliding"))
    r = spark.read.parquet(out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", sig_col("sum").alias("sum"))


@register("stream_session_windows", f"""
WITH e AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
           OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
g AS (SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS n, sum(value) AS v
      FROM s GROUP BY user_id, sid)
SELECT window_start, window_end, user_id, n, {S('v')} AS sum FROM g
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_session_windows(spark, sf):
    s = stream.file_stream(spark, sf, "events.parquet", _events_schema(spark, sf), ts="ts")
    out = stream.run_to_table(stream.window_stats(s, "ts", "value", None, by=["user_id"], gap="6 hours",
                                                  watermark="1 hour"), stream.scratch(spark, "session"))
    r = spark.read.parquet(out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "user_id", "n",
                    sig_col("sum").alias("sum"))


@register("repeated_cv_linear")
def q_repeated_cv_linear(spark, sf):
    res = ev.repeated_cv_linear(_li(spark, sf), "l_extendedprice", ["l_quantity"], LI_ORDER, k=5, repeats=3,
                                strata="l_returnflag")
    return spark.createDataFrame([(int(r["repeat"]), sig(r["rmse"]), int(r["n"])) for r in res],
                                 "repeat int, rmse double, n bigint")


@register("tree_shapley_summary")
def q_tree_shapley_summary(spark, sf):
    li = _li(spark, sf)
    feats = ["l_quantity", "l_discount", "l_tax"]
    m = trees.train_tree_model(li, "l_extendedprice", feats, "forest", numTrees=10, maxDepth=4)
    return (treeshap.TreeExplainer(m, li, feats).mean_absolute(li)
            .select("feature", sig_col("mean_abs_phi").alias("mean_abs_phi"), "rows"))


@register("forecast_vs_actual_by_type")
def q_forecast_vs_actual_by_type(spark, sf):
    e = _ev(spark, sf)
    cut = F.col("ts") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    t = rep.forecast_vs_actual(e, "value", "event_type", EV_ORDER, cut, p=1, q=0, horizon=3)
    return t.select("event_type", "step", *[sig_col(c).alias(c) for c in ("forecast", "actual", "error")])


@register("stream_cusum_batches_by_type", f"""
WITH c AS (SELECT event_type, sum(value - 100.0) OVER (PARTITION BY event_type ORDER BY ts, event_id
           ROWS UNBOUNDED PRECEDING) AS s FROM events)
SELECT event_type, count(*) AS n, {S('max(greatest(s, 0.0))')} AS smax, {S('min(least(s, 0.0))')} AS smin
FROM c GROUP BY event_type""")
def q_stream_cusum_batches_by_type(spark, sf):
    s = stream.file_stream(spark, sf, "events.parquet", _events_schema(spark, sf))
    path = stream.cusum_stream_batches(s, "event_type", "value", EV_ORDER, 100.0, 1e9, stream.scratch(spark, "cusum-b"))
    r = spark.read.parquet(path)
    return r.select("event_type", "n", sig_col("smax").alias("smax"), sig_col("smin").alias("smin"))


# oracle of panel_random_effects_hausman, set here because it reuses _nc2_sql defined in the GLS section
O["panel_random_effects_hausman"] = f"""
WITH m AS (SELECT l_suppkey, count(*) AS tg, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem GROUP BY 1),
w AS (SELECT l_extendedprice - my AS y, l_quantity - mx AS x FROM lineitem JOIN m USING (l_suppkey)),
fe AS (SELECT sum(x * y) / sum(x * x) AS bfe, sum(x * x) AS sxx, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS ssr,
       count(*) AS n FROM w),
g AS (SELECT CAST(count(*) AS DOUBLE) AS gcount FROM m),
{ols1_cte('m', 'my', 'mx', 'be')},
vc AS (SELECT fe.*, gcount, fe.ssr / (fe.n - gcount - 1) AS s2e,
       greatest((be.syy - be.b1 * be.sxy) / (be.n - 2) - fe.ssr / (fe.n - gcount - 1) / (fe.n / gcount), 0.0) AS s2u
       FROM fe, g, be),
q AS (SELECT 1 - (1 - sqrt(s2e / (tg * s2u + s2e))) AS c,
      l_extendedprice - (1 - sqrt(s2e / (tg * s2u + s2e))) * my AS ty,
      l_quantity - (1 - sqrt(s2e / (tg * s2u + s2e))) * mx AS tx FROM lineitem JOIN m USING (l_suppkey), vc),
{_nc2_sql('q', 'c', 'tx', 'ty')},
h AS (SELECT pow(vc.bfe - zs.bx, 2) / (vc.s2e / vc.sxx - zs.s2 * zs.a / zs.det) AS hs FROM vc, zs)
SELECT 're:const' AS term, {S('bc')} AS value, {S('sqrt(s2 * d / det)')} AS extra FROM zs
UNION ALL SELECT 're:l_quantity', {S('bx')}, {S('sqrt(s2 * a / det)')} FROM zs
UNION ALL SELECT 'hausman', {S('hs')}, {S('2 * ' + norm_sf_sql('sqrt(hs)'))} FROM h"""




from . import catalog_models  # noqa: E402,F401  (registers further queries)
