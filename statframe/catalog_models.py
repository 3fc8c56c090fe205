"""Further registered queries: models and tests that need more than one aggregate.

Oracles of iterative fits run Newton's method inside DuckDB (a recursive CTE over grouped
counts), so they share no code and no starting point with the Spark fits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import EV_ORDER, LI_ORDER, O, Q, S, SAT_CELLS, _binary_li, _coef_sql, _ev, _li, _nc2_select, _nc2_sql, _phi2, _ppf_step, flag_sql, norm_sf_sql, ols1_cte, register
from .functions.columns import sig, sig_col
from .operators import causal
from .operators import diagnostics as diag
from .operators import discrete as disc
from .operators import dynpanel, panel, score, series, trees, treeshap
from .operators import evaluate as ev
from .operators import interpret as interp
from .operators import linear as lin
from .operators import report as rep
from .operators.foldcv import cross_validate_discrete
from .operators.isotonic import isotonic
from .operators.zeroinfl import zero_inflated
from .plans.selection import exact_quantiles
from .sources import registry as reg
from .sources.scan import load, register_tables, scan
from .streaming import stream

# ------------------------------------------------------------------ M2, M3
WIDE_LAGS = 2000


@register("kpss_events_2000_lags", f"""
WITH m AS (SELECT avg(value) AS mu, count(*) AS n FROM events),
e AS (SELECT value - mu AS e, row_number() OVER (ORDER BY ts, event_id) AS i FROM events, m),
c AS (SELECT i, sum(e) OVER (ORDER BY i) AS s FROM e),
p AS (SELECT i, s FROM c UNION ALL SELECT 0, 0.0),
w AS (SELECT unnest(range(1, CAST(n AS BIGINT) + {WIDE_LAGS} + 1)) AS t, CAST(n AS BIGINT) AS n FROM m),
d AS (SELECT hi.s - lo.s AS d FROM w JOIN p hi ON hi.i = least(w.t, w.n) JOIN p lo ON lo.i = greatest(w.t - {WIDE_LAGS + 1}, 0)),
v AS (SELECT sum(d * d) / {WIDE_LAGS + 1} / any_value(n) AS lrv FROM d, m),
q AS (SELECT sum(s * s) AS ss FROM c)
SELECT {S('ss / (n * n * lrv)')} AS kpss_stat, {WIDE_LAGS} AS lags, CAST(n AS BIGINT) AS n_obs FROM q, v, m""")
def q_kpss_events_wide(spark, sf):
    """Bartlett weights make the long-run variance the mean square of windowed sums of e."""
    r = series.kpss(_ev(spark, sf), "value", EV_ORDER, lags=WIDE_LAGS)
    return spark.createDataFrame([(sig(r["kpss_stat"]), int(r["lags"]), int(r["n_obs"]))], "kpss_stat double, lags int, n_obs bigint")


# --------------------------------------------------------------------- D19
@register("clogit_exposure", f"""
WITH RECURSIVE s AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS m, count(*) FILTER (WHERE l_discount > 0.05) AS n1,
  count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.05) AS a FROM lineitem GROUP BY l_orderkey),
g AS (SELECT n, m, n1, CAST(count(*) AS DOUBLE) AS c, CAST(sum(a) AS DOUBLE) AS sa FROM s WHERE m > 0 AND m < n GROUP BY n, m, n1),
u AS (SELECT n, m, n1, c, sa, CAST(k AS DOUBLE) AS k, exp(lgamma(n1 + 1) - lgamma(k + 1) - lgamma(n1 - k + 1)
      + lgamma(n - n1 + 1) - lgamma(m - k + 1) - lgamma(n - n1 - m + k + 1)) AS w
      FROM (SELECT *, unnest(range(greatest(0, m - n + n1), least(m, n1) + 1)) AS k FROM g)),
it(i, b, info) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, b + sum(sa - c * e1) / sum(c * (e2 - e1 * e1)), sum(c * (e2 - e1 * e1)) FROM (
    SELECT i, b, any_value(c) AS c, any_value(sa) AS sa, sum(w * k * exp(b * k)) / sum(w * exp(b * k)) AS e1,
           sum(w * k * k * exp(b * k)) / sum(w * exp(b * k)) AS e2 FROM it, u WHERE i < 12 GROUP BY i, b, n, m, n1) GROUP BY i, b)
SELECT 'exposed' AS term, {S('b')} AS coefficient, {S('1 / sqrt(info)')} AS se, {S('b * sqrt(info)')} AS z_stat FROM it WHERE i = 12""")
def q_clogit_exposure(spark, sf):
    """Several cases per order, binary exposure: the conditional likelihood is noncentral hypergeometric."""
    d = _binary_li(spark, sf).withColumn("exposed", (F.col("l_discount") > 0.05).cast("double"))
    return disc.clogit(d, "is_r", ["exposed"], "l_orderkey").coefficients(spark).select("term", "coefficient", "se", "z_stat")


# ---------------------------------------------------------------------- N5
def _customer_years(spark, sf):
    """Panel of customers by year: order value and number of orders."""
    o = load(spark, sf, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).cast("double").alias("orders"))


CUSTOMER_YEARS_SQL = ("p AS (SELECT o_custkey AS c, CAST(year(o_orderdate) AS BIGINT) AS t, sum(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x "
                      "FROM orders GROUP BY 1, 2)")


@register("arellano_bond_exact_fit", f"""
WITH {CUSTOMER_YEARS_SQL},
d AS (SELECT a.c, a.y - b.y AS dy, b.y - e.y AS dl, a.x - b.x AS dx, e.y AS z
      FROM p a JOIN p b ON a.c = b.c AND a.t = b.t + 1 JOIN p e ON a.c = e.c AND a.t = e.t + 2),
m AS (SELECT sum(z * dl) AS a, sum(z * dx) AS b, sum(dx * dl) AS c2, sum(dx * dx) AS d2, sum(z * dy) AS u, sum(dx * dy) AS v FROM d),
k AS (SELECT *, a * d2 - b * c2 AS det FROM m),
s AS (SELECT d2 / det AS q11, -b / det AS q12, -c2 / det AS q21, a / det AS q22, (d2 * u - b * v) / det AS b1, (a * v - c2 * u) / det AS b2 FROM k),
g AS (SELECT sum(z * (dy - b1 * dl - b2 * dx)) AS g1, sum(dx * (dy - b1 * dl - b2 * dx)) AS g2 FROM d, s GROUP BY d.c),
o AS (SELECT sum(g1 * g1) AS o11, sum(g1 * g2) AS o12, sum(g2 * g2) AS o22 FROM g),
r AS (SELECT b1, b2, sqrt(q11 * q11 * o11 + 2 * q11 * q12 * o12 + q12 * q12 * o22) AS s1,
      sqrt(q21 * q21 * o11 + 2 * q21 * q22 * o12 + q22 * q22 * o22) AS s2 FROM s, o)
SELECT 'L.spent' AS term, {S('b1')} AS coefficient, {S('s1')} AS se, {S('b1 / s1')} AS z_stat FROM r
UNION ALL SELECT 'orders', {S('b2')}, {S('s2')}, {S('b2 / s2')} FROM r""")
def q_arellano_bond_exact_fit(spark, sf):
    """As many instruments as coefficients: y(t-2) and dx, one step, robust covariance."""
    fit = dynpanel.arellano_bond(_customer_years(spark, sf), "spent", ["orders"], "o_custkey", "year", max_lag=1, collapse=True, steps=1)
    return fit.coefficients(spark).select("term", "coefficient", "se", "z_stat")


@register("arellano_bond_two_step")
def q_arellano_bond_two_step(spark, sf):
    fit = dynpanel.arellano_bond(_customer_years(spark, sf), "spent", ["orders"], "o_custkey", "year")
    coef = fit.coefficients(spark).select("term", F.col("coefficient").alias("value"), "se")
    return coef.unionByName(fit.test_table(spark).select(F.col("test").alias("term"), F.col("statistic").alias("value"), F.lit(None).cast("double").alias("se")))


# --------------------------------------------------------------------- T13
@register("tree_shapley_one_split", f"""
WITH d AS (SELECT l_extendedprice AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS x FROM lineitem),
g AS (SELECT x, avg(y) AS m, count(*) AS n FROM d GROUP BY x), a AS (SELECT avg(y) AS m FROM d)
SELECT 'big' AS feature, {S('sum(n * abs(g.m - a.m)) / sum(n)')} AS mean_abs_phi, CAST(sum(n) AS BIGINT) AS rows FROM g, a
UNION ALL SELECT 'none', 0.0, CAST(sum(n) AS BIGINT) FROM g""")
def q_tree_shapley_one_split(spark, sf):
    """One split: the value is the leaf's mean minus the overall mean; an unused feature gets zero."""
    d = _li(spark, sf).select("l_extendedprice", (F.col("l_quantity") > 25).cast("double").alias("big"), F.lit(1.0).alias("none"))
    m = trees.train_tree_model(d, "l_extendedprice", ["big", "none"], "tree", maxDepth=1)
    return (treeshap.TreeExplainer(m, d, ["big", "none"]).mean_absolute(d)
            .select("feature", sig_col("mean_abs_phi").alias("mean_abs_phi"), "rows"))


# ---------------------------------------------------------------------- X4
@register("isotonic_price_by_supplier", f"""
WITH p AS (SELECT CAST(l_suppkey % 97 AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS w, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
c AS (SELECT x, w, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs, s FROM p),
m AS (SELECT a.x AS a, b.x AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.x <= b.x),
l AS (SELECT k.x, m.a, min(m.mean) AS low FROM c k JOIN m ON m.a <= k.x AND m.b >= k.x GROUP BY k.x, m.a),
g AS (SELECT x, max(low) AS value FROM l GROUP BY x)
SELECT x AS score, {S('value')} AS value FROM g""")
def q_isotonic_price_by_supplier(spark, sf):
    """The fitted step at every score; the oracle is the max-min formula over all score ranges."""
    d = _li(spark, sf).select((F.col("l_suppkey") % 97).cast("double").alias("x"), "l_extendedprice")
    fit = isotonic(d, "l_extendedprice", "x", n_buckets=12)
    return fit.predict(d.select("x").distinct(), "x", "value").select(F.col("x").alias("score"), sig_col("value").alias("value"))


# --------------------------------------------------------------------- D16
def _discount_points(spark, sf):
    return _li(spark, sf).select(F.round(F.col("l_discount") * 100).alias("points"), (F.col("l_quantity") > 25).cast("double").alias("big"),
                                 "l_quantity", "l_tax")


@register("zip_saturated", f"""
WITH RECURSIVE d AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS g, round(l_discount * 100) AS y FROM lineitem),
c AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n0, sum(y) / count(*) FILTER (WHERE y > 0) AS m FROM d GROUP BY g),
it(g, i, mu) AS (SELECT g, 0, m FROM c UNION ALL SELECT it.g, i + 1, c.m * (1 - exp(-it.mu)) FROM it JOIN c ON it.g = c.g WHERE i < 80),
p AS (SELECT c.g, n, n0, mu, 1 - (n - n0) / n / (1 - exp(-mu)) AS p FROM c JOIN it ON c.g = it.g AND it.i = 80),
q AS (SELECT *, p / (p + (1 - p) * exp(-mu)) AS t FROM p),
f AS (SELECT g, ln(p / (1 - p)) AS a, ln(mu) AS b, n * p * (1 - p) - n0 * t * (1 - t) AS iaa, -n0 * t * (1 - t) * mu AS iab,
      n0 * (1 - t) * mu - n0 * t * (1 - t) * mu * mu + (n - n0) * mu AS ibb FROM q),
v AS (SELECT g, a, b, ibb / (iaa * ibb - iab * iab) AS va, iaa / (iaa * ibb - iab * iab) AS vb FROM f),
w AS (SELECT max(CASE WHEN g = 0 THEN a END) AS a0, max(CASE WHEN g = 1 THEN a END) AS a1, max(CASE WHEN g = 0 THEN b END) AS b0,
      max(CASE WHEN g = 1 THEN b END) AS b1, max(CASE WHEN g = 0 THEN va END) AS va0, sum(va) AS vas, max(CASE WHEN g = 0 THEN vb END) AS vb0, sum(vb) AS vbs FROM v)
SELECT 'inflate:const' AS term, {S('a0')} AS coefficient, {S('sqrt(va0)')} AS se FROM w
UNION ALL SELECT 'inflate:big', {S('a1 - a0')}, {S('sqrt(vas)')} FROM w
UNION ALL SELECT 'count:const', {S('b0')}, {S('sqrt(vb0)')} FROM w
UNION ALL SELECT 'count:big', {S('b1 - b0')}, {S('sqrt(vbs)')} FROM w""")
def q_zip_saturated(spark, sf):
    """A binary feature in both parts: a zero-inflated Poisson per group, its mean a fixed point."""
    fit = zero_inflated(_discount_points(spark, sf), "points", ["big"], ["big"])
    return fit.coefficients(spark).select("term", "coefficient", "se")


@register("zinb_returned_points")
def q_zinb_returned_points(spark, sf):
    """Discount points of an order's returned lines (none where no line is returned), by its number of lines."""
    points = F.when(F.col("l_returnflag") == "R", F.round(F.col("l_discount") * 100)).otherwise(0.0)
    d = _li(spark, sf).groupBy("l_orderkey").agg(F.sum(points).alias("points"), F.count(F.lit(1)).cast("double").alias("lines"))
    return zero_inflated(d, "points", ["lines"], ["lines"], "negbin").coefficients(spark)


# --------------------------------------------------------------------- D17
@register("heckman_saturated", f"""
WITH d AS (SELECT CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS g, CASE WHEN l_quantity + 300 * l_discount > 35 THEN 1 ELSE 0 END AS s, l_extendedprice AS y FROM lineitem),
c AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, CAST(sum(s) AS DOUBLE) AS n1, avg(s) AS p, avg(y) FILTER (WHERE s = 1) AS m,
      var_pop(y) FILTER (WHERE s = 1) AS v FROM d GROUP BY g), {_ppf_step('c', {'z': 'p'}, 'q')},
l AS (SELECT *, sqrt({_phi2('z')}) / p AS lam, p * (1 - p) / n / {_phi2('z')} AS vz FROM q),
e AS (SELECT *, pow(lam * (lam + z), 2) * vz AS vl, v / n1 AS vm FROM l),
w AS (SELECT a.m AS m0, b.m AS m1, a.lam AS l0, b.lam AS l1, a.vl AS vl0, b.vl AS vl1, a.vm AS vm0, b.vm AS vm1, (b.m - a.m) / (b.lam - a.lam) AS s,
      b.lam - a.lam AS dl FROM e a, e b WHERE a.g = 0 AND b.g = 1)
SELECT 'const' AS term, {S('m0 - s * l0')} AS coefficient,
       {S('sqrt(pow(1 + l0 / dl, 2) * vm0 + pow(l0 / dl, 2) * vm1 + pow(l0 * s / dl, 2) * vl1 + pow(s + l0 * s / dl, 2) * vl0)')} AS se FROM w
UNION ALL SELECT '_imr', {S('s')}, {S('sqrt((vm0 + vm1 + s * s * (vl0 + vl1)) / (dl * dl))')} FROM w""")
def q_heckman_saturated(spark, sf):
    """A binary selection feature and no outcome feature: the delta method on four group moments."""
    d = _li(spark, sf).select("l_extendedprice", (F.col("l_discount") > 0.05).cast("double").alias("cheap"),
                              (F.col("l_quantity") + 300 * F.col("l_discount") > 35).cast("double").alias("chosen"))
    return disc.heckman(d, "l_extendedprice", [], "chosen", ["cheap"])["outcome"].coefficients(spark).select("term", "coefficient", "se")


# ---------------------------------------------------------------------- T3
PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _quantiles_sql() -> str:
    rows = [("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_tax", "l_tax"), ("centred", "l_extendedprice - 40000.0")]
    return "\nUNION ALL\n".join(f"SELECT '{n}' AS term, CAST({p!r} AS DOUBLE) AS prob, {S(f'quantile_cont({e}, {p!r})')} AS value FROM lineitem" for n, e in rows for p in PROBS)


@register("quantiles_exact", _quantiles_sql())
def q_quantiles_exact(spark, sf):
    """Four columns, seven quantiles each, negative values among them."""
    d = _li(spark, sf).select("l_quantity", "l_extendedprice", "l_tax", (F.col("l_extendedprice") - 40000.0).alias("centred"))
    q = exact_quantiles(d, d.columns, PROBS)
    return spark.createDataFrame([(c, p, sig(v)) for c, vs in q.items() for p, v in zip(PROBS, vs)], "term string, prob double, value double")


@register("logit_effects_at_median", f"""WITH {SAT_CELLS},
m AS (SELECT median(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS xm FROM lineitem),
pp AS (SELECT *, 1.0 / (1.0 + exp(-(b0 + b1 * xm))) AS pm FROM f, m),
j AS (SELECT *, b1 * pm * (1 - pm) AS eff, b1 * pm * (1 - pm) * (1 - 2 * pm) AS j0,
      pm * (1 - pm) + b1 * pm * (1 - pm) * (1 - 2 * pm) * xm AS j1 FROM pp),
v AS (SELECT *, sqrt(j0 * j0 * v00 - 2 * j0 * j1 * v00 + j1 * j1 * v11) AS se FROM j)
SELECT 'status_f' AS term, {S('eff')} AS effect, {S('se')} AS se, {S('eff / se')} AS z_stat FROM v""")
def q_logit_effects_at_median(spark, sf):
    d = _binary_li(spark, sf)
    rows = interp.effects_at(d, disc.logit(d, "is_r", ["status_f"]), "median")
    return interp.effects_frame(spark, rows).select("term", "effect", "se", "z_stat")


# --------------------------------------------------------------------- E14
@register("mnlogit_cv_by_nation", f"""
WITH d AS (SELECT c_mktsegment AS y, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS x, c_nationkey AS f FROM customer),
c AS (SELECT f, x, y, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY f, x, y),
t AS (SELECT x, y, sum(n) AS n FROM c GROUP BY x, y),
g AS (SELECT fs.f, t.x, t.y, t.n - coalesce(c.n, 0) AS n, coalesce(c.n, 0) AS own FROM (SELECT DISTINCT f FROM d) fs, t
      LEFT JOIN c ON c.f = fs.f AND c.x = t.x AND c.y = t.y),
p AS (SELECT f, x, y, own, n / sum(n) OVER (PARTITION BY f, x) AS p FROM g)
SELECT CAST(f AS INTEGER) AS fold, CAST(sum(own) AS BIGINT) AS n, {S('-sum(own * ln(p)) / sum(own)')} AS log_loss FROM p GROUP BY f""")
def q_mnlogit_cv_by_nation(spark, sf):
    """25 folds fitted together; a binary feature, so every fold's model is its table of class shares."""
    d = load(spark, sf, "customer").withColumn("pos_balance", (F.col("c_acctbal") > 0).cast("double"))
    res = cross_validate_discrete(d, "c_mktsegment", ["pos_balance"], F.col("c_nationkey").cast("int"))
    return spark.createDataFrame([(int(r["fold"]), r["n"], sig(r["log_loss"])) for r in res], "fold int, n bigint, log_loss double")


@register("ordered_cv_by_year")
def q_ordered_cv_by_year(spark, sf):
    o = load(spark, sf, "orders").withColumn("price", F.col("o_totalprice") / 100000)
    res = cross_validate_discrete(o, "o_orderpriority", ["price"], F.year("o_orderdate"), "ordered")
    return spark.createDataFrame([(int(r["fold"]), r["n"], sig(r["log_loss"]), sig(r["accuracy"])) for r in res],
                                 "fold int, n bigint, log_loss double, accuracy double")


# ------------------------------------------------------------- R12 roll-ups
@register("segmented_ols_rollup", f"""
WITH g AS (SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS INTEGER) AS level, count(*) AS n,
  regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, level, 'const' AS term, {S('b0')} AS coefficient, n AS n_obs FROM g
UNION ALL SELECT l_returnflag, l_linestatus, level, 'l_quantity', {S('b1')}, n FROM g""")
def q_segmented_ols_rollup(spark, sf):
    return lin.segmented_ols_sets(_li(spark, sf), "l_extendedprice", ["l_quantity"], ["l_returnflag", "l_linestatus"]).select(
        "l_returnflag", "l_linestatus", "level", "term", "coefficient", "n_obs")


# ---------------------------------------------------------------------- R4
AR_ORDER = ", ".join(LI_ORDER)


@register("gls_block_ar", f"""
WITH l AS (SELECT l_extendedprice AS y, l_quantity AS x, lag(l_extendedprice) OVER w AS yl, lag(l_quantity) OVER w AS xl
           FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {AR_ORDER})),
t AS (SELECT CASE WHEN yl IS NULL THEN sqrt(0.91) ELSE 0.7 END AS c, CASE WHEN yl IS NULL THEN sqrt(0.91) * y ELSE y - 0.3 * yl END AS ty,
      CASE WHEN yl IS NULL THEN sqrt(0.91) * x ELSE x - 0.3 * xl END AS tx FROM l),
{_nc2_sql('t', 'c', 'tx', 'ty')}
{_nc2_select('l_quantity')}""")
def q_gls_block_ar(spark, sf):
    """Blocks of suppliers with AR(1) covariance of a known coefficient."""
    fit = lin.gls_block_ar(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey", LI_ORDER, [0.3])
    return fit.coefficients(spark).select("term", "coefficient", "se", "t_stat")


# ------------------------------------------------------------------ A9, V7
@register("assumption_report", f"""
WITH a AS ({O['breusch_pagan']}), b AS ({O['reset_test']})
SELECT test, statistic, flag FROM a UNION ALL SELECT test, statistic, NULL AS flag FROM b""")
def q_assumption_report(spark, sf):
    """Tests of the one-scan report whose statistics have SQL twins on the same fit; the others of the
    report are held against the single tests in ``tests/test_more_plans.py``."""
    li = _li(spark, sf)
    t = diag.validate_assumptions(spark, li, lin.ols(li, "l_extendedprice", ["l_quantity", "l_discount"]), normality=False)
    return t.where(F.col("test").isin("breusch_pagan", "reset")).select("test", "statistic", F.when(F.col("test") != "reset", F.col("flag")).alias("flag"))


# ------------------------------------------ iterative fits with SQL Newton oracles
def newton_sql(src: str, start: list[str], layers: list[dict[str, str]], score: list[str], info: dict[tuple[int, int], str], iters: int = 25, tag: str = "") -> str:
    """Recursive CTE ``it`` of Newton's method in SQL: parameters t0.. from the one-row table ``st``, rows of
    ``src`` (column n: their count), ``layers`` of derived columns, per-row score and information. ``f`` is the last
    iteration's row: the parameters and the inverse information v00, v01, ... (``tag`` is added to the names)."""
    k = len(start)
    t = ", ".join(f"t{j}" for j in range(k))
    inner = f"(SELECT it{tag}.*, r.* FROM it{tag}, {src} r WHERE i < {iters})"
    for layer in layers:
        inner = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM {inner})"
    sums = [f"sum(n * ({e})) AS s{j}" for j, e in enumerate(score)] + [f"sum(n * ({e})) AS h{i}{j}" for (i, j), e in info.items()]
    inner = f"(SELECT i, {t}, {', '.join(sums)} FROM {inner} GROUP BY i, {t})"
    # [H | I] by Gauss-Jordan steps without pivoting (H is positive definite near the optimum)
    m = {(i, j): f"h{min(i, j)}{max(i, j)}" if j < k else ("1.0" if j - k == i else "0.0") for i in range(k) for j in range(2 * k)}
    keep = f"i, {t}, {', '.join(f's{j}' for j in range(k))}"
    for p in range(k):
        nxt = {(i, j): f"({m[p, j]}) / ({m[p, p]})" if i == p else f"({m[i, j]}) - ({m[i, p]}) * ({m[p, j]}) / ({m[p, p]})" for i in range(k) for j in range(2 * k)}
        inner = f"(SELECT {keep}, {', '.join(f'{e} AS m{p}_{i}_{j}' for (i, j), e in nxt.items())} FROM {inner})"
        m = {(i, j): f"m{p}_{i}_{j}" for i, j in nxt}
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    step = ", ".join(f"t{i} + {' + '.join(f'{m[i, k + j]} * s{j}' for j in range(k))}" for i in range(k))
    base = ", ".join(f"CAST({e} AS DOUBLE)" for e in start)
    return (f"it{tag}(i, {t}, {', '.join(f'v{i}{j}' for i, j in pairs)}) AS (SELECT 0, {base}, {', '.join(['CAST(0 AS DOUBLE)'] * len(pairs))} FROM st{tag} UNION ALL "
            f"SELECT i + 1, {step}, {', '.join(m[i, k + j] for i, j in pairs)} FROM {inner}),\n"
            f"f{tag} AS (SELECT * FROM it{tag} WHERE i = {iters})")


def _fit_sql(terms: list[str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS term, {S(f't{j}')} AS coefficient, {S(f'sqrt(v{j}{j})')} AS se FROM f" for j, name in enumerate(terms))


def _linear_sql(w: str, u: str, xs: list[str]) -> tuple[list[str], dict]:
    """Score u x and information w x x' of a generalised linear model."""
    return [f"{u} * {x}" for x in xs], {(i, j): f"{w} * {xs[i]} * {xs[j]}" for i in range(len(xs)) for j in range(i, len(xs))}


BIN_CELLS = ("c AS (SELECT l_quantity / 10 AS x1, l_discount * 10 AS x2, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CAST(count(*) AS DOUBLE) AS n "
             "FROM lineitem GROUP BY ALL), st AS (SELECT ln(sum(n * y) / sum(n * (1 - y))) AS a, sum(n * y) / sum(n) AS m FROM c)")


def _binary_scaled(spark, sf):
    return _li(spark, sf).select((F.col("l_returnflag") == "R").cast("double").alias("is_r"), (F.col("l_quantity") / 10).alias("tens"),
                                 (F.col("l_discount") * 10).alias("discount"))


@register("logit_two_features", f"WITH RECURSIVE {BIN_CELLS},\n" + newton_sql(
    "c", ["a", "0", "0"], [{"p": "1 / (1 + exp(-(t0 + t1 * x1 + t2 * x2)))"}], *_linear_sql("p * (1 - p)", "(y - p)", ["1.0", "x1", "x2"])) + "\n"
    + _fit_sql(["const", "tens", "discount"]))
def q_logit_two_features(spark, sf):
    return disc.logit(_binary_scaled(spark, sf), "is_r", ["tens", "discount"]).coefficients(spark).select("term", "coefficient", "se")


_PROBIT = [{"z": "t0 + t1 * x1"}, {"q": norm_sf_sql("z"), "d": "exp(-z * z / 2) / sqrt(2 * pi())"}, {"l": "CASE WHEN y = 1 THEN d / (1 - q) ELSE -d / q END"}]


@register("probit_one_feature", f"WITH RECURSIVE {BIN_CELLS},\n" + newton_sql(
    "c", ["0", "0"], _PROBIT, *_linear_sql("(l * (l + z))", "l", ["1.0", "x1"])) + "\n" + _fit_sql(["const", "tens"]))
def q_probit_one_feature(spark, sf):
    return disc.probit(_binary_scaled(spark, sf), "is_r", ["tens"]).coefficients(spark).select("term", "coefficient", "se")


def _ordered_sql(levels: int, cdf: str, pdf: str, slope: str) -> str:
    """Ordered levels 1.. by one feature: t0 slope, t1.. cuts. ``cdf``, ``pdf`` and ``slope`` are SQL of {z}, {f}, {d}."""
    case = lambda back: "CASE y " + " ".join(f"WHEN {v} THEN t{v - back} - t0 * x" for v in range(1 + back, levels + back)) + " ELSE {} END"
    ends = {"a": case(0).format("36.0"), "b": case(1).format("-36.0")}
    both = {"fa": cdf.format(z="a"), "fb": cdf.format(z="b")}
    dens = {"da": f"CASE WHEN y = {levels} THEN 0.0 ELSE {pdf.format(z='a', f='fa')} END", "db": f"CASE WHEN y = 1 THEN 0.0 ELSE {pdf.format(z='b', f='fb')} END",
            "pr": f"CASE y WHEN 1 THEN fa WHEN {levels} THEN 1 - fb ELSE fa - fb END"}
    turn = {"ga": slope.format(z="a", f="fa", d="da"), "gb": slope.format(z="b", f="fb", d="db")}
    one = lambda v: f"(CASE WHEN y = {v} THEN 1.0 ELSE 0.0 END)"
    qa = ["-x"] + [one(v) for v in range(1, levels)]
    qb = ["-x"] + [one(v) for v in range(2, levels + 1)]
    own = {f"u{j}": f"(da * {qa[j]} - db * {qb[j]}) / pr" for j in range(levels)}
    info = {(i, j): f"u{i} * u{j} - (ga * {qa[i]} * {qa[j]} - gb * {qb[i]} * {qb[j]}) / pr" for i in range(levels) for j in range(i, levels)}
    return newton_sql("c", ["0"] + [f"a{j}" for j in range(1, levels)], [ends, both, dens, turn, own], [f"u{j}" for j in range(levels)], info)


_LOGISTIC = ("1 / (1 + exp(-{z}))", "{f} * (1 - {f})", "{d} * (1 - 2 * {f})")
_NORMAL = ("(1.0 - " + norm_sf_sql("{z}") + ")", "exp(-{z} * {z} / 2) / sqrt(2 * pi())", "-{z} * {d}")


LEVEL_SQL = ("c AS (SELECT o_totalprice / 100000 AS x, CASE WHEN o_orderpriority < '3' THEN 1 WHEN o_orderpriority < '4' THEN 2 ELSE 3 END AS y, 1.0 AS n FROM orders), "
             "m AS (SELECT avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS p1, avg(CASE WHEN y < 3 THEN 1.0 ELSE 0.0 END) AS p2 FROM c)")


def _levels(spark, sf):
    p = F.col("o_orderpriority")
    return load(spark, sf, "orders").select((F.col("o_totalprice") / 100000).alias("price"),
                                            F.when(p < "3", "1-high").when(p < "4", "2-mid").otherwise("3-low").alias("level"))


@register("ordered_logit_one_feature", f"WITH RECURSIVE {LEVEL_SQL}, st AS (SELECT ln(p1 / (1 - p1)) AS a1, ln(p2 / (1 - p2)) AS a2 FROM m),\n"
          + _ordered_sql(3, *_LOGISTIC) + "\n" + _fit_sql(["price", "cut_1-high|2-mid", "cut_2-mid|3-low"]))
def q_ordered_logit_one_feature(spark, sf):
    return disc.ordered(_levels(spark, sf), "level", ["price"]).coefficients(spark).select("term", "coefficient", "se")


@register("ordered_probit_one_feature", f"WITH RECURSIVE {LEVEL_SQL}, st AS (SELECT 0.6 * ln(p1 / (1 - p1)) AS a1, 0.6 * ln(p2 / (1 - p2)) AS a2 FROM m),\n"
          + _ordered_sql(3, *_NORMAL) + "\n"
          + _fit_sql(["price", "cut_1-high|2-mid", "cut_2-mid|3-low"]))
def q_ordered_probit_one_feature(spark, sf):
    return disc.ordered(_levels(spark, sf), "level", ["price"], "probit").coefficients(spark).select("term", "coefficient", "se")


_TOBIT = [{"z": "(y - t0 - t1 * x) / exp(t2)", "s": "exp(t2)"}, {"q": norm_sf_sql("-z"), "d": "exp(-z * z / 2) / sqrt(2 * pi())"}, {"l": "d / q"}, {"g": "-l * (z + l)"},
          {"u": "CASE WHEN y > 0 THEN z / s ELSE -l / s END", "v": "CASE WHEN y > 0 THEN z * z - 1 ELSE -l * z END",
           "uu": "CASE WHEN y > 0 THEN 1 / (s * s) ELSE -g / (s * s) END", "uv": "CASE WHEN y > 0 THEN 2 * z / s ELSE -(l + g * z) / s END",
           "vv": "CASE WHEN y > 0 THEN 2 * z * z ELSE -(l * z + g * z * z) END"}]


@register("tobit_one_feature", "WITH RECURSIVE c AS (SELECT l_quantity / 10 AS x, l_discount * 10 AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), "
          "st AS (SELECT avg(y) AS m, ln(stddev_pop(y)) AS ls FROM c),\n" + newton_sql(
              "c", ["m", "0", "ls"], _TOBIT, ["u", "u * x", "v"],
              {(0, 0): "uu", (0, 1): "uu * x", (0, 2): "uv", (1, 1): "uu * x * x", (1, 2): "uv * x", (2, 2): "vv"}) + "\n" + _fit_sql(["const", "tens", "log_sigma"]))
def q_tobit_one_feature(spark, sf):
    d = _li(spark, sf).select((F.col("l_discount") * 10).alias("discount"), (F.col("l_quantity") / 10).alias("tens"))
    return disc.tobit(d, "discount", ["tens"], lower=0.0).coefficients(spark).select("term", "coefficient", "se")


# -------------------------------------------------------------- D9, D18, S3, S10, E11, T9
@register("inverse_gaussian_saturated", f"""
WITH d AS (SELECT l_extendedprice / 1000 AS y, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS x FROM lineitem),
g AS (SELECT x, avg(y) AS mu, CAST(count(*) AS DOUBLE) AS n, var_pop(y) * count(*) AS ss FROM d GROUP BY x),
p AS (SELECT sum(ss / pow(mu, 3)) / (sum(n) - 2) AS phi FROM g),
f AS (SELECT a.mu AS m0, b.mu AS m1, phi * a.mu / a.n AS v0, phi * b.mu / b.n AS v1 FROM g a, g b, p WHERE a.x = 0 AND b.x = 1)
SELECT 'const' AS term, {S('ln(m0)')} AS coefficient, {S('sqrt(v0)')} AS se FROM f
UNION ALL SELECT 'status_f', {S('ln(m1 / m0)')}, {S('sqrt(v0 + v1)')} FROM f""")
def q_inverse_gaussian_saturated(spark, sf):
    d = _binary_li(spark, sf).withColumn("price", F.col("l_extendedprice") / 1000)
    return disc.glm(d, "price", ["status_f"], "inverse_gaussian", "log").coefficients(spark).select("term", "coefficient", "se")


@register("poisson_offset_saturated", f"""
WITH o AS (SELECT CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS e,
           CASE WHEN max(l_quantity) > 40 THEN 1 ELSE 0 END AS x FROM lineitem GROUP BY l_orderkey),
g AS (SELECT x, sum(y) AS s, sum(e) AS e FROM o GROUP BY x),
f AS (SELECT a.s AS s0, b.s AS s1, ln(a.s / a.e) AS b0, ln(b.s / b.e) AS b1, ln((a.s + b.s) / (a.e + b.e)) AS bn FROM g a, g b WHERE a.x = 0 AND b.x = 1)
SELECT 'const' AS term, {S('b0')} AS value, {S('1 / sqrt(s0)')} AS se FROM f
UNION ALL SELECT 'big', {S('b1 - b0')}, {S('sqrt(1 / s0 + 1 / s1)')} FROM f
UNION ALL SELECT 'lr_stat', {S('2 * (s0 * b0 + s1 * b1 - (s0 + s1) * bn)')}, NULL FROM f
UNION ALL SELECT 'mean_prediction', (SELECT {S('sum(y) / count(*)')} FROM o), NULL""")
def q_poisson_offset_saturated(spark, sf):
    """Returned lines per order with the log of all lines as offset: rates by group; the offset is in the null
    model and in the predictions."""
    d = _li(spark, sf).groupBy("l_orderkey").agg(F.sum((F.col("l_returnflag") == "R").cast("double")).alias("returned"),
                                                 F.log(F.count(F.lit(1)).cast("double")).alias("log_lines"),
                                                 (F.max("l_quantity") > 40).cast("double").alias("big"))
    fit = disc.poisson(d, "returned", ["big"], offset="log_lines")
    mean = score.predict_discrete(fit, d).agg(F.avg("prediction")).first()[0]
    rows = [(t, sig(b), sig(s)) for t, b, s in zip(fit.terms, fit.theta, fit.se)] + [("lr_stat", sig(fit.lr_test()[0]), None), ("mean_prediction", sig(mean), None)]
    return spark.createDataFrame(rows, "term string, value double, se double")


@register("table_source_ols", O["ols_coefficients"])
def q_table_source_ols(spark, sf):
    """The OLS table of ``ols_coefficients`` from a named table of the catalog."""
    register_tables(spark, sf, ["lineitem"])
    return _same_as(spark, sf, "ols_coefficients", scan(spark, "lineitem"))


def _same_as(spark, sf, name, li):
    fit = lin.ols(li, "l_extendedprice", ["l_quantity"])
    want = [f.name for f in Q[name](spark, sf).schema]
    return fit.coefficients(spark).select(*want)


@register("prediction_sink", f"""
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, var_pop(l_quantity) * count(*) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b1,
  regr_intercept(l_extendedprice, l_quantity) AS b0, (regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity))
  / (count(*) - 2) AS s2 FROM lineitem),
p AS (SELECT b0 + b1 * l_quantity AS p, sqrt(s2 * (1.0 / n + pow(l_quantity - mx, 2) / sxx)) AS se,
      l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS id FROM lineitem, s)
SELECT count(*) AS n, count(DISTINCT id) AS row_ids, {S('avg(p)')} AS prediction, {S('avg(se)')} AS se,
       'row_id,prediction,se,ci_lower,ci_upper,predicted_at,schema_version,model_id' AS columns FROM p""")
def q_prediction_sink(spark, sf):
    """Predictions with intervals written to the sink and read again: specified columns and row ids."""
    li = _li(spark, sf)
    keys = LI_ORDER[:4]
    path = stream.scratch(spark, "predictions")
    reg.write_predictions(score.predict_linear(lin.ols(li, "l_extendedprice", ["l_quantity"]), li, "mean", keep=keys), path, "price_ols_20240101_abc123", keys)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("row_ids"), sig_col(F.avg("prediction")).alias("prediction"),
                    sig_col(F.avg("se")).alias("se"), F.first(F.lit(",".join(back.columns))).alias("columns"))


@register("confidence_forms", """
WITH c AS (SELECT count(*) AS n FROM lineitem), f AS (SELECT n, least(0.2, 0.05 * pow(n, 0.3)) AS size FROM c)
SELECT 'interpretation' AS kind, round(0.6 + size, 4) AS confidence FROM f
UNION ALL SELECT 'registry', round(0.5 + size + 0.15 * 0.4 + 0.4 * 0.25 + 0.1 * 2 / 3, 4) FROM f
UNION ALL SELECT 'registry, rows only', round(0.5 + size, 4) FROM f""")
def q_confidence_forms(spark, sf):
    n = _li(spark, sf).count()
    rows = [("interpretation", ev.confidence_interpretation(n)), ("registry", ev.confidence_registry(n, 0.4, 0.75, ["PASS", "WARN", "PASS"])),
            ("registry, rows only", ev.confidence_registry(n))]
    return spark.createDataFrame(rows, "kind string, confidence double")


@register("bootstrap_effects_logit")
def q_bootstrap_effects_logit(spark, sf):
    d = _li(spark, sf).select(*LI_ORDER, (F.col("l_returnflag") == "R").cast("double").alias("is_r"), (F.col("l_quantity") / 10).alias("tens"))
    b = interp.poisson_bootstrap_effects(d, disc.logit(d.drop("l_quantity"), "is_r", ["tens"]), LI_ORDER, B=100)
    return b.select("term", *[sig_col(c).alias(c) for c in ("mean", "se", "ci_lower", "ci_upper")])


@register("panel_two_way_days")
def q_panel_two_way_days(spark, sf):
    """Effects of suppliers and of thousands of shipping days (more periods than a matrix on the driver takes)."""
    fit = panel.within(_li(spark, sf), "l_extendedprice", ["l_quantity"], "l_suppkey", "l_shipdate")
    return fit.coefficients(spark).select("term", "coefficient", "se")


# ---------------------------------------- oracles of fits registered in ``catalog``
RAW_CELLS = ("c AS (SELECT l_quantity AS x1, l_discount AS x2, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS x3, "
             "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), "
             "st AS (SELECT ln(sum(n * y) / sum(n * (1 - y))) AS a FROM c)")


def _logit_newton(xs: list[str], src: str = "c", tag: str = "") -> str:
    eta = " + ".join(f"t{j} * {x}" for j, x in enumerate(xs))
    return newton_sql(src, ["a"] + ["0"] * (len(xs) - 1), [{"p": f"1 / (1 + exp(-({eta})))"}], *_linear_sql("p * (1 - p)", "(y - p)", xs), tag=tag)


def _probit_newton(xs: list[str], tag: str = "") -> str:
    layers = [{"z": " + ".join(f"t{j} * {x}" for j, x in enumerate(xs))}, *_PROBIT[1:]]
    return newton_sql("c", ["0"] * len(xs), layers, *_linear_sql("(l * (l + z))", "l", xs), tag=tag)


_X12 = ["1.0", "x1", "x2"]
O["probit_fit"] = f"WITH RECURSIVE {RAW_CELLS},\n{_probit_newton(_X12)}\n" + _coef_sql(
    [("const", "t0", "sqrt(v00)"), ("l_quantity", "t1", "sqrt(v11)"), ("l_discount", "t2", "sqrt(v22)")])
O["tobit_discount"] = ("WITH RECURSIVE c AS (SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), "
                       "st AS (SELECT avg(y) AS m, ln(stddev_pop(y)) AS ls FROM c),\n" + newton_sql(
                           "c", ["m", "0", "ls"], _TOBIT, ["u", "u * x", "v"],
                           {(0, 0): "uu", (0, 1): "uu * x", (0, 2): "uv", (1, 1): "uu * x * x", (1, 2): "uv * x", (2, 2): "vv"}) + "\n"
                       + _coef_sql([("const", "t0", "sqrt(v00)"), ("l_quantity", "t1", "sqrt(v11)"), ("log_sigma", "t2", "sqrt(v22)")]))
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PRIORITY_CELLS = ("c AS (SELECT o_totalprice AS x, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y, 1.0 AS n FROM orders), "
                   "m AS (SELECT " + ", ".join(f"avg(CASE WHEN y <= {j} THEN 1.0 ELSE 0.0 END) AS p{j}" for j in range(1, 5)) + " FROM c), "
                   "st AS (SELECT " + ", ".join("{0}ln(p%d / (1 - p%d)) AS a%d" % (j, j, j) for j in range(1, 5)) + " FROM m)")
_CUT_TERMS = ["o_totalprice"] + [f"cut_{a}|{b}" for a, b in zip(_PRIORITIES, _PRIORITIES[1:])]
O["ordered_probit_priority"] = (f"WITH RECURSIVE {_PRIORITY_CELLS.format('0.6 * ')},\n" + _ordered_sql(5, *_NORMAL) + "\n"
                                + _coef_sql([(t, f"t{j}", f"sqrt(v{j}{j})") for j, t in enumerate(_CUT_TERMS)]))
_LEVEL_PARTS = [f"(f{j} * (1 - f{j}))" for j in range(1, 5)]
O["effects_by_level_ordered"] = (
    f"WITH RECURSIVE {_PRIORITY_CELLS.format('')},\n" + _ordered_sql(5, *_LOGISTIC) + ",\n"
    + "z AS (SELECT t0, " + ", ".join(f"1 / (1 + exp(-(t{j} - t0 * x))) AS f{j}" for j in range(1, 5)) + " FROM c, f),\n"
    + "d AS (SELECT any_value(t0) AS b, " + ", ".join(f"avg({e}) AS d{j}" for j, e in enumerate(_LEVEL_PARTS, start=1)) + ", 0.0 AS d0, 0.0 AS d5 FROM z)\n"
    + "\nUNION ALL\n".join(f"SELECT 'o_totalprice' AS term, '{lv}' AS level, {S(f'-b * (d{j} - d{j - 1})')} AS effect FROM d" for j, lv in enumerate(_PRIORITIES, start=1)))
_SHARES = ["f1", "f2 - f1", "f3 - f2", "f4 - f3", "1 - f4"]
@register("probability_curves_long", f"WITH RECURSIVE {_PRIORITY_CELLS.format('')},\n" + _ordered_sql(5, *_LOGISTIC) + ",\n"
          "g AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 9 AS x FROM (SELECT min(x) AS lo, max(x) AS hi FROM c), (SELECT unnest(range(10)) AS i)),\n"
          "z AS (SELECT g.i AS grid_index, g.x, " + ", ".join(f"1 / (1 + exp(-(t{j} - t0 * g.x))) AS f{j}" for j in range(1, 5)) + " FROM g, f)\n"
          + "\nUNION ALL\n".join(f"SELECT grid_index, {S('x')} AS grid_value, '{lv}' AS level, {S(e)} AS probability FROM z" for lv, e in zip(_PRIORITIES, _SHARES)))
def q_probability_curves_long(spark, sf):
    """The curves of ``probability_curves_ordered``, a row per grid point and level."""
    o = load(spark, sf, "orders")
    fit = disc.ordered(o, "o_orderpriority", ["o_totalprice"])
    pc = interp.probability_curves(o, fit, "o_totalprice", 10)
    names = F.array(*[F.lit(c) for c in fit.classes])
    return (pc.select("grid_index", sig_col("grid_value").alias("grid_value"), F.posexplode("probabilities").alias("k", "p"))
            .select("grid_index", "grid_value", F.get(names, F.col("k")).alias("level"), sig_col("p").alias("probability")))


O["importance_rank_ame"] = (
    f"WITH RECURSIVE {RAW_CELLS},\n{_logit_newton([*_X12, 'x3'])},\n"
    "a AS (SELECT sum(n * p * (1 - p)) / sum(n) AS w FROM (SELECT n, 1 / (1 + exp(-(t0 + t1 * x1 + t2 * x2 + t3 * x3))) AS p FROM c, f)),\n"
    "e AS (SELECT 'l_quantity' AS term, t1 * w AS effect FROM f, a UNION ALL SELECT 'l_discount', t2 * w FROM f, a UNION ALL SELECT 'status_f', t3 * w FROM f, a)\n"
    f"SELECT CAST(row_number() OVER (ORDER BY abs(effect) DESC) AS INTEGER) AS rank, term, {S('effect')} AS effect FROM e")
O["effects_at_median"] = (
    f"WITH RECURSIVE {RAW_CELLS},\n{_logit_newton(_X12)},\n"
    "m AS (SELECT median(l_quantity) AS x1, median(l_discount) AS x2 FROM lineitem),\n"
    "p AS (SELECT *, 1 / (1 + exp(-(t0 + t1 * x1 + t2 * x2))) AS p FROM f, m), w AS (SELECT *, p * (1 - p) AS w, p * (1 - p) * (1 - 2 * p) AS d FROM p),\n"
    "j AS (SELECT 'l_quantity' AS term, t1 * w AS e, t1 * d AS j0, w + t1 * d * x1 AS j1, t1 * d * x2 AS j2, * FROM w\n"
    "UNION ALL SELECT 'l_discount', t2 * w, t2 * d, t2 * d * x1, w + t2 * d * x2, * FROM w),\n"
    "s AS (SELECT term, e, sqrt(j0 * j0 * v00 + j1 * j1 * v11 + j2 * j2 * v22 + 2 * (j0 * j1 * v01 + j0 * j2 * v02 + j1 * j2 * v12)) AS se FROM j)\n"
    f"SELECT term, {S('e')} AS effect, {S('se')} AS se, {S('e / se')} AS z_stat, {S('2 * ' + norm_sf_sql('abs(e / se)'))} AS p_value FROM s")
O["linktest_logit"] = (
    f"WITH RECURSIVE {RAW_CELLS},\n{_logit_newton(_X12)},\n"
    "h AS (SELECT y, n, t0 + t1 * x1 + t2 * x2 AS e FROM c, f), hm AS (SELECT sum(n * e) / sum(n) AS m FROM h), hs AS (SELECT m, sqrt(sum(n * pow(e - m, 2)) / sum(n)) AS sd FROM h, hm GROUP BY m),\n"
    "c2 AS (SELECT y, n, (e - m) / sd AS x1, pow((e - m) / sd, 2) AS x2 FROM h, hs), stb AS (SELECT a FROM st),\n"
    f"{_logit_newton(_X12, 'c2', 'b')}, z AS (SELECT t2 / sqrt(v22) AS z FROM fb)\n"
    f"SELECT 'linktest' AS test, {S('z')} AS statistic, CAST(1.0 AS DOUBLE) AS df, {S('2 * ' + norm_sf_sql('abs(z)'))} AS p_value, {flag_sql('2 * ' + norm_sf_sql('abs(z)'))} AS flag FROM z")
O["vuong_logit_probit"] = (
    f"WITH RECURSIVE {RAW_CELLS}, sta AS (SELECT a FROM st), stb AS (SELECT a FROM st),\n{_logit_newton(_X12, 'c', 'a')},\n{_probit_newton(_X12, 'b')},\n"
    "p AS (SELECT n, y, 1 / (1 + exp(-(fa.t0 + fa.t1 * x1 + fa.t2 * x2))) AS p, fb.t0 + fb.t1 * x1 + fb.t2 * x2 AS z FROM c, fa, fb),\n"
    f"q AS (SELECT n, y, p, 1.0 - {norm_sf_sql('z')} AS q FROM p), d AS (SELECT n, y * ln(p / q) + (1 - y) * ln((1 - p) / (1 - q)) AS d FROM q),\n"
    "m AS (SELECT sum(n) AS n, sum(n * d) / sum(n) AS m FROM d), s AS (SELECT any_value(m.n) AS n, any_value(m) AS m, sqrt(sum(d.n * pow(d - m, 2)) / sum(d.n)) AS s FROM d, m),\n"
    "z AS (SELECT sqrt(n) * m / s AS z FROM s)\n"
    f"SELECT 'vuong' AS test, {S('z')} AS statistic, CAST(NULL AS DOUBLE) AS df, {S('2 * ' + norm_sf_sql('abs(z)'))} AS p_value, "
    "CASE WHEN z > 1.96 THEN 'MODEL1' WHEN z < -1.96 THEN 'MODEL2' ELSE 'TIE' END AS flag FROM z")
O["sample_size_and_cutpoints"] = """
WITH c AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, min(n) AS least, 50.0 + 8 * count(*) AS need FROM c)
SELECT 'n_ge_50_plus_8k' AS rule, n AS value, CAST(need AS DOUBLE) AS threshold, CASE WHEN n >= need THEN 'PASS' ELSE 'WARN' END AS flag FROM t
UNION ALL SELECT 'min_class_count', least, 50.0, CASE WHEN least >= 100 THEN 'PASS' WHEN least >= 50 THEN 'WARN' ELSE 'FAIL' END FROM t
UNION ALL SELECT 'cutpoints_monotone', 1.0, 1.0, 'PASS'"""
_ZIP_LAYERS = [{"mu": "exp(t2 + t3 * x)", "p": "1 / (1 + exp(-(t0 + t1 * z)))"}, {"l0": "p + (1 - p) * exp(-mu)"},
               {"d": "CASE WHEN y = 0 THEN p / l0 ELSE 0.0 END", "sb": "y - mu"}, {"v": "d * (1 - d)"},
               {"ga": "d - p", "gb": "(1 - d) * sb", "ia": "p * (1 - p) - v", "ic": "v * sb", "ib": "(1 - d) * mu - v * sb * sb"}]
O["zip_discount_points"] = (
    "WITH RECURSIVE c AS (SELECT l_quantity AS x, l_tax AS z, round(l_discount * 100) AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), "
    "st AS (SELECT ln(sum(CASE WHEN y = 0 THEN n END) / sum(CASE WHEN y > 0 THEN n END)) AS a, ln(sum(n * y) / sum(CASE WHEN y > 0 THEN n END)) AS b FROM c),\n"
    + newton_sql("c", ["a", "0", "b", "0"], _ZIP_LAYERS, ["ga", "ga * z", "gb", "gb * x"],
                 {(0, 0): "ia", (0, 1): "ia * z", (0, 2): "ic", (0, 3): "ic * x", (1, 1): "ia * z * z", (1, 2): "ic * z", (1, 3): "ic * x * z",
                  (2, 2): "ib", (2, 3): "ib * x", (3, 3): "ib * x * x"})
    + ",\nq AS (SELECT y, n, exp(t2 + t3 * x) AS mu, 1 / (1 + exp(-(t0 + t1 * z))) AS p FROM c, f),\n"
      "l AS (SELECT sum(n * CASE WHEN y = 0 THEN ln(p + (1 - p) * exp(-mu)) ELSE ln(1 - p) + y * ln(mu) - mu - lgamma(y + 1) END) AS llf FROM q)\n"
    + "\nUNION ALL\n".join(f"SELECT '{t}' AS term, {S(f't{j}')} AS value FROM f"
                           for j, t in enumerate(["inflate:const", "inflate:l_tax", "count:const", "count:l_quantity"]))
    + f"\nUNION ALL\nSELECT 'llf', {S('llf')} FROM l")


# ------------------------------------------------------------- A17, V5, C2
@register("student_resid_summary", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')}, f AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s),
r AS (SELECT (l_extendedprice - (b0 + b1 * l_quantity)) / sqrt(s2 * (1 - (1.0 / n + pow(l_quantity - xbar, 2) / sxx))) AS t, n,
      1.0 / n + pow(l_quantity - xbar, 2) / sxx AS h FROM lineitem, f)
SELECT {S('max(t)')} AS largest, {S('min(t)')} AS smallest, {S('avg(abs(t))')} AS mean_abs, count(*) FILTER (WHERE abs(t) > 2) AS beyond_two,
       count(*) FILTER (WHERE h > 4.0 / n) AS high_leverage FROM r""")
def q_student_resid_summary(spark, sf):
    li = _li(spark, sf)
    inf = diag.influence(li, lin.ols(li, "l_extendedprice", ["l_quantity"]))
    t = F.col("student_resid")
    return inf.agg(sig_col(F.max(t)).alias("largest"), sig_col(F.min(t)).alias("smallest"), sig_col(F.avg(F.abs(t))).alias("mean_abs"),
                   F.sum((F.abs(t) > 2).cast("long")).alias("beyond_two"), F.sum(F.col("high_leverage").cast("long")).alias("high_leverage"))


@register("resid_histogram_density", f"""
WITH {ols1_cte('lineitem', 'l_extendedprice', 'l_quantity')},
r AS (SELECT l_extendedprice - (b0 + b1 * l_quantity) AS e FROM lineitem, s),
m AS (SELECT min(e) AS lo, max(e) AS hi, avg(e) AS mu, stddev_pop(e) AS sd, count(*) AS n FROM r),
b AS (SELECT DISTINCT CAST(least(floor((e - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin FROM r, m),
c AS (SELECT bin, lo + (bin + 0.5) * ((hi - lo) / 30) AS c, m.* FROM b, m)
SELECT bin, {S('c')} AS center, {S('exp(-pow((c - mu) / sd, 2) / 2) / (sqrt(2 * pi()) * sd) * n * ((hi - lo) / 30)')} AS normal_count FROM c""")
def q_resid_histogram_density(spark, sf):
    li = _li(spark, sf)
    h = rep.resid_histogram(li, lin.ols(li, "l_extendedprice", ["l_quantity"]), 30)
    return h.select("bin", sig_col("center").alias("center"), sig_col("normal_count").alias("normal_count"))


_DID = ("c AS (SELECT l_extendedprice AS y, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS a, "
        "CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 1.0 ELSE 0.0 END AS b, l_quantity AS q, l_discount AS d, 1.0 AS n FROM lineitem), st AS (SELECT 0 AS a)")
_DID_X = ["1.0", "a", "b", "(a * b)", "q", "d"]


@register("did_with_controls", f"WITH RECURSIVE {_DID},\n" + newton_sql(
    "c", ["0"] * 6, [{"e": "y - (" + " + ".join(f"t{j} * {x}" for j, x in enumerate(_DID_X)) + ")"}], *_linear_sql("1.0", "e", _DID_X), iters=3)
    + ",\ng AS (SELECT sum(pow(y - (" + " + ".join(f"t{j} * {x}" for j, x in enumerate(_DID_X)) + "), 2)) / (count(*) - 6) AS s2 FROM c, f)\n"
    + f"SELECT {S('t3')} AS did, {S('sqrt(s2 * v33)')} AS se FROM f, g")
def q_did_with_controls(spark, sf):
    d = _li(spark, sf).select("l_extendedprice", "l_quantity", "l_discount", (F.col("l_returnflag") == "R").cast("double").alias("treat"),
                              (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("double").alias("post"))
    r = causal.did(d, "l_extendedprice", "treat", "post", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(sig(r["did"]), sig(r["se"]))], "did double, se double")

