"""Column expressions that stay inside whole-stage codegen (no UDFs).

Also the significant-digit rounding used on every statistic we emit. The
same sequence of IEEE operations is written three times (Spark column,
Python float, DuckDB SQL) so that a value rounded in any of them is
bit-identical: multiply or divide by an exactly representable power of ten,
round half away from zero, undo.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIG_DIGITS = 6
ZERO_SNAP = 1e-11  # |x| below this is reported as 0 (float noise around exact zeros)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------- links
def logistic(z) -> Column:
    z = col(z)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def norm_pdf(z) -> Column:
    z = col(z)
    return F.exp(F.lit(-0.5) * z * z) / F.lit(math.sqrt(2 * math.pi))


# fixed values: Hart's double-precision rational approximation of the
# normal tail (numerator and denominator coefficients, highest order first)
_HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165,
             33.912866078383, 112.079291497871, 221.213596169931,
             220.206867912376)
_HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207,
             86.7807322029461, 296.564248779674, 637.333633378831,
             793.826512519948, 440.413735824752)


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_tail(z) -> Column:
    """P(Z > |z|) as a column, relative accuracy ~1e-14 over the range."""
    a = F.abs(col(z))
    e = F.exp(-a * a / F.lit(2.0))
    near = e * _horner(_HART_NUM, a) / _horner(_HART_DEN, a)
    cf = a + F.lit(0.65)
    cf = a + F.lit(4.0) / cf
    cf = a + F.lit(3.0) / cf
    cf = a + F.lit(2.0) / cf
    cf = a + F.lit(1.0) / cf
    far = e / cf / F.lit(2.506628274631)
    return (F.when(a > F.lit(37.0), F.lit(0.0))
            .when(a < F.lit(7.07106781186547), near).otherwise(far))


def norm_cdf(z) -> Column:
    z = col(z)
    t = norm_tail(z)
    return F.when(z > 0, F.lit(1.0) - t).otherwise(t)


def norm_tail_py(z: float) -> float:
    """Python twin of :func:`norm_tail` (for tests and the driver)."""
    a = abs(z)
    if a > 37:
        return 0.0
    e = math.exp(-a * a / 2)
    if a < 7.07106781186547:
        num = 0.0
        for c in _HART_NUM:
            num = num * a + c
        den = 0.0
        for c in _HART_DEN:
            den = den * a + c
        return e * num / den
    cf = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = a + k / cf
    return e / cf / 2.506628274631


# ------------------------------------------------- significant rounding
def _half_away(v: float) -> float:
    a = abs(v)
    f = math.floor(a)
    r = f + 1.0 if a - f >= 0.5 else f
    return math.copysign(r, v) if r != 0 else 0.0


def sig(x, digits: int = SIG_DIGITS):
    """Round a Python float to ``digits`` significant digits (None/NaN kept)."""
    if x is None:
        return None
    x = float(x)
    if math.isnan(x) or math.isinf(x) or abs(x) < ZERO_SNAP:
        return 0.0 if abs(x) < ZERO_SNAP else x
    e = math.floor(math.log10(abs(x)))
    k = digits - 1 - e
    if k >= 0:
        p = 10.0 ** k
        return _half_away(x * p) / p
    p = 10.0 ** (-k)
    return _half_away(x / p) * p


def sig_col(c, digits: int = SIG_DIGITS) -> Column:
    """Spark column twin of :func:`sig`."""
    x = col(c)
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up = F.round(x * F.pow(F.lit(10.0), k), 0) / F.pow(F.lit(10.0), k)
    down = F.round(x / F.pow(F.lit(10.0), -k), 0) * F.pow(F.lit(10.0), -k)
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf"))), x)
            .when(F.abs(x) < F.lit(ZERO_SNAP), F.lit(0.0))
            .when(k >= 0, up).otherwise(down))


def sig_sql(expr: str, digits: int = SIG_DIGITS) -> str:
    """DuckDB SQL twin of :func:`sig` for an expression string."""
    x = f"CAST(({expr}) AS DOUBLE)"
    k = f"({digits - 1} - CAST(floor(log10(abs({x}))) AS BIGINT))"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) OR isinf({x}) THEN {x} "
            f"WHEN abs({x}) < {ZERO_SNAP!r} THEN 0.0 "
            f"WHEN {k} >= 0 THEN round({x} * pow(10.0, {k})) / pow(10.0, {k}) "
            f"ELSE round({x} / pow(10.0, -{k})) * pow(10.0, -{k}) END)")
