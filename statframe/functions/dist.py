"""Distribution functions evaluated on the driver for a handful of scalars.

Normal, Student t, chi-square, F and Kolmogorov distributions written on
``math.lgamma``/``math.erfc`` with continued fractions (no scipy).
"""

from __future__ import annotations

import math

_EPS = 1e-15
_FPMIN = 1e-300


# ---------------------------------------------------------------- normal
def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def norm_ppf(p: float) -> float:
    """Inverse normal cdf: rational start (Acklam) + two Halley steps on erfc."""
    if not 0.0 < p < 1.0:
        if p == 0.0:
            return -math.inf
        if p == 1.0:
            return math.inf
        return math.nan
    # fixed values: Acklam's rational approximation coefficients
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00)
    plow = 0.02425
    if p < plow:
        q = math.sqrt(-2 * math.log(p))
        x = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    elif p <= 1 - plow:
        q = p - 0.5
        r = q * q
        x = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / \
            (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    else:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    for _ in range(2):
        e = norm_cdf(x) - p
        u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
        x = x - u / (1 + x * u / 2)
    return x


# ------------------------------------------------------- incomplete gamma
def _gser(a: float, x: float) -> float:
    gln = math.lgamma(a)
    ap, s, dl = a, 1.0 / a, 1.0 / a
    for _ in range(10000):
        ap += 1
        dl *= x / ap
        s += dl
        if abs(dl) < abs(s) * _EPS:
            break
    return s * math.exp(-x + a * math.log(x) - gln)


def _gcf(a: float, x: float) -> float:
    gln = math.lgamma(a)
    b = x + 1 - a
    c = 1 / _FPMIN
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        if abs(d) < _FPMIN:
            d = _FPMIN
        c = b + an / c
        if abs(c) < _FPMIN:
            c = _FPMIN
        d = 1 / d
        de = d * c
        h *= de
        if abs(de - 1) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def gammainc_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x)."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        return _gser(a, x)
    return 1.0 - _gcf(a, x)


def gammainc_upper(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1.0 - _gser(a, x)
    return _gcf(a, x)


# -------------------------------------------------------- incomplete beta
def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1, a - 1
    c = 1.0
    d = 1 - qab * x / qap
    if abs(d) < _FPMIN:
        d = _FPMIN
    d = 1 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        if abs(d) < _FPMIN:
            d = _FPMIN
        c = 1 + aa / c
        if abs(c) < _FPMIN:
            c = _FPMIN
        d = 1 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        if abs(d) < _FPMIN:
            d = _FPMIN
        c = 1 + aa / c
        if abs(c) < _FPMIN:
            c = _FPMIN
        d = 1 / d
        de = d * c
        h *= de
        if abs(de - 1) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


# ------------------------------------------------------------ t, chi2, F
def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isinf(df):
        return norm_sf(t)
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2, 0.5, x)
    return tail if t >= 0 else 1 - tail


def t_cdf(t: float, df: float) -> float:
    return 1.0 - t_sf(t, df)


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or math.isnan(t):
        return math.nan
    if math.isinf(df) or df > 1e7:
        return 2 * norm_sf(abs(t))
    return betainc(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    if x is None or math.isnan(x):
        return math.nan
    return gammainc_upper(df / 2, x / 2)


def chi2_cdf(x: float, df: float) -> float:
    return gammainc_lower(df / 2, x / 2)


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f):
        return math.nan
    if f <= 0:
        return 1.0
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def t_ppf(p: float, df: float) -> float:
    if math.isinf(df) or df > 1e7:
        return norm_ppf(p)
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1 - p, df)
    return _invert(lambda t: t_cdf(t, df), p, 0.0, 10.0)


def chi2_ppf(p: float, df: float) -> float:
    return _invert(lambda x: chi2_cdf(x, df), p, 0.0, max(10.0, 2 * df))


def f_ppf(p: float, d1: float, d2: float) -> float:
    return _invert(lambda x: 1 - f_sf(x, d1, d2), p, 0.0, 10.0)


# ------------------------------------------------------------ Kolmogorov
def kolmogorov_sf(lam: float) -> float:
    """Asymptotic P(K > lam) = 2 sum (-1)^(j-1) exp(-2 j^2 lam^2)."""
    if lam <= 0:
        return 1.0
    s = 0.0
    for j in range(1, 200):
        term = (-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam)
        s += term
        if abs(term) < 1e-16:
            break
    return max(0.0, min(1.0, 2 * s))


def ks_two_sample_p(d: float, n1: float, n2: float) -> float:
    """Two-sample KS p-value with the usual effective-n correction."""
    en = math.sqrt(n1 * n2 / (n1 + n2))
    return kolmogorov_sf((en + 0.12 + 0.11 / en) * d)
