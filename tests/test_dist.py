"""Distribution functions against published table values."""
import math

import pytest

from statframe.functions import dist
from statframe.functions.columns import norm_tail_py


@pytest.mark.parametrize("p,df,expected", [(0.975, 10, 2.228), (0.975, 30, 2.042), (0.95, 5, 2.015)])
def test_t_quantiles(p, df, expected):
    assert round(dist.t_ppf(p, df), 3) == expected


@pytest.mark.parametrize("p,df,expected", [(0.95, 2, 5.991), (0.95, 1, 3.841), (0.99, 10, 23.209)])
def test_chi2_quantiles(p, df, expected):
    assert round(dist.chi2_ppf(p, df), 3) == expected


def test_f_quantile_and_closed_forms():
    assert round(dist.f_ppf(0.95, 2, 10), 3) == 4.103
    x, d = 1.7, 12.0
    assert dist.f_sf(x, 2, d) == pytest.approx((1 + 2 * x / d) ** (-d / 2), rel=1e-12)
    assert dist.chi2_sf(3.3, 2) == pytest.approx(math.exp(-3.3 / 2), rel=1e-12)


def test_normal():
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    for z in (-6.0, -2.5, -0.3, 0.0, 0.7, 3.0, 6.5):
        exact = 0.5 * math.erfc(abs(z) / math.sqrt(2))
        assert norm_tail_py(z) == pytest.approx(exact, rel=1e-12)


def test_t_two_sided_matches_normal_for_large_df():
    assert dist.t_two_sided_p(1.96, 1e9) == pytest.approx(0.05, abs=1e-4)
    assert dist.kolmogorov_sf(1.36) == pytest.approx(0.0494, abs=1e-3)
