"""Distribution functions against published critical values."""

import math

import pytest

from plumbline.functions import special as S


@pytest.mark.parametrize(("got", "want"), [
    (S.normal_sf(1.959964), 0.025), (S.t_two_sided(2.228139, 10), 0.05), (S.t_two_sided(12.7062, 1), 0.05), (S.chi2_sf(3.841459, 1), 0.05), (S.chi2_sf(18.307, 10), 0.05),
    (S.f_sf(3.708265, 3, 10), 0.05), (S.f_sf(4.964603, 1, 10), 0.05), (S.studentized_range_sf(3.877, 3, 10), 0.05), (S.studentized_range_sf(4.232, 5, 20), 0.05),
    (S.binomial_two_sided(2, 10), 0.109375), (S.fisher_two_sided(3, 1, 1, 3), 0.4857143),
])
def test_critical_values(got, want):
    assert got == pytest.approx(want, rel=2e-3)


def test_inverses():
    assert S.t_ppf(0.975, 5) == pytest.approx(2.570582, rel=1e-5)
    assert S.studentized_range_ppf(0.95, 4, 12) == pytest.approx(4.199, rel=2e-3)
    assert S.beta_i(2, 3, 0.5) == pytest.approx(0.6875)
    assert S.gamma_p(0.5, 1.0) == pytest.approx(math.erf(1.0))
    assert S.kolmogorov_sf(1.3581 / math.sqrt(10_000), 10_000) == pytest.approx(0.05, rel=0.02)
