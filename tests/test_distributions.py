import math

import pytest

from shopstat.functions.distributions import chi2_upper_p, reg_incomplete_beta, t_two_sided_p


@pytest.mark.parametrize("t,df", [(0.5, 3.0), (-0.841922, 6025.97), (2.0, 10.0), (4.5, 4.2), (1.3, 60151.0),
                                  (10.0, 2.5), (0.0, 7.0)])
def test_t_p_matches_commons_math(spark, t, df):
    jdist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(df)
    expected = 2 * jdist.cumulativeProbability(-abs(t))
    assert t_two_sided_p(t, df) == pytest.approx(expected, abs=1e-11)


@pytest.mark.parametrize("x,k", [(3.841458820694124, 1), (0.5, 2), (9.49, 4), (20.0, 7), (150.0, 120), (0.01, 3)])
def test_chi2_p_matches_commons_math(spark, x, k):
    jdist = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(k))
    expected = 1 - jdist.cumulativeProbability(x)
    assert chi2_upper_p(x, k) == pytest.approx(expected, abs=1e-11)


def test_known_values():
    assert t_two_sided_p(2.0, 10.0) == pytest.approx(0.0733880347, abs=1e-9)
    assert chi2_upper_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert reg_incomplete_beta(2.0, 3.0, 0.0) == 0.0 and reg_incomplete_beta(2.0, 3.0, 1.0) == 1.0


def test_degenerate_inputs():
    assert t_two_sided_p(None, 3.0) is None
    assert t_two_sided_p(float("nan"), 3.0) is None
    assert t_two_sided_p(math.inf, 3.0) == 0.0
    assert chi2_upper_p(0.0, 2) == 1.0


@pytest.mark.parametrize("df", [1e6, 1e8, 1e10, 1e12, 1e13])
@pytest.mark.parametrize("t", [0.01, 1.0, 3.0])
def test_large_degrees_of_freedom_tend_to_the_normal(df, t):
    assert t_two_sided_p(t, df) == pytest.approx(math.erfc(t / math.sqrt(2)), abs=1e-6)
    assert reg_incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)
