"""Tail probabilities of Student's t and chi-square distributions.

Used only on the one-row result of a test, after Spark has reduced the data
to moments or counts.  Plain Python (``math``) wrapped in pandas UDFs.

- t: two-sided p = I_x(df/2, 1/2), x = df / (df + t^2), the regularised
  incomplete beta function by its continued fraction (DLMF 8.17.22).
- chi-square: upper tail Q(k/2, x/2) of the regularised gamma function by
  its power series (DLMF 8.7.1) or continued fraction (DLMF 8.9.2).

Continued fractions are evaluated from the inside out at a depth that is
doubled until two results agree; a fraction that doesn't settle is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AGREE = 1e-14
_DEPTHS = [1 << i for i in range(5, 23)]


def _settled(at_depth: Callable[[int], float]) -> float:
    """The value at growing depths, once two in a row agree."""
    last = None
    for depth in _DEPTHS:
        value = at_depth(depth)
        if last is not None and abs(value - last) <= _AGREE * abs(value):
            return value
        last = value
    raise ArithmeticError("a continued fraction did not settle")


def _log_beta(a: float, b: float) -> float:
    """ln B(a, b); for one large argument the difference of its log gammas
    comes from the asymptotic series (DLMF 5.11.13), as subtracting two large
    numbers would leave no digits."""
    small, large = sorted((a, b))
    if large < 1e3 or small > 100:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # ln G(z + s) - ln G(z) for large z
    s, z = small, large
    rise = s * math.log(z) + s * (s - 1) / (2 * z) - s * (s - 1) * (2 * s - 1) / (12 * z * z) + (s * (s - 1)) ** 2 / (12 * z ** 3)
    return math.lgamma(s) - rise


def _beta_fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + d1 / (1 + d2 / ...)) of DLMF 8.17.22."""
    def part(n: int) -> float:
        m, odd = divmod(n, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    def at_depth(depth: int) -> float:
        inner = 1.0
        for n in range(depth, 0, -1):
            inner = 1.0 + part(n) / inner
        return 1.0 / inner
    return _settled(at_depth)


def _beta_pair(a: float, b: float, x: float, rest: float) -> float:
    """I_x(a, b), given x and 1 - x both with all their digits."""
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    log_rest = math.log(rest) if rest < 0.5 else math.log1p(-x)
    front = math.exp(a * log_x + b * log_rest - _log_beta(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def reg_incomplete_beta(a: float, b: float, x: float) -> float:
    return _beta_pair(a, b, x, 1.0 - x)


def t_two_sided_p(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t with (possibly fractional) df."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return _beta_pair(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def reg_upper_gamma(a: float, x: float) -> float:
    """Q(a, x) = Gamma(a, x) / Gamma(a)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        total, term, n = 0.0, 1.0 / a, 0
        while term > total * _AGREE / 100:
            total += term
            n += 1
            term *= x / (a + n)
        return 1.0 - front * total

    def at_depth(depth: int) -> float:
        inner = x
        for n in range(depth, 0, -1):
            inner = x + (n - a) / (1.0 + n / inner)
        return 1.0 / inner
    return front * _settled(at_depth)


def chi2_upper_p(stat: float | None, dof: float | None) -> float | None:
    if stat is None or dof is None or math.isnan(stat) or dof <= 0:
        return None
    return reg_upper_gamma(dof / 2.0, stat / 2.0)


def _none_if_nan(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(_none_if_nan(a), _none_if_nan(b)) for a, b in zip(t, df)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2_p_udf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper_p(_none_if_nan(a), _none_if_nan(b)) for a, b in zip(stat, dof)],
                     dtype="float64")


def t_p_value(t: Column, df: Column) -> Column:
    return _t_p_udf(t.cast("double"), df.cast("double"))


def chi2_p_value(stat: Column, dof: Column) -> Column:
    return _chi2_p_udf(stat.cast("double"), dof.cast("double"))
