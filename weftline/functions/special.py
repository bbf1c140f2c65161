"""Special functions as column expressions (Spark SQL has none of these)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Abramowitz & Stegun 7.1.26, |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Acklam's rational approximation of the inverse normal
# distribution, relative error < 1.15e-9.
QUANTILE_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
QUANTILE_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
QUANTILE_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
QUANTILE_LOW = 0.02425


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    size = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * size)
    tail = _poly((*reversed(ERF_A), 0.0), t) * F.exp(-size * size)
    return F.signum(x) * (F.lit(1.0) - tail)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(2.0**0.5)))


def two_sided_normal_p(z: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution; NULL outside (0, 1)."""
    q = p - F.lit(0.5)
    r = q * q
    middle = _poly(QUANTILE_A, r) * q / _poly(QUANTILE_B, r)
    low_t = F.sqrt(F.lit(-2.0) * F.ln(p))
    high_t = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    low = _poly(QUANTILE_C, low_t) / _poly(QUANTILE_D, low_t)
    high = -_poly(QUANTILE_C, high_t) / _poly(QUANTILE_D, high_t)
    inside = (p > 0) & (p < 1)
    return F.when(inside, F.when(p < QUANTILE_LOW, low).when(p > 1 - QUANTILE_LOW, high).otherwise(middle))


def kolmogorov_p(lam: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov tail, 2 * sum((-1)^(k-1) exp(-2 k^2 lam^2))."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    # the series does not settle near zero, where the tail is 1
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * total)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete beta continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return out


def _student_p(t: float, dof: float) -> float:
    from math import exp, isnan, lgamma, log

    if t is None or dof is None or isnan(t) or isnan(dof):
        return np.nan
    a, b, x = dof / 2.0, 0.5, dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def student_two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student p-value; meant for results of a few rows."""
    return pd.Series([_student_p(a, b) for a, b in zip(t, dof)], dtype="float64")
