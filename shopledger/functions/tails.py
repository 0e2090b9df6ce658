"""Upper-tail probabilities for the summary rows of statistical tests.

The test statistics are distributed aggregates; only their few result rows pass through these
Arrow-batched functions.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package: the functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-squared variable, by recurrence over the degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2:
        tail, a = math.erfc(math.sqrt(half)), 0.5
    else:
        tail, a = math.exp(-half), 1.0
    while a < df / 2.0:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1.0))
        a += 1.0
    return min(tail, 1.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1_000_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(Gamma(a + b) / Gamma(a)); by series where the difference would cancel."""
    if a < 1e5 or b > a / 100:
        return math.lgamma(a + b) - math.lgamma(a)
    series = b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)
    return b * math.log(a) + series + (b * (b - 1)) ** 2 / (12 * a**3)


def f_tail(x: float, df1: float, df2: float) -> float:
    """P(X > x) of an F variable, as a regularised incomplete beta."""
    if x <= 0:
        return 1.0
    a, b = df2 / 2.0, df1 / 2.0
    z = df2 / (df2 + df1 * x)
    if z >= 1.0:
        return 1.0
    ratio = df1 * x / df2
    rest = ratio / (1.0 + ratio)  # 1 - z, without its cancellation
    gammas = _log_gamma_ratio(a, b) - math.lgamma(b) if a >= b else _log_gamma_ratio(b, a) - math.lgamma(a)
    front = math.exp(gammas - a * math.log1p(ratio) + b * math.log(rest))
    if z < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, z) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(v) or k < 1 else chi2_tail(v, int(k)) for v, k in zip(x, df)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def f_p_value(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(v) or p < 1 or q < 1 else f_tail(v, p, q)
            for v, p, q in zip(x, df1, df2)
        ],
        dtype="float64",
    )
