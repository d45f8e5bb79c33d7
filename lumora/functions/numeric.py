"""Tail probabilities for one-row results, and the normal distribution for column batches."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return gamma_sf(dof / 2.0, x / 2.0)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(b, a, 1 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + even * d or tiny)
        c = 1 + even / c or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + odd * d or tiny)
        c = 1 + odd / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h / a


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, dof: float) -> float:
    return beta_cdf(dof / 2, 0.5, dof / (dof + t * t))


def _tail(fn):
    """Column form of a scalar tail function, for result rows (one per key, lag or pair)."""

    @F.pandas_udf("double")
    def batch(*args: pd.Series) -> pd.Series:
        rows = zip(*args)
        return pd.Series(
            [None if any(v is None or v != v for v in r) else fn(*map(float, r)) for r in rows], dtype="float64"
        )

    return batch


def chi2_p(stat: Column, dof: Column) -> Column:
    return F.when(dof > 0, _tail(chi2_sf)(stat, dof))


def f_p(stat: Column, d1: Column, d2: Column) -> Column:
    return F.when((d1 > 0) & (d2 > 0), _tail(f_sf)(stat, d1, d2))


def t_p(stat: Column, dof: Column) -> Column:
    return F.when(dof > 0, _tail(t_two_sided)(stat, dof))


def normal_p(stat: Column) -> Column:
    return _tail(normal_two_sided)(stat)


def phi(z: Column) -> Column:
    """Standard normal distribution function of a column."""

    @F.pandas_udf("double")
    def batch(v: pd.Series) -> pd.Series:
        root = math.sqrt(2.0)
        return pd.Series([0.5 * math.erfc(-x / root) for x in v.to_numpy(dtype=float)], dtype="float64")

    return batch(z)


def phi_inverse(p: Column) -> Column:
    """Standard normal quantile of a column of probabilities in (0, 1)."""

    @F.pandas_udf("double")
    def batch(v: pd.Series) -> pd.Series:
        return pd.Series([_NORMAL.inv_cdf(x) for x in v.to_numpy(dtype=float)], dtype="float64")

    return batch(p)


def log_normal_cdf(z: np.ndarray) -> np.ndarray:
    root = math.sqrt(2.0)
    return np.array([math.log(max(0.5 * math.erfc(-x / root), 1e-300)) for x in z])
