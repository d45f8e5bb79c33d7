"""Bias-adjusted shape statistics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def adjusted_skew(c: Column) -> Column:
    """G1 = sqrt(n(n-1))/(n-2) · g1, null below three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(c))


def adjusted_kurtosis(c: Column) -> Column:
    """G2, the bias-adjusted excess kurtosis; null below four values or without spread."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(
        (n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    )
