"""Scalar expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(start: Column, end: Column) -> Column:
    return (start + end) / 2


def distance(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Distance of two regions' centres."""
    return F.abs(center(start_a, end_a) - center(start_b, end_b))


def distance_penalty(alpha: float, d: Column, unit_distance: float = 1000, s: float = 0.75) -> Column:
    """alpha * (1 - (unit / d) ** s), and 0 up to the unit distance (at distance 0 too)."""
    return F.when(d <= unit_distance, 0.0).otherwise(F.lit(float(alpha)) * (1 - F.pow(F.lit(float(unit_distance)) / d, F.lit(float(s)))))


def sample_covariance(n: Column | int, sxy: Column, sx: Column, sy: Column) -> Column:
    """Covariance from sums over n observations, absent ones being zeros."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("double")  # as an int its square overflows from 46,341 observations on
    return (n * sxy - sx * sy) / (n * (n - 1))


def correlation(cov: Column, var_a: Column, var_b: Column, tol: float = 1e-20) -> Column:
    """Covariance over standard deviations; a deviation under ``tol`` counts as 1."""
    sd = lambda v: F.when(F.sqrt(v) < tol, 1.0).otherwise(F.sqrt(v))
    return cov / (sd(var_a) * sd(var_b))


def soft_threshold(x: Column, by: Column) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))
