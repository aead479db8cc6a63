"""Angles in degrees as Column expressions. Remainders are never negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def angular_distance(a: Column | str, b: Column | str) -> Column:
    """Shortest distance on the circle, 0 to 180."""
    return F.abs(F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0)


def mean_cos(c: Column | str) -> Column:
    return F.avg(F.cos(F.radians(col(c))))


def mean_sin(c: Column | str) -> Column:
    return F.avg(F.sin(F.radians(col(c))))


def circular_mean(c: Column | str) -> Column:
    """Aggregate: direction of the mean vector, 0 to 360; null without rows."""
    return F.pmod(F.degrees(F.atan2(mean_sin(c), mean_cos(c))), F.lit(360.0))


def resultant(c: Column | str) -> Column:
    """Aggregate: length of the mean vector, 0 (no direction) to 1."""
    return F.sqrt(mean_cos(c) ** 2 + mean_sin(c) ** 2)


def circular_std(c: Column | str) -> Column:
    """Aggregate for live bursts: the length is held within [1e-12, 1]."""
    return F.degrees(F.sqrt(-2.0 * F.ln(F.least(F.lit(1.0), F.greatest(resultant(c), F.lit(1e-12))))))


def circular_std_dataset(c: Column | str) -> Column:
    """Aggregate for session features: 180 where the mean vector vanishes."""
    r = resultant(c)
    return F.when(r <= 1e-12, 180.0).otherwise(F.degrees(F.sqrt(F.greatest(F.lit(0.0), -2.0 * F.ln(F.least(F.lit(1.0), F.greatest(r, F.lit(1e-12))))))))
