"""Aggregates with the null rules of session features, exact medians and robust summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .circular import col


def sample_std(c: Column | str) -> Column:
    """Sample deviation; 0 for a single value, null for none."""
    return F.when(F.count(col(c)) == 1, 0.0).otherwise(F.stddev_samp(col(c)))


def exact_median(c: Column | str) -> Column:
    return F.percentile(col(c), F.lit(0.5))


def shown(c: Column | str, digits: int = 4) -> Column:
    """A number for display: rounded after a nudge that no tie of short decimals survives."""
    return F.round(col(c) + 3.3 * 10.0 ** -(digits + 2), digits)


def robust_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, median, min, max, range, mad, q25, q75, iqr, mean and population std of finite values by key.

    Two aggregations: the median first, joined back for the median of absolute deviations. Null and non-finite values
    are left out; a group without any has no row.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    first = rows.groupBy(*keys).agg(
        F.count("*").alias("count"), exact_median("v").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile("v", F.lit(0.25)).alias("q25"), F.percentile("v", F.lit(0.75)).alias("q75"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
    )
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    joined = rows.alias("r").join(first.select(*keys, "median").alias("f"), same) if keys else rows.alias("r").crossJoin(F.broadcast(first.select("median").alias("f")))
    mad = joined.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(exact_median(F.abs(F.col("v") - F.col("median"))).alias("mad"))
    both = first.alias("f").join(mad.alias("m"), [F.col(f"f.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]) if keys else first.crossJoin(mad)
    return both.select(*[F.col(f"f.{k}").alias(k) for k in keys], "count", "median", "min", "max", (F.col("max") - F.col("min")).alias("range"), "mad", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"), "mean", "std")
