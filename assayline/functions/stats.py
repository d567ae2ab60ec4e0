"""Percentiles by rank and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 where bottom is 0."""
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def nearest_rank(value: str, p: float) -> Column:
    """Aggregate: the value of rank ceil(p/100 * n); null without values."""
    return F.expr(f"percentile_disc({p / 100}) within group (order by {value})")


def rounded_rank(df: DataFrame, keys: list[str], value: str, points: dict[str, float], times: Column | None = None) -> DataFrame:
    """One row a group with, for each named p, the value of rank p/100 * n rounded half to even, at least 1.
    times: how often a row counts, once where it is not given.

    Values are counted first, with partial counts before the shuffle, so that windows run over distinct values only.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_k"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    seen = counted.withColumn("_upto", F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_k").over(w))

    def rank(p: float) -> Column:
        return F.least(F.greatest(F.bround(F.lit(p / 100.0) * F.col("_n")).cast("long"), F.lit(1)), F.col("_n"))

    return seen.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= rank(p), F.col(value))).alias(name) for name, p in points.items()))
