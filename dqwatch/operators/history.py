"""Measures over earlier days. Windows run over one row per pattern and day, so they stay short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqwatch.functions.naming import normalized_pattern
from dqwatch.operators.listings import comparable, today

Z_95 = 1.96


def daily_volumes(manifest: DataFrame, day: str | Column = "snapshot_day") -> DataFrame:
    """Comparable volume per source, pattern and day.

    A manifest of one snapshot that carries months of files can pass ``to_date('uploaded_at')``.
    """
    day = F.col(day) if isinstance(day, str) else day
    return (
        comparable(today(manifest))
        .groupBy(day.alias("day"), "source_id", normalized_pattern(F.col("filename")).alias("pattern"))
        .agg(F.sum("rows").alias("volume"))
        .filter(F.col("volume").isNotNull())
    )


def band_bounds(min_days: int, z: float) -> dict[str, Column]:
    """Mean, lower and upper bound from ``n_days``, ``sum_volume`` and ``sum_squares``; NULL for fewer than ``min_days``."""
    n, total = F.col("n_days"), F.col("sum_volume")
    known = n >= max(min_days, 2)
    spread = (n.cast("decimal(10,0)") * F.col("sum_squares") - total * total).cast("double")
    mean, deviation = total.cast("double") / n, F.sqrt(spread / (n * (n - 1)))
    return {
        "mean_volume": F.when(known, mean),
        "lower": F.when(known, mean - z * deviation),
        "upper": F.when(known, mean + z * deviation),
    }


def volume_bands(volumes: DataFrame, n_days: int = 8, min_days: int = 3, z: float = Z_95) -> DataFrame:
    """Bounds from the previous ``n_days`` volumes of the same weekday, and whether today leaves them.

    Days with fewer than ``min_days`` earlier volumes have NULL bounds and are neither inside nor outside. Sums and
    sums of squares are exact integers, so the result does not depend on row order.
    """
    earlier = (
        Window.partitionBy("source_id", "pattern", F.dayofweek("day"))
        .orderBy("day")
        .rowsBetween(-n_days, -1)
    )
    exact = F.col("volume").cast("decimal(18,0)")
    return (
        volumes.withColumn("n_days", F.count("volume").over(earlier))
        .withColumn("sum_volume", F.sum(exact).over(earlier).cast("decimal(19,0)"))
        .withColumn("sum_squares", F.sum((exact * exact).cast("decimal(28,0)")).over(earlier).cast("decimal(28,0)"))
        .withColumn("lowest", F.min("volume").over(earlier))
        .withColumn("highest", F.max("volume").over(earlier))
        .withColumns(band_bounds(min_days, z))
        .withColumn(
            "outside", (F.col("volume") < F.col("lower")) | (F.col("volume") > F.col("upper"))
        )
        .drop("sum_volume", "sum_squares")
    )


def recurrence(findings: DataFrame, days: int = 7) -> DataFrame:
    """For every finding's pattern and day: on how many of the previous ``days`` it occurred as well."""
    daily = findings.groupBy("snapshot_day", "source_id", "detector", "kind", "pattern").agg(
        F.count(F.lit(1)).alias("n_findings")
    )
    day_number = F.datediff("snapshot_day", F.lit("1970-01-01").cast("date"))
    earlier = (
        Window.partitionBy("source_id", "detector", "kind", "pattern")
        .orderBy(day_number)
        .rangeBetween(-days, -1)
    )
    return daily.withColumn("earlier_days", F.count(F.lit(1)).over(earlier)).withColumn(
        "is_recurring", F.col("earlier_days") > 0
    )
