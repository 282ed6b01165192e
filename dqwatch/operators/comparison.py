"""Today's files against last week's files: by exact name and by pattern.

A file can match several baseline files. Each operator returns one row per file with the number of
matches and the extremes over them, which is what the thresholds look at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dqwatch.functions.naming import entity_e3
from dqwatch.functions.numbers import hours_between, pct_change
from dqwatch.operators.lookup import lookup
from dqwatch.operators.patterns import FILE_IDENTITY, files_against_baseline, last
from dqwatch.schema import COMPARABLE_STATUSES

HOURS_LIMIT = 4
VOLUME_LIMIT = 50
ROWS_LIMIT = 10



def filename_compare(manifest: DataFrame, **options: int) -> DataFrame:
    """Row counts of files that carry the same name in both periods."""
    rows = F.col("rows")
    paired = files_against_baseline(
        manifest,
        [F.min(last(rows)).alias("lastweek_rows_min"), F.max(last(rows)).alias("lastweek_rows_max")],
        "exact",
        F.lit(True),
        F.lit(True),
        **options,
    )
    return paired.select(
        "snapshot_day",
        "source_id",
        "filename",
        "uploaded_at",
        rows.alias("today_rows"),
        "n_baseline",
        "lastweek_rows_min",
        "lastweek_rows_max",
        (rows - F.col("lastweek_rows_max")).alias("difference_min"),
        (rows - F.col("lastweek_rows_min")).alias("difference_max"),
    )


def volume_files(manifest: DataFrame, mode: str = "literal", **options: int) -> DataFrame:
    """Percent and absolute change of each comparable file against its pattern's baseline files."""
    rows, ok = F.col("rows"), F.col("status").isin(COMPARABLE_STATUSES)
    low, high = F.col("lastweek_volume_min"), F.col("lastweek_volume_max")
    paired = files_against_baseline(
        manifest,
        [F.min(last(rows)).alias("lastweek_volume_min"), F.max(last(rows)).alias("lastweek_volume_max")],
        mode,
        ok,
        ok & (rows > 0),
        **options,
    )
    return paired.select(
        "snapshot_day",
        "source_id",
        "filename",
        "uploaded_at",
        entity_e3(F.col("filename")).alias("entity_name"),
        "pattern",
        rows.alias("today_volume"),
        "n_baseline",
        low.alias("lastweek_volume_min"),
        high.alias("lastweek_volume_max"),
        pct_change(rows, high).alias("pct_change_min"),
        pct_change(rows, low).alias("pct_change_max"),
        F.greatest(F.abs(rows - low), F.abs(rows - high)).alias("abs_difference_max"),
    )


def significant_volumes(volumes: DataFrame, limit: float = VOLUME_LIMIT) -> DataFrame:
    """Files that differ by more than ``limit`` percent from some baseline file."""
    return volumes.filter((F.col("pct_change_max") > limit) | (F.col("pct_change_min") < -limit))


def timing_files(
    manifest: DataFrame, mode: str = "literal", shift_days: int = 7, **options: int
) -> DataFrame:
    """Upload time of each file against its pattern's baseline uploads, moved by ``shift_days``.

    Seven days compares like with like; zero reproduces the raw timestamp difference.
    Baseline files without an upload time count in ``n_baseline`` and give no difference.
    """
    at = F.col("uploaded_at")
    paired = files_against_baseline(
        manifest,
        [F.min(last(at)).alias("lastweek_first"), F.max(last(at)).alias("lastweek_last")],
        mode,
        F.lit(True),
        F.lit(True),
        **options,
    )
    shift = F.make_dt_interval(days=F.lit(shift_days))
    return paired.select(
        "snapshot_day",
        "source_id",
        "filename",
        entity_e3(F.col("filename")).alias("entity_name"),
        "pattern",
        at.alias("today_time"),
        "n_baseline",
        "lastweek_first",
        "lastweek_last",
        hours_between(at, F.col("lastweek_last") + shift).alias("hour_difference_min"),
        hours_between(at, F.col("lastweek_first") + shift).alias("hour_difference_max"),
    )


def late_against_last_week(timings: DataFrame, hours: float = HOURS_LIMIT) -> DataFrame:
    """Files more than ``hours`` after some baseline upload, most delayed first."""
    return timings.filter(F.col("hour_difference_max") > hours).orderBy(
        F.desc("hour_difference_max"), "source_id", "filename"
    )


def early_against_last_week(timings: DataFrame, hours: float = HOURS_LIMIT) -> DataFrame:
    early = timings.withColumn("hours_early", -F.col("hour_difference_min"))
    return early.filter(F.col("hours_early") > hours)


def empty_with_baseline(manifest: DataFrame, mode: str = "exact", **options: int) -> DataFrame:
    """Every empty file of today with last week's row counts, NULL where the name has no baseline."""
    rows = F.col("rows")
    paired = files_against_baseline(
        manifest,
        [F.min(last(rows)).alias("lastweek_rows_min"), F.max(last(rows)).alias("lastweek_rows_max")],
        mode,
        rows == 0,
        F.lit(True),
        how="left",
        **options,
    )
    return paired.select(
        "snapshot_day",
        "source_id",
        "filename",
        "uploaded_at",
        rows.alias("today_rows"),
        F.coalesce("n_baseline", F.lit(0)).cast("bigint").alias("n_baseline"),
        "lastweek_rows_min",
        "lastweek_rows_max",
    )


def filled_last_week_empty_today(
    manifest: DataFrame, rows_limit: int = ROWS_LIMIT, **options: int
) -> DataFrame:
    """Last week's files above ``rows_limit`` rows whose name is absent, empty or unsized today."""
    is_today, rows = F.col("from_period") == "today", F.col("rows")
    keys = ["snapshot_day", "source_id", "filename"]
    stats = manifest.groupBy(*keys).agg(
        F.count_if(~is_today & (rows > rows_limit)).alias("n"),
        F.count_if(is_today).alias("n_today"),
        F.count_if(is_today & (F.coalesce(rows, F.lit(0)) == 0)).alias("n_today_empty"),
    )
    kept = stats.filter((F.col("n") > 0) & ((F.col("n_today") == 0) | (F.col("n_today_empty") > 0)))
    baseline = manifest.filter(~is_today & (rows > rows_limit))
    return lookup(
        baseline,
        kept.drop("n"),
        keys,
        "inner",
        key_counts=stats.select(*keys, "n"),
        salt_on=FILE_IDENTITY,
        **options,
    ).select(*keys, "uploaded_at", rows.alias("lastweek_rows"), "n_today", "n_today_empty")
