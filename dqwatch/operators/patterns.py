"""Filename patterns of both periods, folded into one row per source-day and pattern.

Every comparison between today and the same weekday a week before reads from this table: missing
patterns, volumes, empty files and upload times. It is one aggregation with map-side combine, so a
pattern that holds a large part of all files costs one partial row per task, and nothing is paired
file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dqwatch.functions.naming import base_pattern, entity_e2, normalized_pattern
from dqwatch.operators.lookup import lookup
from dqwatch.schema import COMPARABLE_STATUSES

KEYS = ["snapshot_day", "source_id", "pattern"]
FILE_IDENTITY = ["filename", "uploaded_at"]
PATTERN_MODES = {
    "normalized": normalized_pattern,
    "literal": base_pattern,
    "exact": lambda name: name,
}


def with_pattern(manifest: DataFrame, mode: str = "normalized") -> DataFrame:
    """Adds ``pattern``; mode ``given`` keeps the column the manifest brings along."""
    if mode == "given":
        return manifest
    return manifest.withColumn("pattern", PATTERN_MODES[mode](F.col("filename")))


def pattern_stats(manifest: DataFrame, mode: str = "normalized") -> DataFrame:
    """Counts, volumes and arrival range per pattern, for today and for last week.

    All measures are numbers or times, so Spark aggregates by hashing; a text measure would make it sort.
    """
    is_today, is_last = F.col("from_period") == "today", F.col("from_period") == "last_weekday"
    ok, rows = F.col("status").isin(COMPARABLE_STATUSES), F.col("rows")

    return (
        with_pattern(manifest, mode)
        .groupBy(*KEYS)
        .agg(
            F.count_if(is_today).alias("n_today"),
            F.count_if(is_last).alias("n_last"),
            F.count_if(is_today & ok).alias("ok_today"),
            F.count_if(is_last & ok).alias("ok_last"),
            F.sum(F.when(is_today, rows)).alias("rows_today"),
            F.sum(F.when(is_today & ok, rows)).alias("volume_today"),
            F.sum(F.when(is_last & ok, rows)).alias("volume_last"),
            F.max(F.when(is_last, rows)).alias("max_rows_last"),
            F.min(F.when(is_today, F.col("uploaded_at"))).alias("first_upload_today"),
            F.min(F.when(is_last, F.col("uploaded_at"))).alias("first_upload_last"),
            F.max(F.when(is_last, F.col("uploaded_at"))).alias("last_upload_last"),
        )
    )


def files_against_baseline(
    manifest: DataFrame, baseline: list[Column], mode: str, files: Column, base: Column, how: str = "inner", **options: int
) -> DataFrame:
    """Today's files, each with last week's aggregates of its pattern.

    The aggregates stand for all pairs of a file with the baseline files of its pattern: the extreme
    over the pairs is the extreme against the smallest or the largest baseline value.
    """
    named = with_pattern(manifest, mode)
    is_today, is_last = F.col("from_period") == "today", F.col("from_period") == "last_weekday"
    stats = (
        named.filter((is_today & files) | (is_last & base))
        .groupBy(*KEYS)
        .agg(
            F.count_if(is_today).alias("n"),
            F.count_if(is_last).alias("n_baseline"),
            *baseline,
        )
    )
    facts = stats.filter(F.col("n_baseline") > 0).drop("n")
    return lookup(
        named.filter(is_today & files),
        facts,
        KEYS,
        how,
        key_counts=stats.select(*KEYS, "n"),
        salt_on=FILE_IDENTITY,
        **options,
    )


def last(value: Column) -> Column:
    """``value`` of a last-week row, NULL on today's rows."""
    return F.when(F.col("from_period") == "last_weekday", value)


def missing_patterns(manifest: DataFrame, mode: str = "literal") -> DataFrame:
    """Patterns delivered last week and not today, with their count and an example name."""
    is_today = F.col("from_period") == "today"
    return (
        with_pattern(manifest, mode)
        .groupBy(*KEYS)
        .agg(
            F.count_if(is_today).alias("n_today"),
            F.count_if(~is_today).alias("occurrence_count"),
            F.min("filename").alias("example_filename"),
        )
        .filter(F.col("n_today") == 0)
        .drop("n_today")
    )


def missing_entities(manifest: DataFrame) -> DataFrame:
    """Entities seen last week and not today."""
    is_today = F.col("from_period") == "today"
    return (
        manifest.groupBy("snapshot_day", "source_id", entity_e2(F.col("filename")).alias("entity"))
        .agg(F.count_if(is_today).alias("n_today"), F.count_if(~is_today).alias("occurrence_count"))
        .filter((F.col("n_today") == 0) & (F.col("entity") != ""))
        .drop("n_today")
    )


def distinct_patterns(manifest: DataFrame, mode: str = "literal") -> DataFrame:
    """Distinct patterns per period with an example filename."""
    return (
        with_pattern(manifest, mode)
        .groupBy("snapshot_day", "source_id", "from_period", "pattern")
        .agg(F.min("filename").alias("example_filename"), F.count(F.lit(1)).alias("n_files"))
    )
