"""Counts, sums and rates over the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dqwatch.functions.naming import entity_e1
from dqwatch.functions.numbers import rate, records_text
from dqwatch.schema import STATUSES


def _count_if(condition: Column) -> Column:
    """Matching rows; zero, not NULL, when nothing matches."""
    return F.count_if(condition)


def source_summary(files: DataFrame, *extra_keys: str) -> DataFrame:
    """Files, rows, mean size and status counts per source."""
    status = F.col("status")
    return files.groupBy("source_id", *extra_keys).agg(
        F.count("filename").alias("total_files"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.avg("file_size").alias("avg_file_size"),
        _count_if(status == "processed").alias("processed_files"),
        _count_if(status == "empty").alias("empty_files"),
        _count_if(status.isin("failure", "failed")).alias("failed_files"),
    )


def status_pivot(files: DataFrame) -> DataFrame:
    """One column per known status, zero where a source has none."""
    return files.groupBy("source_id").pivot("status", STATUSES).count().fillna(0, STATUSES)


def quality_summary(files: DataFrame, *keys: str) -> DataFrame:
    """The thirteen day-quality measures, overall or per ``keys``."""
    status = F.col("status")
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.countDistinct("source_id").alias("unique_sources"),
        _count_if(F.col("rows") == 0).alias("empty_files"),
        _count_if(F.col("is_duplicated")).alias("duplicates"),
        _count_if(status == "failure").alias("failed_files"),
        _count_if(status == "stopped").alias("stopped_files"),
        _count_if(status == "processed").alias("successful_files"),
        _count_if(status == "empty").alias("empty_status_files"),
        _count_if(status == "deleted").alias("deleted_files"),
        F.min("uploaded_at").alias("earliest_upload"),
        F.max("uploaded_at").alias("latest_upload"),
        F.sum("rows").alias("total_rows"),
        F.sum("file_size").alias("total_size_bytes"),
    )


def quality_rates(summary: DataFrame, *keys: str) -> DataFrame:
    """Success, duplicate and empty-file rates in percent; NULL for a day without files."""
    total = F.col("total_files")
    return summary.select(
        *keys,
        rate(F.col("successful_files"), total).alias("success_rate"),
        rate(F.col("duplicates"), total).alias("duplicate_rate"),
        rate(F.col("empty_files"), total).alias("empty_file_rate"),
    )


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("snapshot_day", "source_id", "status").agg(F.count(F.lit(1)).alias("n_files"))


def entity_counts(files: DataFrame) -> DataFrame:
    """Files per entity token."""
    return files.groupBy(
        "snapshot_day", "source_id", entity_e1(F.col("filename")).alias("entity_name")
    ).agg(F.count(F.lit(1)).alias("file_count"))


def total_records(files: DataFrame) -> DataFrame:
    """Delivered records per source-day, as a number and as report text."""
    total = files.groupBy("snapshot_day", "source_id").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total_rows")
    )
    return total.withColumn("records_text", records_text(F.col("total_rows")))


def affected_share(files: DataFrame, affected: Column) -> DataFrame:
    """Affected files per source-day and their share in percent."""
    return (
        files.groupBy("snapshot_day", "source_id")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(affected).alias("n_affected"))
        .withColumn("affected_pct", rate(F.col("n_affected"), F.col("n_files")))
    )
