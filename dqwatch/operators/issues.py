"""Single-scan listings of duplicated, failed and near-identical files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dqwatch.functions.naming import error_text, file_date, normalized_pattern, strip_hash
from dqwatch.operators.listings import duplicate_files
from dqwatch.operators.name_lists import name_parts


def duplicate_occurrences(files: DataFrame) -> DataFrame:
    """How often each duplicate was delivered."""
    return (
        duplicate_files(files)
        .groupBy("snapshot_day", "source_id", "filename", "uploaded_at", "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def naming_duplicates(files: DataFrame, **options: int) -> DataFrame:
    """Files of one source-day whose names are equal but for the hash, with all versions."""
    named = files.withColumn("base_name", strip_hash(F.col("filename")))
    parts = name_parts(named, ["snapshot_day", "source_id", "base_name"], "filename", min_copies=2, **options)
    versions = F.flatten(F.transform("items", lambda i: F.array_repeat(i["name"], i["copies"].cast("int"))))
    return parts.select(
        "snapshot_day",
        "source_id",
        "base_name",
        "part",
        F.col("total").alias("n_files"),
        F.array_join(versions, ", ").alias("all_versions"),
    )


def near_identical(files: DataFrame) -> DataFrame:
    """Files that differ only by hash and date form: same pattern and same file date."""
    name = F.col("filename")
    return (
        files.withColumn("pattern", normalized_pattern(name))
        .withColumn("file_date", file_date(name))
        .groupBy("snapshot_day", "source_id", "pattern", "file_date")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.count_if("is_duplicated").alias("n_flagged"),
            F.min("filename").alias("example_filename"),
        )
        .filter(F.col("n_files") > 1)
    )


def error_patterns(files: DataFrame) -> DataFrame:
    """Failures per error shape; two or more with one shape are urgent."""
    return (
        files.filter(F.col("status") == "failure")
        .groupBy("snapshot_day", "source_id", error_text(F.col("status_message")).alias("error_text"))
        .agg(F.count(F.lit(1)).alias("n_files"))
        .withColumn("is_urgent", F.col("n_files") >= 2)
    )
