"""Column contracts shared by the readers, the detectors and the reports."""

from __future__ import annotations

from pyspark.sql import types as T

# Status vocabulary of the manifest.
STATUSES = ["processed", "stopped", "empty", "failure", "deleted"]
COMPARABLE_STATUSES = ["processed", "empty"]
PROBLEM_STATUSES = ["failure", "stopped", "deleted"]

# Detector names, in order of business priority.
DETECTORS = ["missing", "duplicated_failed", "volume", "empty", "late", "previous"]

# Severity labels.
URGENT, ATTENTION, NORMAL = "URGENT ACTION REQUIRED", "NEEDS ATTENTION", "NO ACTION NEEDED"

FILE_OBJECT = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("rows", T.StringType()),  # a number, a number with fraction or a number as text
        T.StructField("status", T.StringType()),
        T.StructField("is_duplicated", T.StringType()),
        T.StructField("file_size", T.StringType()),
        T.StructField("uploaded_at", T.StringType()),
        T.StructField("status_message", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("snapshot_day", T.DateType()),
        T.StructField("from_period", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("is_duplicated", T.BooleanType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("status_message", T.StringType()),
    ]
)

CV_DOCS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("detector", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("metric", T.DoubleType()),
        T.StructField("baseline", T.DoubleType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("error_text", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("snapshot_day", T.DateType()),
        T.StructField("source_id", T.StringType()),
        *FINDING.fields,
    ]
)
