"""Filters, listings and orderings over the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dqwatch.schema import COMPARABLE_STATUSES, PROBLEM_STATUSES


def today(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("from_period") == "today")


def last_weekday(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("from_period") == "last_weekday")


def snapshot_time(manifest: DataFrame, snapshot_hour: int = 20) -> Column:
    """When a row's snapshot was taken: its ``snapshot_at`` where the manifest has one, else ``snapshot_hour`` UTC of its day."""
    usual = F.col("snapshot_day").cast("timestamp") + F.make_dt_interval(hours=F.lit(snapshot_hour))
    return F.coalesce("snapshot_at", usual) if "snapshot_at" in manifest.columns else usual


def in_scope(manifest: DataFrame, scope: str = "current", snapshot_hour: int = 20) -> DataFrame:
    """``current``: files uploaded after the snapshot before the row's own and up to that one; ``all``: every row.

    A file of the late evening is first listed by the snapshot of the day after. A manifest that was read from dated folders
    brings its own time (``snapshot_at``); ``snapshot_hour`` stands for it elsewhere. Files without an upload time are
    listed and therefore received; they stay. :func:`outside_scope` has the rows that go.
    """
    if scope == "all":
        return manifest
    if scope != "current":
        raise ValueError(f"scope must be 'current' or 'all', not {scope!r}")
    return manifest.filter(_is_current(manifest, snapshot_hour))


def outside_scope(manifest: DataFrame, snapshot_hour: int = 20) -> DataFrame:
    """Rows that a snapshot lists although they were uploaded outside its day."""
    return manifest.filter(~_is_current(manifest, snapshot_hour))


def _is_current(manifest: DataFrame, snapshot_hour: int) -> Column:
    offset = F.when(F.col("from_period") == "last_weekday", 7).otherwise(0)
    taken = snapshot_time(manifest, snapshot_hour) - F.make_dt_interval(days=offset)
    at = F.col("uploaded_at")
    return at.isNull() | ((at > taken - F.make_dt_interval(days=F.lit(1))) & (at <= taken))


def comparable(files: DataFrame) -> DataFrame:
    """Files whose volume can be compared."""
    return files.filter(F.col("status").isin(COMPARABLE_STATUSES))


def problem_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("status").isin(PROBLEM_STATUSES))


def empty_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("rows") == 0)


def duplicate_files(files: DataFrame, blocked_only: bool = False) -> DataFrame:
    """Files marked as duplicates; ``blocked_only`` keeps those that were also stopped."""
    kept = files.filter(F.col("is_duplicated"))
    return kept.filter(F.col("status") == "stopped") if blocked_only else kept


def duplicate_or_problem(files: DataFrame) -> DataFrame:
    return files.filter(F.col("is_duplicated") | F.col("status").isin(PROBLEM_STATUSES))


def received(files: DataFrame) -> DataFrame:
    """Distinct deliveries per source-day."""
    return files.select("snapshot_day", "source_id", "filename", "uploaded_at", "status").distinct()


def with_status(files: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    kept = files.filter(F.col("status") == status)
    return kept if limit is None else kept.limit(limit)


def by_volume(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("rows"), "source_id", "filename", "uploaded_at")


def by_upload_time(files: DataFrame) -> DataFrame:
    return files.orderBy("uploaded_at", "source_id", "filename")


def by_filename(files: DataFrame) -> DataFrame:
    return files.orderBy("filename", "from_period", "snapshot_day", "uploaded_at")


def top_volumes(files: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest comparable files, ties settled by name and time."""
    return by_volume(comparable(files)).limit(n)
