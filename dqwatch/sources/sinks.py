"""Writers: the manifest and the findings as Parquet by day, the rendered report as one text file a day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F


def write_manifest(manifest: DataFrame, path: str, mode: str = "append") -> None:
    """Store a manifest for later scans, one folder per snapshot day."""
    manifest.write.mode(mode).partitionBy("snapshot_day").parquet(path)


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    findings.write.mode(mode).partitionBy("snapshot_day").parquet(path)


def report_path(folder: str, day: str, session: str) -> str:
    return f"{folder.rstrip('/')}/data_quality_report_{day}_{session}.md"


def write_report(report: DataFrame, folder: str, session: str, overwrite: bool = False) -> list[str]:
    """One ``data_quality_report_<day>_<session>.md`` per day, its lines in order; returns the paths.

    Tasks write the days side by side into a folder of their own, one file a day. Only when all of them are done do
    the files move to their places, so a failed run leaves no report behind. The driver moves one file per day.
    Raises FileExistsError before anything is moved if a report is there already, unless ``overwrite``.
    """
    spark = report.sparkSession
    staged = f"{folder.rstrip('/')}/_report_{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    order = ["snapshot_day", "section", "position", "source_id"]
    ordered = report.repartition("snapshot_day").sortWithinPartitions(*order)
    try:
        ordered.select("snapshot_day", F.col("line").alias("value")).write.option("maxRecordsPerFile", 0).partitionBy("snapshot_day").text(staged)
        moves = []
        for status in files.globStatus(path(f"{staged}/snapshot_day=*/part-*")) or []:
            day = status.getPath().getParent().getName().partition("=")[2]
            moves.append((status.getPath(), path(report_path(folder, day, session))))
        there = [str(target) for _, target in moves if files.exists(target)]
        if there and not overwrite:
            raise FileExistsError(f"{len(there)} reports are there already, such as {min(there)}")
        for source, target in moves:
            files.delete(target, False)
            if not files.rename(source, target):
                raise OSError(f"could not move {source} to {target}")
    finally:
        files.delete(path(staged), True)
    return sorted(str(target) for _, target in moves)
