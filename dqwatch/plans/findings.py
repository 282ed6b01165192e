"""All findings of all detectors, sources and days in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dqwatch.operators.detectors import (
    DEFAULT_LIMITS,
    FILE_DETECTORS,
    HEAD,
    PATTERN_DETECTORS,
    Limits,
    file_findings,
    pattern_findings,
    range_findings,
    volume_ranges,
    with_decisions,
)
from dqwatch.operators.expectations import pattern_facts
from dqwatch.operators.listings import in_scope
from dqwatch.operators.lookup import lookup, shuffled
from dqwatch.operators.name_lists import NAMES_PER_PART, name_parts
from dqwatch.schema import DETECTORS, FINDING
from dqwatch.sources.cv_files import generic_name


def all_findings(
    manifest: DataFrame,
    facts: DataFrame,
    scope: str = "current",
    limits: Limits = DEFAULT_LIMITS,
    by_pattern: DataFrame | None = None,
    bands: DataFrame | None = None,
    **options: int,
) -> DataFrame:
    """``by_pattern`` takes a stored ``pattern_facts`` table, which spares one scan of the manifest; ``bands`` are bounds
    from history, see :func:`~dqwatch.operators.detectors.with_decisions`."""
    manifest = in_scope(manifest, scope)
    by_pattern = by_pattern if by_pattern is not None else pattern_facts(manifest, facts, **options)
    ranges = volume_ranges(by_pattern, facts, limits, **options)
    return (
        pattern_findings(with_decisions(by_pattern, ranges, bands, **options), limits=limits)
        .unionByName(range_findings(ranges))
        .unionByName(file_findings(manifest, by_pattern, limits=limits, **options))
    )


def detector_findings(
    manifest: DataFrame,
    facts: DataFrame,
    detector: str,
    scope: str = "current",
    limits: Limits = DEFAULT_LIMITS,
    bands: DataFrame | None = None,
    by_pattern: DataFrame | None = None,
    **options: int,
) -> DataFrame:
    """Findings of one detector; ``by_pattern`` takes a stored ``pattern_facts`` table, as in :func:`all_findings`."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}, expected one of {', '.join(DETECTORS)}")
    manifest = in_scope(manifest, scope)
    by_pattern = by_pattern if by_pattern is not None else pattern_facts(manifest, facts, **options)
    if detector == "volume":
        ranges = volume_ranges(by_pattern, facts, limits, **options)
        found = pattern_findings(with_decisions(by_pattern, ranges, bands, **options), (detector,), limits)
        return found.unionByName(range_findings(ranges))
    if detector in PATTERN_DETECTORS:
        return pattern_findings(by_pattern, (detector,), limits)
    return file_findings(manifest, by_pattern, (detector,), limits, **options)


def unread_findings(unread: DataFrame) -> DataFrame:
    """Findings of the missing detector about elements that the manifest reader could not read (``unread_elements``)."""
    found = unread.filter((F.col("from_period") == "today") & F.col("snapshot_day").isNotNull())
    values = {
        "detector": F.lit("missing"),
        "kind": F.lit("unread"),
        "metric": F.lit(0),
        "severity": F.lit(1),
        "message": F.concat(F.lit("unread manifest element ("), "problem", F.lit("): "), F.coalesce("text", F.lit(""))),
    }
    columns = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING.fields]
    return found.select("snapshot_day", F.coalesce("source_id", F.lit("unknown")).alias("source_id"), *columns)


# List columns of each detector's result record, with the column of their number.
RECORDS = {
    "missing": {"missing_files": "missing_files_number", "late_files": "late_files_number"},
    "duplicated_failed": {"duplicated_files": None, "failed_files": None},
    "empty": {"empty_files": "total_empty_files"},
    "volume": {"unexpected_volume_files": "total_unexpected_volume_files"},
    "late": {"files_uploaded_after_schedule": "total_files_uploaded_after_schedule"},
    "previous": {"previous_period_files": "total_previous_period_files"},
}


def _lists(detector: str) -> Column:
    """The lists of a detector's record that a finding belongs to."""
    kind, of = F.col("kind"), F.col("detector") == detector
    late = (F.col("detector") == "late") & (kind == "late")
    if detector == "missing":
        return F.array_compact(F.array(F.when(of, "missing_files"), F.when(late, "late_files")))
    if detector == "duplicated_failed":
        duplicate = of & kind.isin("blocked_duplicate", "duplicate")
        failed = of & kind.isin("blocked_duplicate", "failure", "stopped", "deleted")
        return F.array_compact(F.array(F.when(duplicate, "duplicated_files"), F.when(failed, "failed_files")))
    (only,) = RECORDS[detector]
    return F.array_compact(F.array(F.when(late if detector == "late" else of, only)))


def detector_records(
    findings: DataFrame, detector: str, facts: DataFrame | None = None, per_part: int = NAMES_PER_PART, **options: int
) -> DataFrame:
    """The detector's result record per source-day: its lists of files, their numbers, details and the source's name.

    Missing and volume findings list patterns, the others filenames. Missing files come with the late ones, duplicated
    with failed ones; a blocked duplicate is in both, and ``total_issues`` counts it once. Records with very many
    names come as several numbered parts, which together hold every name and its details once; the numbers are the
    whole record's in each.
    """
    name = F.coalesce("filename", "pattern", F.lit("unnamed"))
    flagged = findings.select(*HEAD, _lists(detector).alias("lists"), name.alias("name"), "message").filter(F.size("lists") > 0)
    counts = [F.count_if(F.array_contains("lists", c)).alias(n) for c, n in RECORDS[detector].items() if n]
    if detector == "duplicated_failed":
        counts = [F.count(F.lit(1)).alias("total_issues")]
    numbers = flagged.groupBy(*HEAD).agg(*counts)
    entries = flagged.select(*HEAD, F.explode("lists").alias("list"), "name", "message").select(
        *HEAD, F.struct("list", "name", "message").alias("entry")
    )
    parts = name_parts(entries, HEAD, "entry", per_part, **options)
    listed = {
        column: F.array_distinct(
            F.transform(F.filter("items", lambda i: i["name"]["list"] == column), lambda i: i["name"]["name"])
        )
        for column in RECORDS[detector]
    }
    details = F.array_join(F.array_distinct(F.transform("items", lambda i: i["name"]["message"])), "; ")
    records = parts.select(*HEAD, "part", *[c.alias(n) for n, c in listed.items()], details.alias("details")).join(shuffled(numbers), HEAD)
    if facts is not None:
        # one row per source, day and part
        records = lookup(records, facts.select("source_id", "source_name"), ["source_id"], can_be_hot=False, **options)
        records = records.withColumn("source_name", F.coalesce("source_name", generic_name(F.col("source_id"))))
    return records
