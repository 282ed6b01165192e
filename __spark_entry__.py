"""

All queries read a file manifest derived from the ``events`` table (one event = one uploaded file) and
delivery profiles derived from its sources; see ``dqwatch/sources/derived.py``. Dates leave as text and
timestamps without zone, so that both engines return the same types.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dqwatch.functions import naming, numbers
from dqwatch.operators import (
    comparison,
    detectors,
    expectations,
    history,
    issues,
    listings,
    near_names,
    patterns,
    summary,
    volume_state,
)
from dqwatch.plans import findings as plan_findings
from dqwatch.plans import synthesis
from dqwatch.plans.analysis import Analysis, analyze
from dqwatch.sources import cv_files, derived, manifest_json
from dqwatch.sqlview import ManifestTools
from oracle_queries import ORACLES

try:  # the subpackage, the pipeline over it or a package that only they need may be absent
    import corpus_pipeline
    from dqwatch.llm.queries import ORACLES as LLM_ORACLES, QUERIES as LLM_QUERIES
except ImportError:
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    LLM_ORACLES = {**LLM_ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

Query = Callable[[SparkSession, str], DataFrame]
CLOCK = "20:00"


def _plain(df: DataFrame) -> DataFrame:
    casts = {"date": "string", "timestamp": "timestamp_ntz"}
    return df.select(*[F.col(f"`{n}`").cast(casts[t]).alias(n) if t in casts else F.col(f"`{n}`") for n, t in df.dtypes])


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.in_scope(derived.derive_manifest(spark, sf_dir))


def _today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's files need no baseline rows, so they are read without the second role."""
    return derived.derive_files(spark, sf_dir).withColumn("from_period", F.lit("today"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv_files.name_cvs(derived.derive_cv_docs(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv_files.cv_facts(_docs(spark, sf_dir))


def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyze(derived.derive_manifest(spark, sf_dir), _docs(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str, broken: Column | None = None) -> DataFrame:
    """The manifest as JSON documents of several sources and up to 500 files each; where ``broken``, an element is cut off."""
    stamp = F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("uploaded_at")
    file = F.to_json(F.struct("filename", "rows", "status", "is_duplicated", "file_size", stamp, "status_message"))
    if broken is not None:
        file = F.when(broken, F.concat(F.lit('{"filename": "'), F.coalesce("filename", F.lit("")))).otherwise(file)
    # any dealing will do, the documents are only read back
    part = F.floor(F.monotonically_increasing_id() / 500)
    head = ["snapshot_day", "from_period", "part"]
    files = derived.derive_manifest(spark, sf_dir).select("*", part.alias("part")).groupBy(*head, "source_id").agg(
        F.concat(F.lit('"'), "source_id", F.lit('": ['), F.array_join(F.collect_list(file), ",\n"), F.lit("]")).alias("source")
    )
    return files.groupBy(*head).agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list("source"), ",\n"), F.lit("}")).alias("value")
    )


def _documents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_json.flatten_documents(_documents(spark, sf_dir), "snapshot_day", "from_period")


def _documents_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, F.col("file_size") % 89 == 0)
    unread = manifest_json.unread_in_documents(docs, "snapshot_day", "from_period")
    # how a cut element ends depends on what stands behind it
    name = F.regexp_extract("text", r'^\{"filename": "([A-Za-z0-9_.-]*)', 1)
    return unread.select("snapshot_day", "from_period", "source_id", name.alias("filename"))


def _file_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = naming.file_date(F.col("filename"))
    return _today(spark, sf_dir).select(
        "snapshot_day",
        "filename",
        date.alias("file_date"),
        naming.days_old(F.col("snapshot_day"), date).alias("days_old"),
        (date < F.col("snapshot_day")).alias("is_older"),
    )


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = numbers.calendar_context(F.col("snapshot_day"))
    per_day = _today(spark, sf_dir).groupBy("snapshot_day").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("rows").alias("total_rows")
    )
    return per_day.select("*", *[column.alias(name) for name, column in context.items()])


def _missing_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = expectations.missing_expected(_manifest(spark, sf_dir), _facts(spark, sf_dir))
    name = naming.expected_filename(F.col("expected_name"), F.col("snapshot_day"))
    return missing.withColumn("expected_filename", name)


def _named(**functions: Callable[[Column], Column]) -> Query:
    """Filename functions over every file of today."""
    return lambda s, d: _today(s, d).select(
        "filename", *[function(F.col("filename")).alias(column) for column, function in functions.items()]
    )


def _kept_patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, facts and pattern table; the last two are kept, as several steps of a detector read them."""
    manifest, facts = derived.derive_manifest(spark, sf_dir), _facts(spark, sf_dir).persist()
    return manifest, facts, expectations.pattern_facts(listings.in_scope(manifest), facts).persist()


def _detector(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        manifest, facts, by_pattern = _kept_patterns(spark, sf_dir)
        return plan_findings.detector_findings(manifest, facts, name, by_pattern=by_pattern)

    return run


def _missing_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _detector("missing")(spark, sf_dir)
        .groupBy("snapshot_day", "source_id")
        .agg(F.count(F.lit(1)).alias("missing_files_number"))
        .withColumn("severity", F.when(F.col("missing_files_number") >= 2, 2).otherwise(1))
    )


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detector("previous")(spark, sf_dir).withColumn("detector_severity", detectors.recent_severity())


def _volume_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = F.col("volume_today"), F.col("volume_last")
    stats = patterns.pattern_stats(_manifest(spark, sf_dir))
    return stats.filter((F.col("ok_today") > 0) & (F.col("ok_last") > 0) & (before > 0)).select(
        "snapshot_day",
        "source_id",
        "pattern",
        now,
        before,
        numbers.pct_change(now, before).alias("pct_change"),
        numbers.abs_difference(now, before).alias("abs_difference"),
    )


def _state_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds for the last day from a state of all days but the last three, to which two days are merged."""
    volumes = history.daily_volumes(_today(spark, sf_dir))
    last = volumes.select(F.max("day")).first()[0]
    state = volume_state.state_of(volumes.filter(F.col("day") < last - timedelta(days=2)))
    for days in (2, 1):
        state = volume_state.merged(state, volumes.filter(F.col("day") == last - timedelta(days=days)))
    return volume_state.bands_on(state, last)


def _record(detector: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        manifest, facts, by_pattern = _kept_patterns(spark, sf_dir)
        found = plan_findings.detector_findings(manifest, facts, detector, by_pattern=by_pattern)
        if detector == "missing":
            found = found.unionByName(plan_findings.detector_findings(manifest, facts, "late", by_pattern=by_pattern))
        lists = {c: F.array_join(c, ", ") for c in plan_findings.RECORDS[detector]}
        # counted, listed and listed in parts
        return plan_findings.detector_records(found.persist(), detector, facts).withColumns(lists)

    return run


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ManifestTools(derived.derive_manifest(spark, sf_dir)).quality()


def _adhoc_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = ManifestTools(derived.derive_manifest(spark, sf_dir))
    return tools.query_today("SELECT source_id, status, COUNT(*) AS n, SUM(rows) AS total FROM data GROUP BY source_id, status;")


def _adhoc_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = ManifestTools(derived.derive_manifest(spark, sf_dir))
    return tools.query_today_and_last_weekday(
        """
        SELECT snapshot_day, source_id,
               COUNT_IF(from_period = 'today') AS files_today,
               COUNT_IF(from_period = 'last_weekday') AS files_last_week,
               COALESCE(SUM(CASE WHEN from_period = 'today' THEN rows END), 0)
                 - COALESCE(SUM(CASE WHEN from_period = 'last_weekday' THEN rows END), 0) AS difference
        FROM data GROUP BY snapshot_day, source_id
        """
    )


def _queries() -> dict[str, Query]:
    day_source = ["snapshot_day", "source_id"]
    sized = [*day_source, "filename", "rows", "uploaded_at", "status"]
    return {
        "manifest": derived.derive_manifest,
        "manifest_documents": _documents_read,
        "manifest_unread": _documents_unread,
        "outside_scope": lambda s, d: listings.outside_scope(derived.derive_manifest(s, d)).select(
            *day_source, "from_period", "filename", "uploaded_at"
        ),
        "source_slice": lambda s, d: manifest_json.source_slice(derived.derive_manifest(s, d), "200002"),
        "periods_combined": lambda s, d: manifest_json.combine_periods(
            listings.today(derived.derive_manifest(s, d)).drop("from_period"),
            listings.last_weekday(derived.derive_manifest(s, d)).drop("from_period", "status_message"),
        ),
        "stopped_files": lambda s, d: listings.with_status(_today(s, d), "stopped").select(*day_source, "filename", "status_message"),
        "source_data": lambda s, d: manifest_json.source_data(derived.derive_manifest(s, d), _docs(s, d)),
        "quality_summary": lambda s, d: summary.quality_summary(_today(s, d), *day_source),
        "quality_rates": lambda s, d: summary.quality_rates(
            summary.quality_summary(_today(s, d), *day_source), *day_source
        ),
        "quality_tool": _quality,
        "source_summary": lambda s, d: summary.source_summary(derived.derive_manifest(s, d), "from_period"),
        "status_pivot": lambda s, d: summary.status_pivot(_today(s, d)),
        "status_counts": lambda s, d: summary.status_counts(_today(s, d)),
        "today_listing": lambda s, d: listings.received(_today(s, d)),
        "base_pattern_literal": _named(without_hash=naming.strip_hash, base_pattern=naming.base_pattern),
        "base_pattern_normalized": _named(pattern=naming.normalized_pattern),
        "distinct_patterns": lambda s, d: patterns.distinct_patterns(_manifest(s, d)),
        "entity_e1": _named(entity=naming.entity_e1),
        "entity_e2": _named(entity=naming.entity_e2),
        "entity_e3": _named(entity=naming.entity_e3),
        "entity_known": lambda s, d: expectations.pattern_facts(_manifest(s, d), _facts(s, d)).select(
            *day_source, "pattern", "entity"
        ),
        "entity_counts": lambda s, d: summary.entity_counts(_today(s, d)),
        "file_dates": _file_dates,
        "calendar_context": _calendar,
        "missing_patterns": lambda s, d: patterns.missing_patterns(_manifest(s, d)),
        "missing_patterns_normalized": lambda s, d: patterns.missing_patterns(_manifest(s, d), "normalized"),
        "missing_entities": lambda s, d: patterns.missing_entities(_manifest(s, d)),
        "missing_expected": _missing_expected,
        "missing_by_source": _missing_by_source,
        "missing_detector": _detector("missing"),
        "duplicates": lambda s, d: issues.duplicate_occurrences(_today(s, d)),
        "blocked_duplicates": lambda s, d: listings.duplicate_files(_today(s, d), blocked_only=True).select(
            *day_source, "filename", "status_message"
        ),
        "failed_files": lambda s, d: listings.problem_files(_today(s, d)).select(
            *day_source, "filename", "status", "status_message", "uploaded_at"
        ),
        "dup_or_failed": lambda s, d: listings.duplicate_or_problem(_today(s, d)).select(
            *day_source, "filename", "is_duplicated", "status", "status_message"
        ),
        "naming_duplicates": lambda s, d: issues.naming_duplicates(_today(s, d)),
        "near_identical": lambda s, d: issues.near_identical(_today(s, d)),
        "near_names": lambda s, d: near_names.near_names(patterns.with_pattern(_today(s, d))),
        "near_name_findings": lambda s, d: near_names.near_name_findings(patterns.pattern_stats(_manifest(s, d))),
        "error_patterns": lambda s, d: issues.error_patterns(_today(s, d)),
        "error_indicators": lambda s, d: _today(s, d)
        .filter(naming.has_error_indicator(F.col("status_message")))
        .select(*day_source, "filename", "status", "status_message"),
        "duplicated_failed_detector": _detector("duplicated_failed"),
        "empty_listing": lambda s, d: listings.empty_files(_today(s, d)).select(*sized),
        "empty_exact_left": lambda s, d: comparison.empty_with_baseline(_manifest(s, d)),
        "empty_from_baseline": lambda s, d: comparison.filled_last_week_empty_today(_manifest(s, d)),
        "unexpected_empty": _detector("empty"),
        "filename_compare": lambda s, d: comparison.filename_compare(_manifest(s, d)),
        "volume_files": lambda s, d: comparison.volume_files(_manifest(s, d)),
        "volume_significant": lambda s, d: comparison.significant_volumes(comparison.volume_files(_manifest(s, d))),
        "volume_patterns": _volume_patterns,
        "volume_detector": _detector("volume"),
        "volume_vs_range": lambda s, d: expectations.outside_ranges(
            expectations.volumes_by_entity(expectations.pattern_facts(_today(s, d), _facts(s, d))), _facts(s, d)
        ),
        "volume_with_history": lambda s, d: plan_findings.detector_findings(
            derived.derive_manifest(s, d), _facts(s, d), "volume", bands=history.volume_bands(history.daily_volumes(_today(s, d)))
        ),
        "volume_state_bands": _state_bands,
        "learnt_cadence": lambda s, d: expectations.learnt_cadence(_today(s, d)),
        "missing_with_cadence": lambda s, d: detectors.pattern_findings(
            expectations.pattern_facts(_manifest(s, d), _facts(s, d), expectations.learnt_cadence(_today(s, d))), ("missing",)
        ),
        "volume_band": lambda s, d: history.volume_bands(history.daily_volumes(_today(s, d))),
        "timing_raw": lambda s, d: comparison.timing_files(_manifest(s, d), shift_days=0),
        "timing_shifted": lambda s, d: comparison.timing_files(_manifest(s, d)),
        "late_files": lambda s, d: comparison.late_against_last_week(comparison.timing_files(_manifest(s, d))),
        "early_files": lambda s, d: comparison.early_against_last_week(comparison.timing_files(_manifest(s, d))),
        "late_vs_window": lambda s, d: expectations.late_against_window(_today(s, d), _facts(s, d)),
        "late_detector": _detector("late"),
        "previous_period": _previous,
        "recurrence": lambda s, d: history.recurrence(_analysis(s, d).findings),
        "top_volumes": lambda s, d: listings.top_volumes(_today(s, d)).select(*sized),
        "volumes_ordered": lambda s, d: listings.by_volume(listings.comparable(_today(s, d))).select(*sized),
        "uploads_ordered": lambda s, d: listings.by_upload_time(_today(s, d)).select(
            *day_source, "filename", "uploaded_at", "status"
        ),
        "filenames_ordered": lambda s, d: listings.by_filename(_manifest(s, d)).select(
            *day_source, "filename", "rows", "from_period"
        ),
        "total_records": lambda s, d: summary.total_records(_today(s, d)),
        "affected_share": lambda s, d: summary.affected_share(
            _today(s, d), F.col("is_duplicated") & (F.col("status") == "stopped")
        ),
        "findings": lambda s, d: _analysis(s, d).findings,
        "ranked_findings": lambda s, d: synthesis.ranked_findings(_analysis(s, d).findings).select(
            *day_source, "detector", "message", "severity", "rank"
        ),
        "missing_records": _record("missing"),
        "duplicated_failed_records": _record("duplicated_failed"),
        "empty_records": _record("empty"),
        "volume_records": _record("volume"),
        "late_records": _record("late"),
        "previous_records": _record("previous"),
        "timing_runs": lambda s, d: _analysis(s, d).timing_runs,
        "entity_issues": lambda s, d: synthesis.entity_issues(_analysis(s, d).findings),
        "detector_severities": lambda s, d: synthesis.detector_severities(_analysis(s, d).issues),
        "source_criticality": lambda s, d: synthesis.source_criticality(_analysis(s, d).issues),
        "source_lines": lambda s, d: _analysis(s, d).lines,
        "source_report": lambda s, d: _analysis(s, d).source_reports(),
        "executive_report": lambda s, d: _analysis(s, d).report(CLOCK),
        "cv_names": lambda s, d: _docs(s, d).select("source_id", "source_name", F.length("text").alias("n_chars")),
        "cv_generic_names": lambda s, d: cv_files.name_cvs(
            derived.derive_cv_docs(s, d), extract_names=False
        ).select("source_id", "source_name"),
        "cv_windows": lambda s, d: cv_files.cv_windows(_facts(s, d)),
        "cv_usual_times": lambda s, d: cv_files.cv_usual_times(_facts(s, d)),
        "cv_volume_ranges": lambda s, d: cv_files.cv_volume_ranges(_facts(s, d)),
        "cv_entities": lambda s, d: cv_files.cv_entities(_facts(s, d)),
        "cv_file_patterns": lambda s, d: cv_files.cv_file_patterns(_facts(s, d)),
        "cv_schedule": lambda s, d: cv_files.cv_schedule(_facts(s, d)),
        "cv_exemptions": lambda s, d: cv_files.cv_exemptions(_facts(s, d)),
        "cv_unparsed": lambda s, d: cv_files.cv_unparsed(_docs(s, d)),
        "missing_cvs": lambda s, d: cv_files.missing_cvs(_manifest(s, d), _docs(s, d)),
        "first_sources": lambda s, d: cv_files.first_sources(_docs(s, d), 3).select("source_id", "source_name"),
        "adhoc_today": _adhoc_today,
        "adhoc_both_periods": _adhoc_both,
    }


def entry(spark: SparkSession) -> DataFrame:
    """The executive report over all days and sources of the smallest scale."""
    return _plain(_analysis(spark, "/root/testdata/sf0.001").report(CLOCK))


def queries() -> dict[str, Query]:
    """Every registered query; each takes ``(spark, sf_dir)``."""

    def plain(query: Query) -> Query:
        return lambda spark, sf_dir: _plain(query(spark, sf_dir))

    return {**{key: plain(query) for key, query in _queries().items()}, **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query name."""
    return {**ORACLES, **LLM_ORACLES}
