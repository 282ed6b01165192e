"""Findings rolled up per source-day: severity, summary line, action, details and the source report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqwatch.functions.numbers import records_text, thousands
from dqwatch.operators.detectors import DEFAULT_LIMITS, HEAD, Limits, windows_text
from dqwatch.operators.expectations import source_calendar
from dqwatch.operators.lookup import lookup, shuffled
from dqwatch.schema import ATTENTION, DETECTORS, NORMAL, URGENT
from dqwatch.sources.cv_files import generic_name


# Recommended action per leading detector.
ACTIONS = {
    "missing": "Notify provider to generate/re-send; re-run ingestion and verify completeness",
    "duplicated_failed": "Notify provider to resolve duplicate and failed files; re-run ingestion and verify completeness",
    "empty": "Notify provider to generate/re-send; re-run ingestion and verify completeness",
    "volume": "Confirm coverage/window; monitor next run",
    "late": "Validate downstream completed; track if persists",
    "early": "Confirm schedule change; adjust downstream triggers if needed",
}
LAG_CHANGE_ACTION = "Confirm intentional lag change; keep a short-term volume watch"

# Report column that carries each detector's details, and its heading.
DETAILS = {
    "missing": ("missing_files_details", "Missing Files"),
    "duplicated_failed": ("failed_duplicate_details", "Failed/Duplicate Files"),
    "volume": ("volume_variation_details", "Volume Variations"),
    "late": ("late_early_upload_details", "Late/Early Uploads"),
    "empty": ("empty_file_details", "Empty Files"),
    "previous": ("previous_period_details", "Previous Period Files"),
}

COUNTS = [
    "n_missing",
    "n_missing_files",
    "n_blocked",
    "n_failure",
    "n_stopped",
    "n_deleted",
    "n_duplicate",
    "n_volume_urgent",
    "n_volume",
    "n_empty_big",
    "n_empty",
    "n_empty_small",
    "n_late",
    "n_very_late",
    "n_schedule_change",
    "n_early",
    "n_previous",
]


def _flags(limits: Limits) -> dict[str, Column]:
    detector, kind, severity = F.col("detector"), F.col("kind"), F.col("severity")
    empty = detector == "empty"
    return {
        "n_missing": detector == "missing",
        "n_blocked": kind == "blocked_duplicate",
        "n_failure": kind == "failure",
        "n_stopped": kind == "stopped",
        "n_deleted": kind == "deleted",
        "n_duplicate": kind == "duplicate",
        "n_volume_urgent": (detector == "volume") & (severity == 2),
        "n_volume": (detector == "volume") & (severity > 0),
        "n_empty_big": empty & (F.col("baseline") > limits.urgent_empty_rows),
        "n_empty": empty & (severity > 0),
        "n_empty_small": empty & (severity == 0),
        "n_late": kind == "late",
        "n_very_late": (kind == "late") & (F.col("metric") > limits.very_late_hours),
        "n_schedule_change": (kind == "early") & (severity > 0),
        "n_early": (kind == "early") & (severity == 0),
        "n_previous": detector == "previous",
    }


def issue_counts(findings: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Findings folded per source-day and issue key; a late pattern that is missing counts as missing.

    Only numbers are folded, so the aggregation hashes. The key is the error shape for failures and the pattern otherwise, so equal errors meet in one row.
    """
    key = F.when(
        F.col("kind") == "failure", F.concat(F.lit("error "), F.coalesce("error_text", F.lit("")))
    ).otherwise(F.concat(F.lit("pattern "), F.coalesce("pattern", F.lit(""))))
    flags = _flags(limits)
    per_key = findings.groupBy(*HEAD, key.alias("issue_key")).agg(
        *[F.count_if(flag).alias(name) for name, flag in flags.items()],
        # of a pattern that came last week as many files are missing as came, of another one
        F.sum(F.when(F.col("detector") == "missing", F.greatest(F.coalesce("baseline", F.lit(1.0)), F.lit(1.0))).otherwise(0.0))
        .cast("bigint")
        .alias("n_missing_files"),
        F.max(F.when(F.col("detector") == "empty", F.col("baseline"))).alias("most_rows_before"),
        F.max(F.when(F.col("kind") == "late", F.col("metric"))).alias("most_hours_late"),
        F.max(F.when(F.col("kind") == "early", F.col("metric"))).alias("most_hours_early"),
    )
    superseded = F.col("n_missing") > 0
    for name in ["n_late", "n_very_late"]:
        per_key = per_key.withColumn(name, F.when(superseded, 0).otherwise(F.col(name)))
    return per_key.withColumn("most_hours_late", F.when(~superseded, F.col("most_hours_late")))


def leading_volumes(volume_findings: DataFrame) -> DataFrame:
    """Volume findings as candidates for the one that the summary line shows."""
    gap = F.abs(F.col("metric") - F.col("baseline"))
    found = volume_findings.filter(F.col("detector") == "volume")
    return found.select(*HEAD, F.struct("severity", gap.alias("gap"), "message").alias("top_volume"))


def source_issues(
    manifest: DataFrame,
    findings: DataFrame,
    facts: DataFrame | None = None,
    days: Column | None = None,
    limits: Limits = DEFAULT_LIMITS,
    by_pattern: DataFrame | None = None,
    volumes: DataFrame | None = None,
) -> DataFrame:
    """One row per source and day with all counts, severities and totals.

    Sources without findings, and documented sources without files, get their row as well: totals,
    findings and the documented calendar are stacked and folded once, nothing is joined away.
    ``by_pattern`` takes a stored ``pattern_facts`` table, which spares reading the manifest again, and
    ``volumes`` the volume findings alone, which spares going through all findings for them.
    """
    if by_pattern is not None:
        totals = by_pattern.select(*HEAD, F.col("rows_today").alias("rows"), F.col("n_today").alias("n"))
    else:
        totals = manifest.filter(F.col("from_period") == "today").select(*HEAD, "rows", F.lit(1).alias("n"))
    totals = totals.groupBy(*HEAD).agg(
        F.sum("rows").cast("bigint").alias("total_rows"), F.sum("n").cast("bigint").alias("n_files")
    )
    stacked = totals.unionByName(issue_counts(findings, limits), allowMissingColumns=True).unionByName(
        leading_volumes(findings if volumes is None else volumes), allowMissingColumns=True
    )
    if facts is not None:
        stacked = stacked.unionByName(source_calendar(facts.select("source_id"), days), allowMissingColumns=True)
    error = F.expr("substring(issue_key, 7)")
    per_error = F.when((F.col("n_failure") > 0) & (error != ""), F.struct("n_failure", error.alias("text")))
    folded = stacked.groupBy(*HEAD).agg(
        F.coalesce(F.sum("total_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum("n_files"), F.lit(0)).cast("bigint").alias("n_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        F.max(per_error).alias("top_error"),
        F.max("top_volume").alias("top_volume"),
        *[F.max(c).alias(c) for c in ["most_rows_before", "most_hours_late", "most_hours_early"]],
    )
    return folded.select("*", *_severities(limits)).withColumn(
        "severity", F.greatest(*[F.col(f"{d}_severity") for d in DETECTORS])
    )


def _severities(limits: Limits) -> list[Column]:
    c, many = F.col, limits.urgent_count
    # failures without a message have no error in common
    same_error = F.when(c("top_error.text") != "", c("top_error.n_failure")).otherwise(0)
    blocked_or_failed = c("n_blocked") + c("n_failure") + c("n_stopped") + c("n_deleted")
    levels = {
        "missing": F.when(c("n_missing") >= many, 2).when(c("n_missing") >= 1, 1),
        "duplicated_failed": F.when((c("n_blocked") >= many) | (same_error >= many), 2).when(
            blocked_or_failed >= 1, 1
        ),
        "volume": F.when(c("n_volume_urgent") >= 1, 2).when(c("n_volume") >= 1, 1),
        "empty": F.when(c("n_empty_big") >= many, 2).when(c("n_empty") >= 1, 1),
        "late": F.when((c("n_late") + c("n_schedule_change")) >= 1, 1),
        "previous": F.lit(0),
    }
    return [F.coalesce(level, F.lit(0)).cast("int").alias(f"{d}_severity") for d, level in levels.items()]


def detector_severities(issues: DataFrame) -> DataFrame:
    """Long form: one row per source-day and detector."""
    rows = F.array(
        *[F.struct(F.lit(d).alias("detector"), F.col(f"{d}_severity").alias("severity")) for d in DETECTORS]
    )
    return issues.select(*HEAD, F.inline(rows))


def criticality(severity: Column) -> Column:
    return F.when(severity == 2, URGENT).when(severity == 1, ATTENTION).otherwise(NORMAL)


def source_criticality(issues: DataFrame) -> DataFrame:
    return issues.select(
        *HEAD,
        "n_files",
        "total_rows",
        *[f"{d}_severity" for d in DETECTORS],
        "severity",
        criticality(F.col("severity")).alias("criticality_level"),
    )


# Kinds of findings of one entity, the dominant one first: what is missing can be neither late nor early, and so on.
DOMINANCE = ["missing", "failed", "empty", "volume", "late", "early", "previous", "duplicate"]


def entity_issues(findings: DataFrame) -> DataFrame:
    """Findings of all detectors per source-day and entity: counts, the dominant kind, severity and one clause.

    Late and early findings of an entity that misses files of the same pattern don't count, as in :func:`issue_counts`.
    Findings without an entity stand under their pattern. ``clause`` names every kind once, the dominant one first.
    """
    detector, kind = F.col("detector"), F.col("kind")
    issue = (
        F.when(kind == "duplicate", "duplicate")
        .when(detector == "duplicated_failed", "failed")
        .when(kind == "early", "early")
        .otherwise(detector)
    )
    named = findings.select(
        *HEAD,
        F.coalesce("entity", "pattern", F.lit("unnamed")).alias("entity"),
        F.coalesce("pattern", F.lit("")).alias("pattern"),
        issue.alias("issue"),
        "severity",
    )
    counts = [F.count_if(F.col("issue") == i).alias(f"n_{i}") for i in DOMINANCE]
    severities = [F.max(F.when(F.col("issue") == i, F.col("severity"))).alias(f"s_{i}") for i in DOMINANCE]
    per_pattern = named.groupBy(*HEAD, "entity", "pattern").agg(*counts, *severities)
    for i in ("late", "early"):
        kept = F.col("n_missing") == 0
        per_pattern = per_pattern.withColumns(
            {f"n_{i}": F.when(kept, F.col(f"n_{i}")).otherwise(0), f"s_{i}": F.when(kept, F.col(f"s_{i}"))}
        )
    folded = per_pattern.groupBy(*HEAD, "entity").agg(
        *[F.sum(f"n_{i}").alias(f"n_{i}") for i in DOMINANCE], *[F.max(f"s_{i}").alias(f"s_{i}") for i in DOMINANCE]
    )
    parts = [F.when(F.col(f"n_{i}") > 0, F.concat(F.col(f"n_{i}").cast("string"), F.lit(f" {i}"))) for i in DOMINANCE]
    leading = F.coalesce(*[F.when(F.col(f"n_{i}") > 0, F.lit(i)) for i in DOMINANCE])
    return folded.select(
        *HEAD,
        "entity",
        leading.alias("leading"),
        F.greatest(*[F.col(f"s_{i}") for i in DOMINANCE]).alias("severity"),
        *[f"n_{i}" for i in DOMINANCE],
        F.concat(F.col("entity"), F.lit(": "), F.concat_ws(", ", *parts)).alias("clause"),
    )


def finding_size() -> Column:
    """What findings of one severity are ordered by: hours or days, else the distance from the baseline."""
    gap = F.abs(F.coalesce(F.col("metric"), F.lit(0.0)) - F.coalesce(F.col("baseline"), F.lit(0.0)))
    return F.when(F.col("detector").isin("late", "previous"), F.col("metric")).otherwise(gap)


def ranked_findings(findings: DataFrame, k: int | None = None) -> DataFrame:
    """All findings of every source-day and detector with their rank by severity, then size, then text.

    ``k`` asks for a short form: the leading ones. That limit is applied before the shuffle as well, so a source with
    very many findings sends at most ``k`` rows per task.
    """
    order = Window.partitionBy(*HEAD, "detector").orderBy(
        F.desc("severity"), F.desc("score"), "message", "filename"
    )
    ranked = findings.withColumn("score", finding_size()).withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def missing_names_text(findings: DataFrame) -> DataFrame:
    """What is missing per source-day: the expected files of one or two patterns, or the entities of more.

    Patterns without an entity are named by their expected file.
    """
    expected = F.regexp_extract("message", r"expected: (.*)$", 1)
    found = findings.filter(F.col("kind") == "missing").select(*HEAD, "entity", expected.alias("expected")).distinct()
    listed = found.groupBy(*HEAD).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set("entity")).alias("entities"),
        F.array_sort(F.collect_set(F.when(F.col("entity").isNull(), F.col("expected")))).alias("others"),
        F.array_sort(F.array(F.min("expected"), F.max("expected"))).alias("ends"),
    )

    def named(label: str, items: Column, separator: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, separator)))

    many = F.concat_ws("; ", named("entities: ", F.col("entities"), ", "), named("expected: ", F.col("others"), "; "))
    few = named("expected: ", F.array_distinct("ends"), "; ")
    return listed.select(*HEAD, F.when(F.col("n") <= 2, few).otherwise(many).alias("missing_names"))


def _counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one.replace(" file ", " files "))))


def _clauses() -> dict[str, Column]:
    c = F.col
    others = c("n_volume") - 1
    past = F.coalesce(F.concat(F.lit(" past "), c("windows_text"), F.lit(" window")), F.lit(""))
    parts = F.concat_ws(
        ", ",
        F.when(c("n_blocked") > 0, _counted(c("n_blocked"), " file blocked as duplicate", " files blocked as duplicates")),
        F.when(
            c("n_failure") > 0,
            F.concat(
                c("n_failure").cast("string"),
                F.lit(" failed"),
                F.coalesce(
                    F.concat(F.lit(" ("), F.nullif(c("top_error.text"), F.lit("")), F.lit(")")), F.lit("")
                ),
            ),
        ),
        F.when(c("n_stopped") > 0, F.concat(c("n_stopped").cast("string"), F.lit(" stopped"))),
        F.when(c("n_deleted") > 0, F.concat(c("n_deleted").cast("string"), F.lit(" deleted"))),
    )
    return {
        "missing": F.concat(
            _counted(c("n_missing_files"), " file missing", " files missing"),
            past,
            F.coalesce(F.concat(F.lit(" — "), c("missing_names")), F.lit("")),
        ),
        "duplicated_failed": parts,
        "volume": F.concat(
            c("top_volume.message"),
            F.when(
                others > 0, F.concat(F.lit("; "), _counted(others, " more volume variation", " more volume variations"))
            ).otherwise(""),
        ),
        "empty": F.concat(
            _counted(c("n_empty"), " file unexpectedly empty", " files unexpectedly empty"),
            F.lit(" (last week up to "),
            thousands(c("most_rows_before").cast("bigint")),
            F.lit(" records)"),
        ),
        "late": F.concat_ws(
            ", ",
            _hours(c("n_late"), " uploaded >4 hours late", c("most_hours_late")),
            _hours(c("n_schedule_change"), " delivered early", c("most_hours_early")),
            F.when(
                c("n_shifted") > 0,
                F.concat(
                    F.lit("upload time shifted by "),
                    F.format_string("%+d", c("shift_minutes")),
                    F.lit(" minutes since "),
                    F.date_format("shifted_since", "yyyy-MM-dd"),
                ),
            ),
        ),
    }


def _hours(n: Column, what: str, hours: Column) -> Column:
    """``3 files uploaded >4 hours late (up to 9 hours)``; NULL for no files."""
    most = F.floor(hours).cast("string")
    return F.when(
        n > 0, F.concat(_counted(n, " file", " files"), F.lit(f"{what} (up to "), most, F.lit(" hours)"))
    )


def source_lines(
    issues: DataFrame,
    missing: DataFrame,
    facts: DataFrame,
    shifts: DataFrame | None = None,
    **options: int,
) -> DataFrame:
    """Name, criticality, summary line and action of every source-day.

    The most severe issue leads, ties go by detector priority; further issues follow after a dash.
    ``missing`` may be all findings or only those of the missing detector. ``shifts``
    (:func:`~dqwatch.operators.timing_runs.source_shifts`) tells whose upload time has shifted.
    """
    of_source = F.filter("windows", lambda w: w["entity"].isNull())
    windows = F.when(F.size(of_source) > 0, of_source).otherwise(F.col("windows"))
    # by time, whatever entity they belong to
    slots = F.array_sort(F.transform(windows, lambda w: F.struct(w["start_min"], w["end_min"])))
    described = facts.select("source_id", "source_name", windows_text(slots).alias("windows_text"))
    rows = lookup(issues, described, ["source_id"], can_be_hot=False, **options)
    rows = rows.join(shuffled(missing_names_text(missing)), HEAD, "left")
    if shifts is not None:
        rows = rows.join(shuffled(shifts), HEAD, "left")
    else:
        rows = rows.withColumns({"n_shifted": F.lit(0), "shift_minutes": F.lit(0).cast("bigint"), "shifted_since": F.col("snapshot_day")})
    clauses = _clauses()
    timing = F.when(F.col("n_shifted") > 0, LAG_CHANGE_ACTION).when(F.col("n_late") > 0, ACTIONS["late"]).otherwise(ACTIONS["early"])
    action_key = {"late": timing}
    issue_list = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"{d}_severity") > 0,
                    F.struct(
                        (-F.col(f"{d}_severity")).alias("order"),
                        F.lit(priority).alias("priority"),
                        clauses[d].alias("text"),
                        action_key.get(d, F.lit(ACTIONS.get(d))).alias("action"),
                    ),
                )
                for priority, d in enumerate(DETECTORS)
                if d in clauses
            ]
        )
    )
    ordered = F.sort_array(issue_list)
    summary = F.when(
        F.col("severity") > 0, F.array_join(F.transform("issue_list", lambda i: i["text"]), " — ")
    ).otherwise(records_text(F.col("total_rows")))
    return (
        rows.withColumn("issue_list", ordered)
        .withColumn("source_name", F.coalesce("source_name", generic_name(F.col("source_id"))))
        .withColumn("criticality_level", criticality(F.col("severity")))
        .withColumn("summary_line", summary)
        .withColumn("recommended_action", F.coalesce(F.get("issue_list", F.lit(0))["action"], F.lit("")))
        .select(
            *HEAD,
            "source_name",
            "severity",
            "criticality_level",
            "summary_line",
            "recommended_action",
            "total_rows",
            "n_files",
        )
    )


#: Findings of one detector that a part of a report holds, about.
FINDINGS_PER_PART = 1000


def in_parts(findings: DataFrame, per_part: int = FINDINGS_PER_PART, **options: int) -> DataFrame:
    """Findings with ``score`` and the ``part`` of their report: the leading ones in part 0, and so on.

    Findings are counted by grade (severity and the score's order of magnitude). Parts follow from the counts of the grades
    above, as prefix sums over some thousand grades at most; a grade that fills several parts is dealt over them by hash.
    So no task sees all findings of a source-day, and up to ``per_part`` of them are one part.
    """
    group = [*HEAD, "detector"]
    scored = findings.withColumn("score", finding_size())
    magnitude = F.floor(F.log2(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)) + 1) * 8).cast("int")
    graded = scored.withColumn("grade", F.coalesce("severity", F.lit(0)) * 16384 + magnitude)
    counts = graded.groupBy(*group, "grade").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(*group).orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("n").over(Window.partitionBy(*group))
    before = counts.withColumns({"n_above": F.coalesce(F.sum("n").over(above), F.lit(0)), "n_all": whole})
    placed = lookup(graded, before, [*group, "grade"], "inner", key_counts=counts, **options)
    slices = F.ceil(F.col("n") / F.lit(per_part))
    slice_ = F.pmod(F.xxhash64("message", "filename", "pattern"), slices)
    part = F.when(F.col("n_all") > per_part, F.floor((F.col("n_above") + slice_ * per_part) / F.lit(per_part))).otherwise(0)
    return placed.withColumn("part", part.cast("int")).drop("grade", "n", "n_above", "n_all")


def detail_texts(findings: DataFrame, per_part: int = FINDINGS_PER_PART, **options: int) -> DataFrame:
    """Six text columns per source-day and part: the findings of each detector, the leading ones first."""
    order = F.struct((-F.col("severity")).alias("a"), (-F.col("score")).alias("b"), "message", "filename")
    listed = (
        in_parts(findings, per_part, **options)
        .groupBy(*HEAD, "part", "detector")
        .agg(F.sort_array(F.collect_list(order)).alias("leading"))
    )
    text = F.array_join(F.transform("leading", lambda x: x["message"]), "; ")
    return listed.groupBy(*HEAD, "part").agg(
        *[F.max(F.when(F.col("detector") == d, text)).alias(DETAILS[d][0]) for d in DETAILS]
    )


def source_report(lines: DataFrame, findings: DataFrame, **options: int) -> DataFrame:
    """The full report record of every source-day, with its Markdown text.

    There is one row per part (:func:`in_parts`), usually part 0 alone; each repeats the head and the summary.
    """
    details = [column for column, _ in DETAILS.values()]
    rows = lines.join(shuffled(detail_texts(findings, **options)), HEAD, "left").fillna("", details).fillna(0, ["part"])
    date = F.date_format("snapshot_day", "yyyy-MM-dd")
    records = records_text(F.col("total_rows"))
    normal = F.col("severity") == 0
    sections = [
        F.when(F.col(column) != "", F.concat(F.lit(f"**{title}**: "), F.col(column)))
        for column, title in DETAILS.values()
    ]
    body = F.concat_ws("\n", *sections)
    text = F.concat_ws(
        "\n",
        F.concat(
            F.lit("## Source: "), "source_name", F.lit(" (id: "), "source_id", F.lit(")"),
            F.when(F.col("part") > 0, F.concat(F.lit(", part "), (F.col("part") + 1).cast("string"))).otherwise(""),
        ),
        F.concat(F.lit("**Date**: "), date),
        F.concat(F.lit("**Criticality Level**: "), "criticality_level"),
        F.lit(""),
        F.lit("### Summary Line"),
        F.col("summary_line"),
        F.lit(""),
        F.lit("### Detailed Findings"),
        F.when(body == "", F.lit("All files received and processed normally.")).otherwise(body),
        F.when(normal, F.concat(F.lit("\n### Total Records\n"), records)),
        F.when(~normal, F.concat(F.lit("\n### Recommended Action\n"), "recommended_action")),
    )
    return rows.select(
        *HEAD,
        "part",
        "source_name",
        date.alias("processing_date"),
        "criticality_level",
        "summary_line",
        *details,
        F.when(normal, records).otherwise("").alias("total_records"),
        "recommended_action",
        text.alias("full_report"),
    )
