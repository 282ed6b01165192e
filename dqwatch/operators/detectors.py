"""The six detectors, as one finding expression each.

Pattern-level findings come from ``pattern_facts``; file-level findings come from today's files joined
to the facts of their pattern. An expression yields a finding or NULL, so any set of detectors runs in
one pass over its input.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from dqwatch.functions import naming
from dqwatch.functions.numbers import MICROS_PER_HOUR, clock, tenths_text, thousands
from dqwatch.operators.expectations import judged_ranges, minute_of, nearest_slot, volumes_by_entity
from dqwatch.operators.lookup import lookup, shuffled
from dqwatch.operators.patterns import FILE_IDENTITY, KEYS, with_pattern
from dqwatch.schema import FINDING, PROBLEM_STATUSES

HEAD = ["snapshot_day", "source_id"]
PATTERN_DETECTORS = ("missing", "volume")
#: Join key of files without a name; no file name holds it.
UNNAMED = "\0"
FILE_DETECTORS = ("duplicated_failed", "empty", "late", "previous")


@dataclass(frozen=True)
class Limits:
    """Thresholds; a value has to exceed its limit to count."""

    volume_pct: float = 50
    urgent_increase_pct: float = 100
    urgent_decrease_pct: float = 80
    late_hours: int = 4
    very_late_hours: int = 8
    empty_rows: int = 10
    urgent_empty_rows: int = 1000
    urgent_count: int = 2
    recent_days: int = 2
    historical_days: int = 7


DEFAULT_LIMITS = Limits()


def _finding(detector: str, kind: Column | str, severity: Column | int, message: Column, **given: Column) -> Column:
    values = {
        "detector": F.lit(detector),
        "kind": kind if isinstance(kind, Column) else F.lit(kind),
        "severity": severity if isinstance(severity, Column) else F.lit(severity),
        "message": message,
        **given,
    }
    return F.struct(
        *[
            values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in FINDING.fields
        ]
    )


def _label() -> Column:
    return F.coalesce("entity", "pattern", F.lit("unnamed"))


def _file_label() -> Column:
    return F.coalesce("filename", F.lit("unnamed file"))


def windows_text(slots: Column) -> Column:
    """``08:00–08:20, 17:00–17:30 UTC``; NULL without windows. Slots without length are usual times, not windows."""
    windows = F.filter(slots, lambda s: s["end_min"] > s["start_min"])
    texts = F.transform(windows, lambda w: F.concat(clock(w["start_min"]), F.lit("–"), clock(w["end_min"])))
    return F.when(F.size(texts) > 0, F.concat(F.array_join(texts, ", "), F.lit(" UTC")))


def _clock_of(moment: Column) -> Column:
    return F.concat(F.date_format(moment, "HH:mm"), F.lit(" UTC"))


def missing_finding(limits: Limits) -> Column:
    """A documented or last-week pattern of which nothing arrived, on a day it is due."""
    expected = F.coalesce(
        naming.expected_filename(F.col("expected_name"), F.col("snapshot_day")),
        F.concat(F.lit("*_"), F.col("pattern")),
    )
    past = F.coalesce(
        F.concat(F.lit("missing past "), windows_text(F.col("slots"))),
        F.lit("missing"),
    )
    absent = (F.col("n_today") == 0) & F.col("is_scheduled") & F.col("pattern").isNotNull()
    return F.when(
        absent,
        _finding(
            "missing",
            "missing",
            1,
            F.concat(past, F.lit(" — expected: "), expected),
            pattern=F.col("pattern"),
            entity=F.col("entity"),
            metric=F.col("n_today"),
            baseline=F.col("n_last"),
        ),
    )


def volume_finding(limits: Limits) -> Column:
    """Volume of a pattern against the same pattern a week before.

    A documented range of its entity or source decides where there is one, else its own history (``decided``, see
    :func:`with_decisions`): the finding is no more severe than that, and informational inside.
    """
    now, before = F.col("volume_today"), F.col("volume_last")
    pct = (now - before) * F.lit(100.0) / F.nullif(before, F.lit(0))
    comparable = (F.col("ok_today") > 0) & (F.col("ok_last") > 0) & (before > 0)
    urgent = (pct > limits.urgent_increase_pct) | (pct < -limits.urgent_decrease_pct)
    text = F.concat(
        _label(),
        F.lit(" volume "),
        thousands(now),
        F.lit(" ("),
        tenths_text(F.abs(now - before) * 100, before),
        F.when(now > before, F.lit("% above last week ")).otherwise(F.lit("% below last week ")),
        thousands(before),
        F.lit(")"),
        F.when(F.col("decided.severity") == 0, F.concat(F.lit(", within "), F.col("decided.text"))).otherwise(""),
    )
    severity = F.when(urgent, 2).otherwise(1)
    return F.when(
        comparable & (F.abs(pct) > limits.volume_pct),
        _finding(
            "volume",
            F.when(now > before, "volume_up").otherwise("volume_down"),
            F.least(severity, F.coalesce("decided.severity", severity)),
            text,
            pattern=F.col("pattern"),
            entity=F.col("entity"),
            metric=now,
            baseline=before,
        ),
    )


def history_finding(limits: Limits) -> Column:
    """Volume of a pattern outside the bounds of its history, where nothing is documented and last week does not tell."""
    now, before = F.col("volume_today"), F.col("volume_last")
    flagged = F.coalesce((F.col("ok_last") > 0) & (F.abs(now - before) * 100 > before * limits.volume_pct), F.lit(False))
    is_above = now > F.col("bounds.upper")
    bound = F.when(is_above, F.col("bounds.upper")).otherwise(F.col("bounds.lower"))
    text = F.concat(
        _label(), F.lit(" volume "), thousands(now), F.when(is_above, F.lit(" (>95% bound ")).otherwise(F.lit(" (<95% bound ")),
        thousands(F.floor(bound)), F.lit(")"),
    )
    outside = is_above | (now < F.col("bounds.lower"))
    return F.when(
        (F.col("ok_today") > 0) & outside & ~F.col("is_documented") & ~flagged,
        _finding("volume", "outside_history", 1, text, pattern=F.col("pattern"), entity=F.col("entity"), metric=now, baseline=bound),
    )


def duplicated_failed_finding(limits: Limits) -> Column:
    """Blocked duplicates, failures, stops and deletions; a processed duplicate is informational."""
    status, duplicate = F.col("status"), F.coalesce("is_duplicated", F.lit(False))
    kind = (
        F.when(duplicate & (status == "stopped"), "blocked_duplicate")
        .when(status.isin("failure", "stopped", "deleted"), status)
        .when(duplicate, "duplicate")
    )
    text = F.concat(
        _file_label(),
        F.lit(" — "),
        F.coalesce("status", F.lit("unknown status")),
        F.when(F.col("status_message").isNotNull(), F.concat(F.lit(" ("), "status_message", F.lit(")"))).otherwise(""),
        F.when(duplicate, F.lit(", duplicate")).otherwise(""),
    )
    error = F.when(kind == "failure", naming.error_text(F.col("status_message")))
    return F.when(
        kind.isNotNull(),
        _finding(
            "duplicated_failed",
            kind,
            F.when(kind == "duplicate", 0).otherwise(1),
            text,
            filename=F.col("filename"),
            pattern=F.col("pattern"),
            entity=F.col("entity"),
            metric=F.col("rows"),
            error_text=error,
        ),
    )


def empty_finding(limits: Limits) -> Column:
    """An empty file whose pattern had rows last week, unless its entity is documented as often empty."""
    before = F.col("max_rows_last")
    text = F.concat(
        _label(), F.lit(" empty: 0 records (last week "), thousands(before), F.lit(")")
    )
    return F.when(
        (F.col("rows") == 0) & (before > 0) & ~F.col("may_be_empty"),
        _finding(
            "empty",
            "unexpected_empty",
            F.when(before > limits.empty_rows, 1).otherwise(0),
            text,
            filename=F.col("filename"),
            pattern=F.col("pattern"),
            entity=F.col("entity"),
            metric=F.col("rows"),
            baseline=before,
        ),
    )


def is_previous_period() -> Column:
    """The date in the filename lies before the upload day by more than the documented lag."""
    return F.coalesce(F.col("days_old") > F.col("lag_days"), F.lit(False))


def with_timing(files: DataFrame) -> DataFrame:
    """File age and the distance of the upload from its expected window, in microseconds.

    The window is the nearest documented slot (:func:`~dqwatch.operators.expectations.arrival_slots`), so that two
    deliveries of a day take two windows; else last week's uploads of the pattern seven days on.
    """
    day, at = F.col("snapshot_day").cast("timestamp"), F.col("uploaded_at")
    week = F.make_dt_interval(days=F.lit(7))

    def on_day(minutes: str) -> Column:
        return day + F.make_dt_interval(mins=F.col(minutes))

    opens = on_day("slot.start_min")
    closes = F.coalesce(on_day("slot.end_min"), F.col("last_upload_last") + week)
    return (
        files.withColumns(
            {
                "days_old": naming.days_old(F.to_date(at), naming.file_date(F.col("filename"))),
                "slot": nearest_slot("slots", minute_of(F.col("snapshot_day"), at)),
            }
        )
        .withColumns(
            {
                "has_schedule": opens.isNotNull(),
                "due_from": F.coalesce(opens, F.col("first_upload_last") + week),
                "due_to": closes,
            }
        )
        .withColumns(
            {
                "late_by": F.unix_micros(at) - F.unix_micros("due_to"),
                "early_by": F.unix_micros("due_from") - F.unix_micros(at),
                "early_by_last": F.unix_micros("due_from") - F.unix_micros(F.col("first_upload_last") + week),
            }
        )
    )


def late_finding(limits: Limits) -> Column:
    """Upload more than the limit after or before its expected window; see :func:`with_timing`."""
    day, at = F.col("snapshot_day").cast("timestamp"), F.col("uploaded_at")
    start, end, late_by, early_by = F.col("due_from"), F.col("due_to"), F.col("late_by"), F.col("early_by")
    limit = limits.late_hours * MICROS_PER_HOUR
    schedule_change = F.col("has_schedule") & ~F.coalesce(F.col("early_by_last") > limit, F.lit(False))
    tracked = ~F.col("may_arrive_anytime") & ~is_previous_period()

    def build(kind: str, severity: Column | int, by: Column, expected: Column, text: Column) -> Column:
        return _finding(
            "late",
            kind,
            severity,
            text,
            filename=F.col("filename"),
            pattern=F.col("pattern"),
            entity=F.col("entity"),
            metric=by / F.lit(float(MICROS_PER_HOUR)),
            baseline=(F.unix_micros(expected) - F.unix_micros(day)) / F.lit(float(MICROS_PER_HOUR)),
        )

    late_text = F.concat(
        _label(),
        F.lit(" file arrived "),
        tenths_text(late_by, MICROS_PER_HOUR),
        F.lit(" hours late at "),
        _clock_of(at),
        F.lit(" (expected "),
        _clock_of(end),
        F.lit(")"),
    )
    early_text = F.concat(
        _label(),
        F.lit(" file delivered early at "),
        _clock_of(at),
        F.lit(" (usual ~"),
        F.date_format(start, "HH:mm"),
        F.lit(")"),
    )
    return F.when(
        tracked & (late_by > limit), build("late", 1, late_by, end, late_text)
    ).when(
        tracked & (early_by > limit),
        build("early", F.when(schedule_change, 1).otherwise(0), early_by, start, early_text),
    )


def previous_finding(limits: Limits) -> Column:
    """A file from an earlier period, informational at source level."""
    old = F.col("days_old")
    kind = (
        F.when(old <= limits.recent_days, "recent_backfill")
        .when(old > limits.historical_days, "historical_backfill")
        .otherwise("backfill")
    )
    text = F.concat(F.col("filename"), F.lit(" is "), old.cast("string"), F.lit(" days old"))
    return F.when(
        is_previous_period(),
        _finding(
            "previous",
            kind,
            0,
            text,
            filename=F.col("filename"),
            pattern=F.col("pattern"),
            entity=F.col("entity"),
            metric=old,
            baseline=F.col("lag_days"),
        ),
    )


EXPRESSIONS = {
    "missing": missing_finding,
    "volume": volume_finding,
    "history": history_finding,
    "duplicated_failed": duplicated_failed_finding,
    "empty": empty_finding,
    "late": late_finding,
    "previous": previous_finding,
}


#: Which of today's files a detector can find anything about, told from the file alone.
CONCERNS = {
    "duplicated_failed": lambda: F.col("is_duplicated") | F.col("status").isin(PROBLEM_STATUSES),
    "empty": lambda: F.col("rows") == 0,
    "late": lambda: F.col("uploaded_at").isNotNull(),
    "previous": lambda: naming.days_old(F.to_date("uploaded_at"), naming.file_date(F.col("filename"))) > 0,
}


def _emit(rows: DataFrame, detectors: tuple[str, ...], limits: Limits) -> DataFrame:
    # exploding and then dropping NULLs keeps the expressions in generated code
    found = F.array(*[EXPRESSIONS[d](limits) for d in detectors])
    return (
        rows.select(*HEAD, F.explode(found).alias("found"))
        .filter(F.col("found").isNotNull())
        .select(*HEAD, "found.*")
    )


def pattern_findings(
    facts_by_pattern: DataFrame,
    detectors: tuple[str, ...] = PATTERN_DETECTORS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Findings of the pattern table; the volume detector needs the columns of :func:`with_decisions`."""
    asked = [d for detector in detectors for d in (("volume", "history") if detector == "volume" else (detector,))]
    return _emit(facts_by_pattern, tuple(asked), limits)


def file_findings(
    manifest: DataFrame,
    facts_by_pattern: DataFrame,
    detectors: tuple[str, ...] = FILE_DETECTORS,
    limits: Limits = DEFAULT_LIMITS,
    **options: int,
) -> DataFrame:
    """One pass over today's files for all file-level detectors.

    Files that no asked detector concerns go before the join. Files without a name share the pattern of
    those: they have no expected name or age, but can fail, be empty or be late. A pattern table that is kept
    tells which patterns are hot; else the files are counted for it.
    """
    concerned = reduce(or_, [F.coalesce(CONCERNS[d](), F.lit(False)) for d in detectors])
    files = with_pattern(manifest.filter((F.col("from_period") == "today") & concerned)).fillna(UNNAMED, ["pattern"])
    delivered = facts_by_pattern.filter(F.col("n_today") > 0).fillna(UNNAMED, ["pattern"])
    facts = delivered.select(
        *KEYS,
        "entity",
        "max_rows_last",
        "first_upload_last",
        "last_upload_last",
        "slots",
        "lag_days",
        "may_be_empty",
        "may_arrive_anytime",
    )
    if facts_by_pattern.is_cached:  # the files of a pattern, concerned or not
        counts = delivered.select(*KEYS, F.col("n_today").alias("n"))
    else:  # of the files alone: the pattern table would be made once more
        counts = files.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    known = with_timing(lookup(files, facts, KEYS, "inner", counts, FILE_IDENTITY, **options))
    return _emit(known.withColumn("pattern", F.nullif("pattern", F.lit(UNNAMED))), detectors, limits)


def _range_text() -> Column:
    """The documented range of a row, as its profile words it."""
    both = F.concat(thousands(F.col("lo")), F.lit("–"), thousands(F.col("hi")))
    return (
        F.when(F.col("kind") == "weekday", F.concat(F.lit("usual "), "dow", F.lit(" "), both))
        .when(F.col("kind") == "typical", F.concat(F.lit("typical range "), both))
        .when(F.col("kind") == "band", F.concat(F.lit("95% band "), both))
        .otherwise(F.concat(F.lit("expected >"), thousands(F.col("lo"))))
    )


def volume_ranges(facts_by_pattern: DataFrame, facts: DataFrame, limits: Limits = DEFAULT_LIMITS, **options: int) -> DataFrame:
    """Volumes of source-days and their entities with the ranges that apply to them."""
    return judged_ranges(
        volumes_by_entity(facts_by_pattern), facts, limits.urgent_increase_pct, limits.urgent_decrease_pct, **options
    )


def range_findings(ranges: DataFrame) -> DataFrame:
    """Volumes of source-days and entities outside a documented range (:func:`volume_ranges`), as volume findings."""
    bound = F.when(F.col("is_above"), F.col("hi")).otherwise(F.col("lo"))
    sign = F.when(F.col("is_above"), ">").otherwise("<")
    context = (
        F.when(F.col("kind") == "band", F.concat(sign, F.lit("95% bound "), thousands(bound)))
        .when(F.col("kind") == "minimum", _range_text())
        .otherwise(F.concat(sign, F.lit(" "), _range_text()))
    )
    text = F.concat(F.coalesce("entity", F.lit("Source")), F.lit(" volume "), thousands(F.col("volume")), F.lit(" ("), context, F.lit(")"))
    found = _finding(
        "volume",
        F.concat(F.lit("outside_"), F.col("kind")),
        F.col("severity"),
        text,
        pattern=F.lit("*"),
        entity=F.col("entity"),
        metric=F.col("volume"),
        baseline=bound,
    )
    return ranges.filter(F.col("severity") > 0).select(*HEAD, F.inline(F.array(found)))


def with_decisions(
    facts_by_pattern: DataFrame, ranges: DataFrame, bands: DataFrame | None = None, **options: int
) -> DataFrame:
    """The pattern table with ``decided``: severity and text of the most specific documented range over a pattern.

    That is a range of its entity, else of its source, each for the weekday before any day. There is one row per source-day
    with ranges, and it holds as many entities as the profile names. Where nothing is documented, ``bands`` (day,
    source_id, pattern, n_days, lower, upper) decide, as :func:`~dqwatch.operators.history.volume_bands` or
    :func:`~dqwatch.operators.volume_state.bands_on` make them; else ``decided`` is NULL.
    """
    decided = F.max(F.struct("severity", _range_text().alias("text"))).alias("decided")
    by_entity = ranges.groupBy(*HEAD, "entity").agg(decided)
    of_source = F.max(F.when(F.col("entity").isNull(), F.col("decided"))).alias("of_source")
    entries = F.collect_list(F.when(F.col("entity").isNotNull(), F.struct("entity", "decided")))
    by_day = by_entity.groupBy(*HEAD).agg(of_source, F.map_from_entries(entries).alias("of_entity"))
    joined = lookup(facts_by_pattern, by_day, HEAD, can_be_hot=False, **options)
    own = F.when(F.col("entity").isNotNull(), F.try_element_at("of_entity", F.col("entity")))
    decided = F.coalesce(own, "of_source")
    columns = [*facts_by_pattern.columns, decided.alias("decided"), decided.isNotNull().alias("is_documented")]
    if bands is None:
        return joined.select(*columns, F.lit(None).cast("struct<lower: double, upper: double, n_days: bigint>").alias("bounds"))
    joined = joined.select(*columns)
    # both sides have one row per pattern and day
    known = bands.filter(F.col("upper").isNotNull()).select(
        F.col("day").alias("snapshot_day"), "source_id", "pattern", F.struct("lower", "upper", "n_days").alias("bounds")
    )
    lower, upper, now = F.col("bounds.lower"), F.col("bounds.upper"), F.col("volume_today")
    text = F.concat(
        F.lit("95% bounds "), thousands(F.floor(lower)), F.lit("–"), thousands(F.floor(upper)),
        F.lit(" of "), F.col("bounds.n_days").cast("string"), F.lit(" earlier "), F.date_format("snapshot_day", "EEEE"), F.lit("s"),
    )
    inside = F.when((now >= lower) & (now <= upper), F.struct(F.lit(0).alias("severity"), text.alias("text")))
    return joined.join(shuffled(known), KEYS, "left").withColumn("decided", F.coalesce("decided", inside))


def recent_severity(limits: Limits = DEFAULT_LIMITS) -> Column:
    """Severity of a backfill as its own detector sees it, before the source-level roll-up."""
    return F.when(F.col("metric") <= limits.recent_days, 1).otherwise(0)

