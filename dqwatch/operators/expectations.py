"""What a source documents, brought onto source-days, patterns and volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqwatch.functions.naming import entity_of
from dqwatch.operators.lookup import lookup, shuffled
from dqwatch.operators.patterns import KEYS, pattern_stats, with_pattern


def delivery_days(manifest: DataFrame) -> Column:
    """The snapshot days that have a manifest, as one array; it grows with the calendar only."""
    return manifest.select("snapshot_day").distinct().agg(F.collect_set("snapshot_day")).scalar()


def scheduled(day: Column, not_expected_on: Column) -> Column:
    """False on the weekdays a profile excludes; True when nothing is documented."""
    excluded = F.array_contains(not_expected_on, F.date_format(day, "EEEE"))
    return ~F.coalesce(excluded, F.lit(False))


def due_on(day: Column, mask: Column) -> Column:
    """Whether a mask of weekdays, Monday as bit 0, has the day's; True without a mask."""
    return F.coalesce(mask.bitwiseAND(_bit(day)) > 0, F.lit(True))


def _bit(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i) for i in range(7)]), F.weekday(day) + 1)


def source_calendar(facts: DataFrame, days: Column) -> DataFrame:
    """Every documented source on every delivery day."""
    return facts.select(F.explode(days).alias("snapshot_day"), "*")


def expected_deliveries(facts: DataFrame, days: Column) -> DataFrame:
    """Documented files due on each delivery day."""
    due = source_calendar(facts, days).filter(scheduled(F.col("snapshot_day"), F.col("not_expected_on")))
    files = due.select("snapshot_day", "source_id", F.inline("expected_files"))
    return files.filter(due_on(F.col("snapshot_day"), F.col("due_mask"))).drop("due_mask")


def missing_expected(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """Documented files due on a day of which nothing arrived, in any status."""
    received = with_pattern(manifest.filter(F.col("from_period") == "today")).select(
        *KEYS, F.lit(None).cast("string").alias("expected_name"), F.lit(1).alias("is_file")
    )
    due = expected_deliveries(facts, delivery_days(manifest)).select(
        *KEYS, "expected_name", F.lit(0).alias("is_file")
    )
    return (
        received.unionByName(due)
        .groupBy(*KEYS)
        .agg(F.min("expected_name").alias("expected_name"), F.sum("is_file").alias("n_files"))
        .filter((F.col("n_files") == 0) & F.col("expected_name").isNotNull())
        .drop("n_files")
    )


def pattern_facts(
    manifest: DataFrame, facts: DataFrame, cadence: DataFrame | None = None, **options: int
) -> DataFrame:
    """Pattern statistics with everything the profile says about the pattern.

    Documented files take part in the same aggregation as the manifest rows, as a third period, so a
    documented pattern without any delivery gets its row there. ``cadence`` (:func:`learnt_cadence`) tells the weekdays
    of patterns for which the profile names none.
    """
    due = expected_deliveries(facts, delivery_days(manifest))
    with_due = with_pattern(manifest).unionByName(
        due.drop("expected_name").withColumn("from_period", F.lit("expected")), allowMissingColumns=True
    )
    stats = pattern_stats(with_due, mode="given")
    documented = facts.select(
        "source_id",
        "entities",
        "expected_files",
        "windows",
        "usual_times",
        "not_expected_on",
        "regularly_empty",
        "variable_arrival",
        "lag_days",
    )
    # one row per day and pattern: counting a source's files first would read the manifest once more
    joined = lookup(stats, documented, ["source_id"], can_be_hot=False, **options)
    if cadence is not None:
        learnt = cadence.filter(F.col("cadence") != "irregular").select("source_id", "pattern", F.col("due_mask").alias("learnt_mask"))
        joined = joined.join(shuffled(learnt), ["source_id", "pattern"], "left")
    entity = entity_of(F.col("pattern"), F.col("entities"))
    documented_as = F.filter("expected_files", lambda f: f["pattern"] == F.col("pattern"))
    mask = F.get(documented_as, F.lit(0))["due_mask"]
    if cadence is not None:
        mask = F.coalesce(mask, "learnt_mask")

    def listed(column: str) -> Column:
        return F.coalesce(F.array_contains(F.col(column), F.col("entity")), F.lit(False))

    dropped = ["entities", "expected_files", "windows", "usual_times", "not_expected_on", "regularly_empty", "variable_arrival"]
    day = F.col("snapshot_day")
    return (
        joined.withColumn("entity", entity)
        .withColumns(
            {
                "expected_name": F.when(F.col("n_today") == 0, F.get(documented_as, F.lit(0))["expected_name"]),
                "is_scheduled": scheduled(day, F.col("not_expected_on")) & due_on(day, mask),
                "slots": arrival_slots(),
                "may_be_empty": listed("regularly_empty"),
                "may_arrive_anytime": listed("variable_arrival"),
                "lag_days": F.coalesce("lag_days", F.lit(0)),
            }
        )
        .drop(*dropped, "learnt_mask")
    )


def learnt_cadence(manifest: DataFrame, min_days: int = 3) -> DataFrame:
    """How often each pattern comes, from the gaps between its days: ``daily``, ``weekdays``, ``weekly`` or ``irregular``.

    ``due_mask`` has the weekdays it came on. Weekly: every gap is a multiple of a week. Daily and weekdays: no gap is longer
    than from a Friday to a Monday, at weekends too or never. A pattern with fewer than ``min_days`` days is irregular.
    """
    days = (
        with_pattern(manifest.filter(F.col("from_period") == "today"))
        .filter(F.col("pattern").isNotNull())
        .select("source_id", "pattern", "snapshot_day")
        .distinct()
    )
    order = Window.partitionBy("source_id", "pattern").orderBy("snapshot_day")
    gap = F.datediff("snapshot_day", F.lag("snapshot_day").over(order))
    folded = (
        days.withColumn("gap", gap)
        .groupBy("source_id", "pattern")
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.max("gap").alias("longest_gap"),
            F.coalesce(F.every(F.col("gap") % 7 == 0), F.lit(False)).alias("whole_weeks"),
            F.bit_or(_bit(F.col("snapshot_day"))).alias("due_mask"),
        )
    )
    weekend = F.col("due_mask").bitwiseAND(96) > 0
    cadence = (
        F.when(F.col("n_days") < min_days, "irregular")
        .when(F.col("whole_weeks"), "weekly")
        .when((F.col("longest_gap") <= 3) & ~weekend, "weekdays")
        .when(F.col("longest_gap") <= 2, "daily")
        .otherwise("irregular")
    )
    # every day of the kind is due, also one on which the pattern happened not to come
    mask = F.when(cadence == "daily", 127).when(cadence == "weekdays", 31).otherwise(F.col("due_mask"))
    return folded.select("source_id", "pattern", "n_days", "longest_gap", cadence.alias("cadence"), mask.cast("int").alias("due_mask"))


def arrival_slots(entity: str = "entity") -> Column:
    """When files of an entity are due: (start_min, end_min) in order, from the columns ``windows`` and ``usual_times``.

    The entity's own windows, else its usual times (a slot without length), else those of the whole source; NULL if
    nothing is documented.
    """

    def stated(of: str) -> str:
        windows = f"filter(windows, w -> w.entity <=> {of})"
        times = f"filter(usual_times, t -> t.entity <=> {of})"
        return f"""CASE WHEN size({windows}) > 0 THEN array_sort(transform({windows}, w -> struct(w.start_min, w.end_min)))
            WHEN size({times}) > 0 THEN array_sort(transform({times}, t -> struct(t.minute AS start_min, t.minute AS end_min))) END"""

    return F.expr(f"coalesce(CASE WHEN {entity} IS NOT NULL THEN {stated(entity)} END, {stated('CAST(NULL AS string)')})")


def nearest_slot(slots: str, minute: Column) -> Column:
    """The slot with the least distance to ``minute``, the earlier of two equally near; NULL without slots."""
    away = lambda s: F.greatest(s["start_min"] - minute, minute - s["end_min"], F.lit(0))
    return F.array_min(F.transform(slots, lambda s: F.struct(away(s).alias("away"), s["start_min"], s["end_min"])))


def minute_of(day: Column, at: Column) -> Column:
    """Minutes from the start of ``day`` to ``at``, negative on the evening before."""
    return (F.unix_micros(at) - F.unix_micros(day.cast("timestamp"))) / F.lit(6e7)


def volumes_by_entity(by_pattern: DataFrame) -> DataFrame:
    """Comparable records per source-day and entity, and per source-day as a whole (``entity`` NULL)."""
    known = by_pattern.filter(F.col("ok_today") > 0).select("snapshot_day", "source_id", "entity", "volume_today")
    per_entity = known.groupBy("snapshot_day", "source_id", "entity").agg(F.sum("volume_today").alias("volume"))
    whole = per_entity.groupBy("snapshot_day", "source_id").agg(F.sum("volume").alias("volume"))
    return per_entity.filter(F.col("entity").isNotNull()).unionByName(
        whole.withColumn("entity", F.lit(None).cast("string"))
    )


def judged_ranges(
    volumes: DataFrame, facts: DataFrame, far_above_pct: float = 100, far_below_pct: float = 80, **options: int
) -> DataFrame:
    """Volumes with the documented ranges that apply to them, and where they lie.

    Ranges of the entity apply to the entity's volume and those of the source to its whole volume; of either, those for
    the weekday take the place of those for any day. ``severity`` is 0 inside, 1 outside and 2 far outside: more than
    ``far_above_pct`` above the upper or ``far_below_pct`` below the lower bound.
    """
    stated = facts.select("source_id", "ranges")
    ranged = lookup(volumes, stated, ["source_id"], "inner", can_be_hot=False, **options)
    own = F.filter("ranges", lambda r: r["entity"].eqNullSafe(F.col("entity")))
    of_day = F.filter(own, lambda r: r["dow"] == F.date_format("snapshot_day", "EEEE"))
    of_any = F.filter(own, lambda r: r["dow"].isNull())
    applicable = F.when(F.size(of_day) > 0, of_day).otherwise(of_any)
    ranges = F.transform(applicable, lambda r: F.struct(r["kind"], r["dow"], r["lo"], r["hi"]))
    rows = ranged.select("snapshot_day", "source_id", "entity", "volume", F.inline(ranges))
    volume, lo, hi = F.col("volume"), F.col("lo"), F.col("hi")
    above = F.coalesce(volume > hi, F.lit(False))
    below = F.coalesce(F.when(F.col("kind") == "minimum", volume <= lo).otherwise(volume < lo), F.lit(False))
    far = (above & (volume > hi * (1 + far_above_pct / 100))) | (below & (volume < lo * (1 - far_below_pct / 100)))
    severity = F.when(far, 2).when(above | below, 1).otherwise(0)
    return rows.withColumn("is_above", above).withColumn("severity", severity.cast("int"))


def outside_ranges(volumes: DataFrame, facts: DataFrame, **options: float) -> DataFrame:
    """Volumes that leave a documented range, one row per range left."""
    return judged_ranges(volumes, facts, **options).filter(F.col("severity") > 0)


def late_against_window(manifest: DataFrame, facts: DataFrame, hours: int = 4, **options: int) -> DataFrame:
    """Today's files uploaded more than ``hours`` after the documented slot they are nearest to."""
    stated = facts.select("source_id", "entities", "windows", "usual_times")
    joined = lookup(with_pattern(manifest.filter(F.col("from_period") == "today")), stated, ["source_id"], "inner", **options)
    minute = minute_of(F.col("snapshot_day"), F.col("uploaded_at"))
    placed = joined.withColumn("entity", entity_of(F.col("pattern"), F.col("entities"))).withColumn("slots", arrival_slots())
    slot = placed.withColumn("slot", nearest_slot("slots", minute))
    due = F.col("snapshot_day").cast("timestamp") + F.make_dt_interval(mins=F.col("slot.end_min"))
    hours_late = (F.unix_micros("uploaded_at") - F.unix_micros(due)) / F.lit(3.6e9)
    return (
        slot.withColumn("hours_late", hours_late)
        .filter(F.col("hours_late") > hours)
        .select(
            "snapshot_day",
            "source_id",
            "filename",
            "entity",
            "uploaded_at",
            F.col("slot.start_min").alias("window_start"),
            F.col("slot.end_min").alias("window_end"),
            "hours_late",
        )
    )
