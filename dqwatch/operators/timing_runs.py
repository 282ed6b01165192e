"""Late and early days of a pattern as runs, and whether a run is a shift of its upload time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqwatch.operators.lookup import shuffled
from dqwatch.operators.patterns import KEYS

#: The day's level of a pattern is its first upload, in microseconds from the start of the day.
DAY_START = "CAST(snapshot_day AS TIMESTAMP)"


@dataclass(frozen=True)
class ShiftRules:
    """A run of at least ``min_run`` delivery days is persistent. It is a shift if its mean level lies more than
    ``min_shift_minutes`` from that of up to ``days_before`` delivery days before it, and all its days lie on that side
    of all of them."""

    min_run: int = 3
    days_before: int = 7
    min_shift_minutes: int = 60


DEFAULT_RULES = ShiftRules()


def timing_runs(findings: DataFrame, by_pattern: DataFrame, rules: ShiftRules = DEFAULT_RULES) -> DataFrame:
    """One row per pattern and day with late or early files: which run of days it belongs to, up to that day.

    Days without a delivery don't end a run. ``course`` is ``once`` (a first day), ``repeated``, ``persistent`` or
    ``shifted``; ``shift_minutes`` is NULL where no day lies before the run. Windows run over one row per pattern and
    delivery day.
    """
    late, early = F.col("kind") == "late", F.col("kind") == "early"
    judged = (
        findings.filter((F.col("detector") == "late") & F.col("pattern").isNotNull())
        .groupBy(*KEYS)
        .agg(F.count_if(late).alias("n_late"), F.count_if(early).alias("n_early"))
    )
    level = F.unix_micros("first_upload_today") - F.unix_micros(F.expr(DAY_START))
    delivered = by_pattern.filter((F.col("n_today") > 0) & F.col("pattern").isNotNull()).select(*KEYS, level.alias("level"))
    days = delivered.join(shuffled(judged), KEYS, "left").withColumn(
        "direction", F.when(F.col("n_late") > 0, "late").when(F.col("n_early") > 0, "early").otherwise("on time")
    )
    of_pattern = Window.partitionBy("source_id", "pattern").orderBy("snapshot_day")
    before = of_pattern.rowsBetween(-rules.days_before, -1)
    begins = ~F.col("direction").eqNullSafe(F.lag("direction").over(of_pattern))
    run = Window.partitionBy("source_id", "pattern", "run").orderBy("snapshot_day")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)

    def at_start(column: str) -> Column:
        return F.first(column).over(so_far)

    marked = days.withColumns(
        {
            "begins": begins,
            "mean_before": F.avg("level").over(before),
            "low_before": F.min("level").over(before),
            "high_before": F.max("level").over(before),
        }
    )
    rows = marked.withColumn("run", F.sum(F.col("begins").cast("int")).over(of_pattern)).withColumns(
        {
            "run_length": F.row_number().over(run),
            "run_start": at_start("snapshot_day"),
            "shift": F.avg("level").over(so_far) - at_start("mean_before"),
            "apart_above": F.min("level").over(so_far) > at_start("high_before"),
            "apart_below": F.max("level").over(so_far) < at_start("low_before"),
        }
    )
    least = rules.min_shift_minutes * 60_000_000
    shifted = ((F.col("shift") > least) & F.col("apart_above")) | ((F.col("shift") < -least) & F.col("apart_below"))
    persistent = F.col("run_length") >= rules.min_run
    course = (
        F.when(persistent & shifted, "shifted").when(persistent, "persistent").when(F.col("run_length") > 1, "repeated").otherwise("once")
    )
    return rows.filter(F.col("direction") != "on time").select(
        *KEYS,
        "direction",
        F.col("run_start"),
        F.col("run_length").cast("int").alias("run_length"),
        F.floor(F.col("shift") / 60_000_000).cast("bigint").alias("shift_minutes"),
        course.alias("course"),
    )


def source_shifts(runs: DataFrame) -> DataFrame:
    """Per source-day: how many patterns are shifted, and the largest shift of them with its first day."""
    shifted = runs.filter(F.col("course") == "shifted")
    size = F.struct(F.abs("shift_minutes").alias("size"), "shift_minutes", "run_start", "pattern")
    return shifted.groupBy("snapshot_day", "source_id").agg(F.count(F.lit(1)).alias("n_shifted"), F.max(size).alias("largest")).select(
        "snapshot_day", "source_id", "n_shifted", F.col("largest.shift_minutes").alias("shift_minutes"), F.col("largest.run_start").alias("shifted_since")
    )
