"""The executive report: a header, three sections and one bullet per source, for every day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Section number, heading and the line of a section without sources.
SECTIONS = [
    (1, 2, "* Urgent Action Required*", "• No issues required at this time."),
    (2, 1, "* Needs Attention*", "• No attention required at this time."),
    (3, 0, "* No Action Needed*", "• No issues required at this time."),
]
COLUMNS = ["snapshot_day", "section", "position", "source_id", "line"]


def report_bullets(lines: DataFrame) -> DataFrame:
    """One bullet per source-day; urgent and attention bullets carry their action."""
    bullet = F.concat(
        F.lit("• *"),
        "source_name",
        F.lit(" (id: "),
        "source_id",
        F.lit(")* – "),
        F.date_format("snapshot_day", "yyyy-MM-dd"),
        F.lit(": "),
        "summary_line",
        F.when(
            (F.col("severity") > 0) & (F.col("recommended_action") != ""),
            F.concat(F.lit(" → *Action:* "), "recommended_action"),
        ).otherwise(""),
    )
    return lines.select(
        "snapshot_day",
        (3 - F.col("severity")).cast("int").alias("section"),
        F.lit(1).alias("position"),
        "source_id",
        bullet.alias("line"),
    )


def executive_report(lines: DataFrame, clock: str = "00:00") -> DataFrame:
    """Report lines of every day with their sort keys; order by day, section, position and source.

    ``clock`` is the UTC time shown in the header. Which sections of a day stay empty follows from one
    count per day, so the frame of the report is made of a handful of rows per day.
    """
    per_day = lines.groupBy("snapshot_day").agg(
        *[F.count_if(F.col("severity") == level).alias(f"n_{number}") for number, level, _, _ in SECTIONS]
    )
    frame = [
        F.struct(F.lit(0).alias("section"), F.lit(0).alias("position"), F.lit(header).alias("line"))
        for header in [f"*Report generated at UTC HOUR*: {clock} UTC"]
    ]
    for number, _, heading, empty in SECTIONS:
        frame.append(
            F.struct(F.lit(number).alias("section"), F.lit(0).alias("position"), F.lit(heading).alias("line"))
        )
        frame.append(
            F.when(
                F.col(f"n_{number}") == 0,
                F.struct(F.lit(number).alias("section"), F.lit(1).alias("position"), F.lit(empty).alias("line")),
            )
        )
    framed = per_day.select("snapshot_day", F.inline(F.array_compact(F.array(*frame)))).withColumn(
        "source_id", F.lit("")
    )
    return framed.select(*COLUMNS).unionByName(report_bullets(lines).select(*COLUMNS))


def ordered_report(report: DataFrame) -> DataFrame:
    return report.orderBy("snapshot_day", "section", "position", "source_id")
