"""Ad-hoc SQL over a manifest: one view ``data`` with today's files, one with both periods."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dqwatch.operators.listings import today
from dqwatch.operators.summary import quality_rates, quality_summary

PREVIEW_ROWS = 100
NO_ROWS = "Query executed successfully but returned no results."


class ManifestTools:
    """Query tools over a manifest and its profiles.

    Each scope has its own session, so both can call their view ``data`` without touching the views of
    the caller's session.
    """

    def __init__(self, manifest: DataFrame, cv_docs: DataFrame | None = None):
        self._manifest = manifest
        self._cv_docs = cv_docs
        self._view = f"manifest_{uuid.uuid4().hex}"
        manifest.createOrReplaceGlobalTempView(self._view)
        self._today = self._session("WHERE from_period = 'today'")
        self._all = self._session("")

    def _session(self, where: str) -> SparkSession:
        session = self._manifest.sparkSession.newSession()
        session.conf.set("spark.sql.session.timeZone", "UTC")
        session.sql(f"CREATE TEMPORARY VIEW data AS SELECT * FROM global_temp.{self._view} {where}")
        return session

    @staticmethod
    def _query(session: SparkSession, sql: str) -> DataFrame:
        # as a subquery only a SELECT parses, so definitions and writes are refused
        return session.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")

    def query_today(self, sql: str) -> DataFrame:
        return self._query(self._today, sql)

    def query_today_and_last_weekday(self, sql: str) -> DataFrame:
        return self._query(self._all, sql)

    def read_cv(self, source_id: str) -> DataFrame:
        if self._cv_docs is None:
            raise ValueError("no profiles were given")
        return self._cv_docs.filter(F.col("source_id") == source_id)

    def quality(self, *keys: str) -> DataFrame:
        """Day-quality measures of today's files with their rates."""
        summary = quality_summary(today(self._manifest), *keys)
        rates = quality_rates(summary, *summary.columns)
        return rates

    def quality_text(self) -> str:
        row = self.quality()
        first = row.first()

        def shown(value: float | None) -> str:
            return "n/a" if value is None else f"{value:.1f}%"

        return "\n".join(
            [
                "Data Quality Summary for Today:",
                preview(row),
                "",
                "Quick Insights:",
                f"- Success Rate: {shown(first.success_rate)}",
                f"- Duplicate Rate: {shown(first.duplicate_rate)}",
                f"- Empty File Rate: {shown(first.empty_file_rate)}",
            ]
        )

    def close(self) -> None:
        self._today.catalog.dropTempView("data")
        self._all.catalog.dropTempView("data")
        self._manifest.sparkSession.catalog.dropGlobalTempView(self._view)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> str:
    """Markdown table of the first rows; the DataFrame itself stays whole."""
    head = df.limit(rows + 1).collect()
    if not head:
        return NO_ROWS

    def line(values: list) -> str:
        return "| " + " | ".join("" if v is None else str(v) for v in values) + " |"

    table = [line(df.columns), line(["---"] * len(df.columns)), *[line(list(r)) for r in head[:rows]]]
    if len(head) <= rows:
        return "\n".join(table)
    total = df.count()
    return "\n".join(
        [f"Query returned {total} rows. Showing first {rows}:", "", *table, "", f"... ({total - rows} more rows)"]
    )
