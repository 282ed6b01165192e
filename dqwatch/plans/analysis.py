"""End to end: manifest and profiles in, report out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from dqwatch.operators.detectors import DEFAULT_LIMITS, Limits
from dqwatch.operators.expectations import delivery_days, pattern_facts
from dqwatch.operators.listings import in_scope
from dqwatch.operators.timing_runs import source_shifts, timing_runs
from dqwatch.plans.findings import all_findings, unread_findings
from dqwatch.plans.report import executive_report, ordered_report
from dqwatch.plans.synthesis import source_issues, source_lines, source_report
from dqwatch.sources.cv_files import cv_facts, first_sources


class Analysis:
    """The tables of one analysis, each built when it is asked for.

    ``keep`` persists what several outputs read: the profiles' facts, the pattern table, the findings and the one row per source-day. Blocks lost with an executor are recomputed from their lineage; ``release``,
    or leaving a ``with`` block, drops them.
    """

    def __init__(
        self,
        manifest: DataFrame,
        cv_docs: DataFrame,
        limits: Limits,
        keep: bool,
        options: dict[str, int],
        bands: DataFrame | None = None,
        unread: DataFrame | None = None,
    ):
        self._manifest = manifest
        self._limits = limits
        self._keep = keep
        self._options = options
        self._bands = bands
        self._unread = unread
        self._kept: list[DataFrame] = []
        self._facts = self._shared(cv_facts(cv_docs))

    def _shared(self, table: DataFrame) -> DataFrame:
        if self._keep:
            self._kept.append(table.persist())
        return table

    @cached_property
    def by_pattern(self) -> DataFrame:
        return self._shared(pattern_facts(self._manifest, self._facts, **self._options))

    @cached_property
    def findings(self) -> DataFrame:
        found = all_findings(
            self._manifest, self._facts, "all", self._limits, self.by_pattern, self._bands, **self._options
        )
        return self._shared(found if self._unread is None else found.unionByName(unread_findings(self._unread)))

    @cached_property
    def issues(self) -> DataFrame:
        return self._shared(
            source_issues(
                self._manifest,
                self.findings,
                self._facts,
                delivery_days(self.by_pattern if self._keep else self._manifest),
                self._limits,
                self.by_pattern if self._keep else None,
            )
        )

    @cached_property
    def timing_runs(self) -> DataFrame:
        """Runs of late and early days over the days of the manifest."""
        return timing_runs(self.findings, self.by_pattern)

    @cached_property
    def lines(self) -> DataFrame:
        return source_lines(self.issues, self.findings, self._facts, source_shifts(self.timing_runs), **self._options)

    def report(self, clock: str = "00:00") -> DataFrame:
        return executive_report(self.lines, clock)

    def source_reports(self) -> DataFrame:
        return source_report(self.lines, self.findings, **self._options)

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def analyze(
    manifest: DataFrame,
    cv_docs: DataFrame,
    scope: str = "current",
    limits: Limits = DEFAULT_LIMITS,
    max_sources: int | None = None,
    keep: bool = True,
    bands: DataFrame | None = None,
    unread: DataFrame | None = None,
    **options: int,
) -> Analysis:
    """Detect, roll up and describe; ``max_sources`` restricts the run to the first profiles, ``bands`` brings volume history.

    ``unread`` takes what the reader left out (``unread_elements``), so that the report tells of it.
    """
    if max_sources is not None:
        cv_docs = first_sources(cv_docs, max_sources)
        manifest = manifest.join(cv_docs.select("source_id"), "source_id", "left_semi")
    return Analysis(in_scope(manifest, scope), cv_docs, limits, keep, options, bands, unread)


def run_report(
    manifest: DataFrame,
    cv_docs: DataFrame,
    as_of: str = "00:00",
    max_sources: int | None = None,
    scope: str = "current",
    keep: bool = True,
    unread: DataFrame | None = None,
) -> DataFrame:
    """Ordered report lines for every day and source of the manifest; ``as_of`` is the header's UTC clock.

    The kept tables live as long as the session; ``with analyze(...) as a`` and ``a.report(...)`` drop them after use.
    """
    return ordered_report(analyze(manifest, cv_docs, scope, max_sources=max_sources, keep=keep, unread=unread).report(as_of))


def single_source_report(
    manifest: DataFrame, cv_docs: DataFrame, source_id: str, scope: str = "current"
) -> DataFrame:
    """The report record of one source; the filter reaches the scan."""
    one = F.col("source_id") == source_id
    return analyze(manifest.filter(one), cv_docs.filter(one), scope).source_reports()
