"""dqwatch: data-quality checks over daily file deliveries, as Spark DataFrame plans."""

from dqwatch.plans.findings import all_findings
from dqwatch.plans.analysis import run_report, single_source_report
from dqwatch.operators.summary import quality_rates, quality_summary, source_summary
from dqwatch.sources.cv_files import cv_facts, read_cvs
from dqwatch.sources.manifest_json import read_manifest, unread_elements
from dqwatch.sqlview import ManifestTools

__all__ = [
    "ManifestTools",
    "all_findings",
    "cv_facts",
    "quality_rates",
    "quality_summary",
    "read_cvs",
    "read_manifest",
    "run_report",
    "single_source_report",
    "source_summary",
    "unread_elements",
]
