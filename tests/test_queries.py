"""Every registered query against DuckDB, and the shape of its plan."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from dqwatch.plans.synthesis import ranked_findings
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert QUERIES[name](spark, SF_DIR).count() > 0
        return
    ok, note = compare(spark, duck, QUERIES[name], sql, SF_DIR)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(QUERIES)


def test_entry_is_a_whole_report(spark):
    report = entry(spark)
    assert report.columns == ["snapshot_day", "section", "position", "source_id", "line"]
    lines = [r.line for r in report.collect()]
    assert sum(line.startswith("*Report generated") for line in lines) == 30


@pytest.mark.parametrize("name", ["findings", "executive_report", "volume_files", "naming_duplicates", "missing_expected"])
def test_no_pairing_of_everything_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]:
        assert operator not in plan


def test_scan_reads_only_what_is_used(spark):
    plan = QUERIES["total_records"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_rank_limit_applies_before_the_shuffle(spark):
    plan = ranked_findings(QUERIES["findings"](spark, SF_DIR), 20)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
