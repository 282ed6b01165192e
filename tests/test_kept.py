"""What is read once and dealt out, so that time grows with the input only."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqwatch.operators import detectors, expectations
from dqwatch.operators.listings import in_scope
from dqwatch.plans.analysis import analyze
from dqwatch.sources import derived
from dqwatch.sources.cv_files import cv_facts
from tests.conftest import file, rows

TEXT = "# A\nEntities: euL0\nArrives 08:00-08:20 UTC"


def test_kept_pattern_table_tells_hot_patterns_without_counting_files(manifest_of, facts_of, monkeypatch):
    files = [file(f"{n:08x}_euL0_payments_report_2025_09_08.csv", hour=15) for n in range(4)]
    manifest, facts = manifest_of(*files, file("a_euL0_payments_report_2025_09_08.csv", hour=None)), facts_of(s1=TEXT)
    counted = []
    lookup = detectors.lookup

    def spy(rows, facts, keys, how, counts, *args, **options):
        counted.append(sorted(r.n for r in counts.collect()))
        return lookup(rows, facts, keys, how, counts, *args, **options)

    monkeypatch.setattr(detectors, "lookup", spy)
    by_pattern = expectations.pattern_facts(in_scope(manifest), facts)
    salted = {"broadcast_bytes": -1, "hot_rows": 2}
    plain = rows(detectors.file_findings(manifest, by_pattern, ("late",), **salted), "filename", "message")
    kept = by_pattern.persist()
    try:
        again = rows(detectors.file_findings(manifest, kept, ("late",), **salted), "filename", "message")
    finally:
        kept.unpersist()
    # the file without a time is no concern of the detector, the pattern table has it
    assert counted == [[4], [5]]
    assert again == plain and len(plain) == 4


def test_profiles_are_matched_in_as_many_tasks_as_there_are_cores(spark, docs_of):
    docs = docs_of(**{f"s{n}": TEXT for n in range(40)})
    assert docs.rdd.getNumPartitions() == 1
    facts = cv_facts(docs)
    assert facts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert facts.count() == 40


def test_analysis_keeps_the_facts(manifest_of, docs_of):
    with analyze(manifest_of(file("a_euL0_report.csv")), docs_of(s1=TEXT)) as analysis:
        assert analysis._facts.is_cached
    assert not analysis._kept


def test_rows_of_one_row_group_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    in_one = spark.range(0, 100 * cores, 1, cores).filter(F.col("id") < 100)
    dealt = derived._dealt_out(in_one, "id")
    assert len(in_one.select(F.spark_partition_id().alias("p")).distinct().collect()) == 1
    assert len(dealt.select(F.spark_partition_id().alias("p")).distinct().collect()) > 1
    assert dealt.count() == 100
