"""Thresholds and exemptions of the six detectors on hand-made files."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from dqwatch.operators.listings import in_scope, outside_scope
from dqwatch.operators.detectors import Limits
from dqwatch.plans.findings import all_findings, detector_findings, detector_records
from tests.conftest import DAY, file, rows

NO_CV = "# Nothing"


def found(manifest, facts, detector, *columns, **options):
    return rows(detector_findings(manifest, facts, detector, **options), *columns)


def by_source(found_rows):
    out = {}
    for source, *rest in found_rows:
        out.setdefault(source, []).append(tuple(rest))
    return out


VOLUME_CASES = [
    # today, last week, findings
    (150, 100, []),
    (151, 100, [("volume_up", 1)]),
    (200, 100, [("volume_up", 1)]),
    (201, 100, [("volume_up", 2)]),
    (50, 100, []),
    (49, 100, [("volume_down", 1)]),
    (20, 100, [("volume_down", 1)]),
    (1999, 10000, [("volume_down", 2)]),
    (7, 0, []),
    (0, 100, [("volume_down", 2)]),
]


def test_volume_limits_are_strict(manifest_of, facts_of):
    files = []
    for i, (today, before, _) in enumerate(VOLUME_CASES):
        files.append(file("a_Shop_report_2025_09_08.csv", today, source=str(i)))
        files.append(file("b_Shop_report_2025_09_01.csv", before, source=str(i), period="last_weekday"))
    got = by_source(found(manifest_of(*files), facts_of(s0=NO_CV), "volume", "source_id", "kind", "severity"))
    assert got == {str(i): expected for i, (_, _, expected) in enumerate(VOLUME_CASES) if expected}


def test_volume_ignores_unfinished_files_and_sums_a_pattern(manifest_of, facts_of):
    m = manifest_of(
        file("a_Shop_report_2025_09_08.csv", 100),
        file("b_Shop_report_2025-09-08.csv", 110),
        file("c_Shop_report_20250908.csv", 9999, status="failure"),
        file("d_Shop_report_2025_09_01.csv", 100, period="last_weekday"),
        file("e_Shop_report_2025_09_01.csv", 100, period="last_weekday"),
    )
    assert found(m, facts_of(s1=NO_CV), "volume", "kind") == []


UPLOAD_CASES = [
    # seconds after last week's upload, findings
    (0, []),
    (4 * 3600, []),
    (4 * 3600 + 1, [("late", 1)]),
    (-4 * 3600, []),
    (-4 * 3600 - 1, [("early", 0)]),
]


def test_upload_against_last_week(manifest_of, facts_of):
    files = []
    for i, (seconds, _) in enumerate(UPLOAD_CASES):
        files.append(file("a_Shop_report_2025_09_08.csv", hour=10 + seconds / 3600, source=str(i)))
        files.append(file("b_Shop_report_2025_09_01.csv", hour=10, source=str(i), period="last_weekday"))
    got = by_source(found(manifest_of(*files), facts_of(s0=NO_CV), "late", "source_id", "kind", "severity"))
    assert got == {str(i): expected for i, (_, expected) in enumerate(UPLOAD_CASES) if expected}


def test_upload_against_documented_window(manifest_of, facts_of):
    facts = facts_of(s1="# x\nArrives 08:00-08:20 UTC", s2="# x\nusual ~17:20 UTC", s3="# x\nArrives 08:00–08:20 UTC\nVariable arrival: Shop")
    late, early = "a_Shop_report_2025_09_08.csv", "b_Shop_report_2025_09_08.csv"
    m = manifest_of(
        *[file(late, hour=12.5, source=s) for s in "13"],
        file(early, hour=8.1, source="2"),
        file("c_Shop_report_2025_09_01.csv", hour=17.0, source="2", period="last_weekday"),
    )
    assert found(m, facts, "late", "source_id", "kind", "severity", "message") == [
        ("1", "late", 1, "Shop file arrived 4.2 hours late at 12:30 UTC (expected 08:20 UTC)"),
        ("2", "early", 1, "Shop file delivered early at 08:06 UTC (usual ~17:20)"),
    ]


def test_early_as_last_week_is_no_schedule_change(manifest_of, facts_of):
    m = manifest_of(
        file("b_Shop_report_2025_09_08.csv", hour=8.1),
        file("c_Shop_report_2025_09_01.csv", hour=8.0, period="last_weekday"),
    )
    assert found(m, facts_of(s1="# x\nusual ~17:20 UTC"), "late", "kind", "severity") == [("early", 0)]


def test_empty_needs_a_filled_baseline(manifest_of, facts_of):
    cases = {"0": None, "1": 0, "2": 1, "3": 10, "4": 11, "5": 1001, "6": 1001}
    files = [file("a_Shop_report_2025_09_08.csv", 0, status="empty", source=s) for s in cases]
    files += [file("b_Shop_report_2025_09_01.csv", n, period="last_weekday", source=s) for s, n in cases.items()]
    facts = facts_of(s6="# x\nRegularly empty: Shop")
    got = found(manifest_of(*files), facts, "empty", "source_id", "severity")
    assert got == [("2", 0), ("3", 0), ("4", 1), ("5", 1)]


def test_missing_from_last_week_and_from_profile(manifest_of, facts_of):
    facts = facts_of(
        s1="# x\nArrives 08:00-08:20 UTC\nExpected files: [hash]_Shop_report_YYYY_MM_DD.csv; [hash]_Google_report_YYYY_MM_DD.csv",
        s2="# x\nNot expected on: Monday\nExpected files: [hash]_Shop_report_YYYY_MM_DD.csv",
        s3="# x",
    )
    m = manifest_of(
        file("a_Shop_report_2025_09_08.csv", status="deleted"),
        file("a_Market_report_2025_09_01.csv", period="last_weekday"),
        file("a_Market_report_2025_09_01.csv", period="last_weekday", source="2"),
        file("z_other.csv", source="3"),
    )
    assert found(m, facts, "missing", "source_id", "pattern", "entity", "message") == [
        ("1", "Google_report.csv", "Google", "missing past 08:00–08:20 UTC — expected: *_Google_report_2025_09_08.csv"),
        ("1", "Market_report.csv", "Market", "missing past 08:00–08:20 UTC — expected: *_Market_report.csv"),
    ]


def test_duplicated_and_failed_kinds(manifest_of, facts_of):
    m = manifest_of(
        file("a.csv", status="stopped", dup=True, message="File duplicated"),
        file("b.csv", status="failure", message="row 12 bad"),
        file("c.csv", status="deleted"),
        file("d.csv", dup=True),
        file("e.csv", status="stopped"),
        file("f.csv", status="odd", dup=None),
        file("g.csv", status=None, dup=None),
    )
    assert found(m, facts_of(s1=NO_CV), "duplicated_failed", "filename", "kind", "severity", "message") == [
        ("a.csv", "blocked_duplicate", 1, "a.csv — stopped (File duplicated), duplicate"),
        ("b.csv", "failure", 1, "b.csv — failure (row 12 bad)"),
        ("c.csv", "deleted", 1, "c.csv — deleted"),
        ("d.csv", "duplicate", 0, "d.csv — processed, duplicate"),
        ("e.csv", "stopped", 1, "e.csv — stopped"),
    ]
    facts = facts_of(s2=NO_CV)
    both = detector_findings(m, facts, "duplicated_failed")
    record = detector_records(both, "duplicated_failed", facts).first()
    assert record.duplicated_files == ["a.csv", "d.csv"] and record.failed_files == ["a.csv", "b.csv", "c.csv", "e.csv"]
    assert (record.total_issues, record.source_name, record.part) == (5, "Source_1", 0) and record.details.startswith("a.csv — stopped (File duplicated), duplicate; d.csv")
    parts = detector_records(both, "duplicated_failed", facts, per_part=2).collect()
    assert len(parts) > 1 and sorted(n for p in parts for n in p.failed_files) == record.failed_files and {p.total_issues for p in parts} == {5}


def test_missing_record_has_the_late_files_too(manifest_of, facts_of):
    facts = facts_of(s1="# x\nExpected files: [hash]_Shop_report_YYYY_MM_DD.csv\nArrives 06:00-07:00 UTC")
    m = manifest_of(file("a_Google_report_2025_09_08.csv", hour=12), file("b_Google_report_2025_09_08.csv", hour=6.5))
    record = detector_records(all_findings(m, facts), "missing", facts).first()
    assert (record.missing_files, record.missing_files_number) == (["Shop_report.csv"], 1)
    assert (record.late_files, record.late_files_number, record.source_name) == (["a_Google_report_2025_09_08.csv"], 1, "Name_1")
    assert "5.0 hours late" in record.details and "expected: *_Shop_report_2025_09_08.csv" in record.details


def test_previous_period_respects_the_lag(manifest_of, facts_of):
    def named(days):
        return file(f"h_Shop_report_{(DAY - timedelta(days=days)):%Y_%m_%d}.csv")

    m = manifest_of(*[named(d) for d in (-1, 0, 1, 3, 4, 9)], file("h_Shop_report.csv"))
    kinds = found(m, facts_of(s1=NO_CV), "previous", "metric", "kind", "severity")
    assert kinds == [(1.0, "recent_backfill", 0), (3.0, "backfill", 0), (4.0, "backfill", 0), (9.0, "historical_backfill", 0)]
    lagged = found(m, facts_of(s1="# x\nExpected coverage: D+3"), "previous", "metric")
    assert lagged == [(4.0,), (9.0,)]


def test_previous_files_are_not_late(manifest_of, facts_of):
    m = manifest_of(file("h_Shop_report_2025_09_01.csv", hour=20))
    assert found(m, facts_of(s1="# x\nArrives 08:00-08:20 UTC"), "late", "kind") == []


RANGE_CASES = [
    ("usual Monday 40k-55k records", 61639, ["Source volume 61,639 (> usual Monday 40,000–55,000)"]),
    ("usual Monday 40k-55k records", 55000, []),
    ("usual Tuesday 40k-55k records", 61639, []),
    ("typical range 800k-900k", 799999, ["Source volume 799,999 (< typical range 800,000–900,000)"]),
    ("95% confidence band: 50,211-869,600", 1023337, ["Source volume 1,023,337 (>95% bound 869,600)"]),
    ("expected volume >1000 records", 1000, ["Source volume 1,000 (expected >1,000)"]),
    ("expected volume >1000 records", 1001, []),
    ("typical range 1.5k-2k", 1499, ["Source volume 1,499 (< typical range 1,500–2,000)"]),
]


def test_documented_ranges(manifest_of, facts_of):
    m = manifest_of(*[file("a.csv", volume, source=str(i)) for i, (_, volume, _) in enumerate(RANGE_CASES)])
    facts = facts_of(**{f"s{i}": f"# x\n{text}" for i, (text, _, _) in enumerate(RANGE_CASES)})
    got = by_source(found(m, facts, "volume", "source_id", "message"))
    assert got == {str(i): [(t,) for t in texts] for i, (_, _, texts) in enumerate(RANGE_CASES) if texts}


NAMES = {e: f"h_{e}_report_2025_09_08.csv" for e in ("Shop", "Google")}


def test_deliveries_take_the_nearest_slot(manifest_of, facts_of):
    facts = facts_of(
        s1="# x\nusual ~08:00 UTC, usual ~20:00 UTC",
        s2="# x\nArrives 06:00-06:30 UTC or 19:00-19:30 UTC",
        s3="# x\nEntities: Shop, Google\nShop arrives 06:00-07:00 UTC; Google arrives 13:00-14:00 UTC\nArrives 01:00-02:00 UTC",
        s4="# x\nArrives 23:30-00:30 UTC",
    )
    m = manifest_of(
        *[file(NAMES["Shop"], hour=h, source="1") for h in (8.1, 19 + 59 / 60, 14.5)],
        *[file(NAMES["Shop"], hour=h, source="2") for h in (6.2, 19.2, 12.0, 14.0)],
        file(NAMES["Shop"], hour=13.5, source="3"),
        file(NAMES["Google"], hour=13.5, source="3"),
        file("h_Market_report_2025_09_08.csv", hour=6.5, source="3"),
        *[file(NAMES["Shop"], hour=h, source="4") for h in (0.2, -0.4, 5.0)],
    )
    assert found(m, facts, "late", "source_id", "kind", "message") == [
        ("1", "early", "Shop file delivered early at 14:30 UTC (usual ~20:00)"),
        ("2", "early", "Shop file delivered early at 14:00 UTC (usual ~19:00)"),
        ("2", "late", "Shop file arrived 5.5 hours late at 12:00 UTC (expected 06:30 UTC)"),
        ("3", "late", "Market file arrived 4.5 hours late at 06:30 UTC (expected 02:00 UTC)"),
        ("3", "late", "Shop file arrived 6.5 hours late at 13:30 UTC (expected 07:00 UTC)"),
        ("4", "late", "Shop file arrived 4.5 hours late at 05:00 UTC (expected 00:30 UTC)"),
    ]


def test_ranges_of_entities_and_weekdays_come_first(manifest_of, facts_of):
    by_entity = "Entities: Shop, Google\nShop usual Monday 1k-2k; Google usual Monday 5k-9k"
    facts = facts_of(
        s1=f"# x\n{by_entity}",
        s2=f"# x\n{by_entity}",
        s3="# x\nEntities: Shop\nShop usual Monday 1k-2k\nShop typical range 10k-20k\ntypical range 100k-200k",
        s4="# x\nEntities: Shop\nShop typical range 10k-20k\nusual Monday 100k-200k and typical range 1-2",
    )
    m = manifest_of(
        *[file(NAMES[e], n, source="1") for e, n in (("Shop", 1500), ("Google", 7000))],
        *[file(NAMES[e], n, source="2") for e, n in (("Shop", 2500), ("Google", 700))],
        file(NAMES["Shop"], 1500, source="3"),
        file(NAMES["Shop"], 15000, source="4"),
    )
    assert found(m, facts, "volume", "source_id", "message", "severity") == [
        ("2", "Google volume 700 (< usual Monday 5,000–9,000)", 2),
        ("2", "Shop volume 2,500 (> usual Monday 1,000–2,000)", 1),
        ("3", "Source volume 1,500 (< typical range 100,000–200,000)", 2),
        ("4", "Source volume 15,000 (< usual Monday 100,000–200,000)", 2),
    ]


def test_documented_ranges_decide_over_the_weekly_comparison(manifest_of, facts_of):
    before = {"1": 20_000, "2": 20_000, "3": 10_000, "4": 20_000}
    now = {"1": 50_000, "2": 60_000, "3": 50_000, "4": 50_000}
    text = "# x\nEntities: Shop\n"
    facts = facts_of(s1=f"{text}usual Monday 40k-55k", s2=f"{text}usual Monday 40k-55k", s3=f"{text}Shop typical range 40k-55k\ntypical range 1-2", s4=f"{text}usual Friday 40k-55k")
    m = manifest_of(
        *[file(NAMES["Shop"], n, source=s) for s, n in now.items()],
        *[file("g_Shop_report_2025_09_01.csv", n, source=s, period="last_weekday") for s, n in before.items()],
    )
    assert found(m, facts, "volume", "source_id", "kind", "severity", "message") == [
        ("1", "volume_up", 0, "Shop volume 50,000 (150.0% above last week 20,000), within usual Monday 40,000–55,000"),
        ("2", "outside_weekday", 1, "Source volume 60,000 (> usual Monday 40,000–55,000)"),
        ("2", "volume_up", 1, "Shop volume 60,000 (200.0% above last week 20,000)"),
        ("3", "outside_typical", 2, "Source volume 50,000 (> typical range 1–2)"),
        ("3", "volume_up", 0, "Shop volume 50,000 (400.0% above last week 10,000), within typical range 40,000–55,000"),
        ("4", "volume_up", 2, "Shop volume 50,000 (150.0% above last week 20,000)"),
    ]


def test_snapshot_brings_its_own_clock(manifest_of, facts_of):
    m = manifest_of(file("a_Shop_report_2025_09_08.csv", hour=21), file("a_Shop_report_2025_09_01.csv", hour=21, period="last_weekday"))
    late = m.withColumn("snapshot_at", F.col("snapshot_day").cast("timestamp") + F.make_dt_interval(hours=F.lit(22)))
    assert found(m, facts_of(s1=NO_CV), "missing", "pattern") == [] and in_scope(m).count() == 0
    assert found(late, facts_of(s1=NO_CV), "missing", "pattern") == [] and in_scope(late).count() == 2
    gone = late.filter("from_period = 'last_weekday'")
    assert found(gone.unionByName(late.withColumn("uploaded_at", F.col("uploaded_at") + F.make_dt_interval(hours=F.lit(2))).filter("from_period = 'today'")), facts_of(s1=NO_CV), "missing", "pattern") == [("Shop_report.csv",)]
    assert rows(outside_scope(m), "from_period") == [("last_weekday",), ("today",)]


def test_scope_decides_which_rows_are_judged(manifest_of, facts_of):
    old = file("a.csv", status="failure")
    old = (old[0], *old[1:8], old[8] - timedelta(days=30), old[9])
    m = manifest_of(old, file("b.csv"))
    assert found(m, facts_of(s1=NO_CV), "duplicated_failed", "filename") == []
    assert found(m, facts_of(s1=NO_CV), "duplicated_failed", "filename", scope="all") == [("a.csv",)]
    with pytest.raises(ValueError):
        detector_findings(m, facts_of(s1=NO_CV), "late", scope="some")
    with pytest.raises(ValueError):
        detector_findings(m, facts_of(s1=NO_CV), "unknown")


def test_files_without_upload_time_or_of_the_evening_before_are_received(manifest_of, facts_of):
    names = ["a_Shop_report_2025_09_{:02d}.csv", "b_Mall_report_2025_09_{:02d}.csv", "c_Bank_report_2025_09_{:02d}.csv"]
    last = [file(n.format(1), period="last_weekday") for n in names]
    today = [file(names[0].format(8), hour=None), file(names[1].format(8), hour=-1.5), file(names[2].format(8), hour=20.5)]
    m = manifest_of(*last, *today)  # the third comes after the snapshot and belongs to the next one
    assert found(m, facts_of(s1=NO_CV), "missing", "pattern") == [("Bank_report.csv",)]
    assert found(m, facts_of(s1=NO_CV), "late", "kind", "filename") == [("early", names[1].format(8))]


def test_files_without_name_keep_their_findings(manifest_of, facts_of):
    m = manifest_of(file(None, 0, status="failure"), file(None, 9, period="last_weekday"), file(None, 9, period="last_weekday", source="2"))
    facts = facts_of(s1=NO_CV, s2=NO_CV)
    assert found(m, facts, "duplicated_failed", "filename", "pattern", "message") == [(None, None, "unnamed file — failure")]
    assert found(m, facts, "empty", "message") == [("unnamed empty: 0 records (last week 9)",)]
    assert found(m, facts, "missing", "message") == []


def test_single_detectors_filter_before_the_join(manifest_of, facts_of):
    m = manifest_of(file("a.csv", status="failure"), file("b.csv", 0), file("b.csv", 5, period="last_weekday"), file("c_2025_09_01.csv"))
    everything = all_findings(m, facts_of(s1=NO_CV))
    for detector in ("duplicated_failed", "empty", "late", "previous"):
        own = rows(everything.filter(everything.detector == detector), "kind", "filename", "message")
        assert found(m, facts_of(s1=NO_CV), detector, "kind", "filename", "message") == own


def test_limits_are_parameters(manifest_of, facts_of):
    m = manifest_of(file("a_x.csv", 120), file("b_x.csv", 100, period="last_weekday"))
    assert found(m, facts_of(s1=NO_CV), "volume", "kind", limits=Limits(volume_pct=10)) == [("volume_up",)]


def test_salted_joins_and_partitioning_do_not_change_findings(manifest_of, facts_of):
    facts = facts_of(s1="# x\nArrives 08:00-08:20 UTC\nEntities: Shop")
    files = [file(f"h{i}_Shop_report_2025_09_{8 - i % 3:02d}.csv", i % 5, hour=8 + i % 7, dup=i % 11 == 0, status="stopped" if i % 11 == 0 else "processed") for i in range(60)]
    files += [files[0]] * 30 + [file(f"h{i}_Shop_report_2025_09_01.csv", i, period="last_weekday") for i in range(40)]
    m = manifest_of(*files)
    columns = ["source_id", "detector", "kind", "filename", "pattern", "metric", "baseline", "message"]

    def key(df):
        return sorted(map(str, df.select(*columns).collect()))

    plain = key(all_findings(m, facts))
    assert len(plain) > 60
    assert key(all_findings(m.repartition(7), facts, broadcast_bytes=-1, hot_rows=10)) == plain


def test_weekday_name_of_the_fixture():
    assert date(2025, 9, 8).strftime("%A") == "Monday"
