"""Volume history as a growing state, bounds that decide, and calendar rules of single files."""

from __future__ import annotations

import random
from datetime import timedelta

from dqwatch.operators import expectations, history, volume_state
from dqwatch.operators.detectors import pattern_findings
from dqwatch.plans.findings import all_findings, detector_findings
from dqwatch.sources import cv_files
from tests.conftest import DAY, file, rows

VOLUMES = "day date, source_id string, pattern string, volume long"


def test_state_after_every_merge_equals_bands_from_scratch(spark, tmp_path):
    rng = random.Random(4)
    days = [DAY + timedelta(days=d) for d in range(0, 91, 7)] + [DAY + timedelta(days=1)]
    table = [(d, "1", p, rng.randrange(10**12)) for d in days for p in "abc" if rng.random() < 0.8]
    volumes = spark.createDataFrame(table, VOLUMES).persist()
    columns = ["source_id", "pattern", "n_days", "lowest", "highest", "mean_volume", "lower", "upper"]
    whole = {(r.day, r.pattern): tuple(r[c] for c in columns) for r in history.volume_bands(volumes, n_days=4).collect()}
    path, state = str(tmp_path / "state"), volume_state.state_of(volumes.filter(volumes.day < days[5]), 4)
    for before, day in zip(days[4:12], days[5:13], strict=True):
        volume_state.write_state(state, path, before)
        volume_state.write_state(state, path, before)  # a repeated run
        state = volume_state.read_state(spark, path, day)
        for again in (state, volume_state.merged(state, volumes.filter(volumes.day == day), 4)):
            got = {r.pattern: tuple(r[c] for c in columns) for r in volume_state.bands_on(again, day, 4).collect()}
            assert {p: got.get(p) for d, p in whole if d == day} == {p: whole[d, p] for d, p in whole if d == day}
        state = volume_state.merged(again, volumes.filter(volumes.day == day), 4)
    assert volume_state.read_state(spark, path, days[4]) is None
    assert max(len(r.recent) for r in state.collect()) == 5
    assert volume_state.merged(state.limit(0), volumes.limit(0)).count() == 0
    volumes.unpersist()


def test_history_decides_where_nothing_is_documented(manifest_of, facts_of, spark):
    name = "h_Shop_report_2025_09_08.csv"
    m = manifest_of(
        *[file(name, n, source=s) for s, n in (("1", 160), ("2", 160), ("3", 120), ("4", 160))],
        *[file("g_Shop_report_2025_09_01.csv", 100, source=s, period="last_weekday") for s in "1234"],
    )
    facts = facts_of(s1="# x", s2="# x", s3="# x", s4="# x\nexpected volume >100 records")
    bands = [(DAY, "1", "Shop_report.csv", 8, 90.0, 170.5), (DAY, "2", "Shop_report.csv", 8, 90.0, 110.0), (DAY, "3", "Shop_report.csv", 8, 90.0, 110.5), (DAY, "4", "Shop_report.csv", 2, None, None)]
    bands = spark.createDataFrame(bands, "day date, source_id string, pattern string, n_days long, lower double, upper double")
    got = rows(detector_findings(m, facts, "volume", bands=bands), "source_id", "kind", "severity", "message")
    assert got == [
        ("1", "volume_up", 0, "Shop volume 160 (60.0% above last week 100), within 95% bounds 90–170 of 8 earlier Mondays"),
        ("2", "volume_up", 1, "Shop volume 160 (60.0% above last week 100)"),
        ("3", "outside_history", 1, "Shop volume 120 (>95% bound 110)"),
        ("4", "volume_up", 0, "Shop volume 160 (60.0% above last week 100), within expected >100"),
    ]
    assert rows(all_findings(m, facts, bands=bands).filter("detector = 'volume'"), "source_id", "kind", "severity", "message") == got


def test_files_have_days_of_their_own(manifest_of, facts_of):
    text = "# x\nExpected files: [hash]_A_report_YYYY_MM_DD.csv (weekdays); [hash]_B_report_YYYY_MM_DD.csv (Mondays, Thursday); C (1).csv; [hash]_D_report.csv (weekend); [hash]_E_report.csv"
    facts = facts_of(s1=text)
    assert rows(cv_files.cv_file_patterns(facts), "pattern", "due_mask") == [("A_report.csv", 31), ("B_report.csv", 9), ("C (1).csv", None), ("D_report.csv", 96), ("E_report.csv", None)]
    closed = {(r.pattern, r.not_expected_on) for r in cv_files.cv_schedule(facts).collect()}
    assert {d for p, d in closed if p == "A_report.csv"} == {"Saturday", "Sunday"} and len({d for p, d in closed if p == "B_report.csv"}) == 5
    days = [DAY + timedelta(days=d) for d in range(7)]  # from a Monday on
    m = manifest_of(*[file("h_Z_report.csv", day=d) for d in days], *[file("h_B_report_2025_09_02.csv", day=d, period="last_weekday") for d in days])
    missing = rows(detector_findings(m, facts, "missing"), "snapshot_day", "pattern")
    wanted = [(d, p) for i, d in enumerate(days) for p, due in (("A_report.csv", i < 5), ("B_report.csv", i in (0, 3)), ("C (1).csv", True), ("D_report.csv", i > 4), ("E_report.csv", True)) if due]
    assert missing == wanted
    assert rows(expectations.missing_expected(m, facts), "snapshot_day", "pattern") == wanted


CADENCES = {
    "daily": (range(14), "daily", 127),
    "gap": ([0, 1, 3, 4, 5, 6, 8], "daily", 127),
    "week": ([0, 1, 2, 3, 4, 7, 8, 11], "weekdays", 31),
    "weekly": ([2, 9, 23], "weekly", 4),
    "short": ([0, 7], "irregular", 1),
    "odd": ([0, 3, 5, 13], "irregular", 1 | 8 | 32 | 64),
}


def test_cadence_is_learnt_from_gaps(manifest_of, facts_of):
    files = [file(f"h_{p}_report.csv", day=DAY + timedelta(days=d)) for p, (days, _, _) in CADENCES.items() for d in days for _ in range(2)]
    cadence = expectations.learnt_cadence(manifest_of(*files))
    assert {r.pattern: (r.cadence, r.due_mask) for r in cadence.collect()} == {f"{p}_report.csv": (c, m) for p, (_, c, m) in CADENCES.items()}
    # a weekly file that came on another day once, and again not
    m = manifest_of(file("h_weekly_report.csv", period="last_weekday"), file("h_odd_report.csv", period="last_weekday"))
    facts = facts_of(s1="# x")
    assert rows(pattern_findings(expectations.pattern_facts(m, facts), ("missing",)), "pattern") == [("odd_report.csv",), ("weekly_report.csv",)]
    assert rows(pattern_findings(expectations.pattern_facts(m, facts, cadence), ("missing",)), "pattern") == [("odd_report.csv",)]
    assert expectations.learnt_cadence(m.limit(0)).count() == 0


def test_bands_need_enough_days(spark):
    state = volume_state.state_of(spark.createDataFrame([(DAY, "1", "a", 5), (DAY - timedelta(days=7), "1", "a", 7)], VOLUMES))
    row = volume_state.bands_on(state, DAY + timedelta(days=7)).first()
    assert (row.n_days, row.lowest, row.highest, row.mean_volume, row.upper) == (2, 5, 7, None, None)
