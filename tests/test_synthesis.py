"""Severity table, consolidation, report text and the invariant that every source is present once."""

from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest

from dqwatch.plans.analysis import analyze, run_report, single_source_report
from dqwatch.plans.synthesis import (
    detail_texts,
    detector_severities,
    issue_counts,
    entity_issues,
    missing_names_text,
    ranked_findings,
    source_issues,
)
from dqwatch.schema import FINDINGS
from tests.conftest import DAY, file, rows


def finding(source, detector, kind, severity=1, name=None, pattern="p", entity=None, metric=None, baseline=None, error=None, message="m"):
    return (DAY, source, detector, kind, name, pattern, entity, metric, baseline, severity, error, message)


SEVERITY_CASES = {
    # source: findings, (detector, severity)
    "a": ([finding("a", "missing", "missing")], ("missing", 1)),
    "b": ([finding("b", "missing", "missing", pattern=p) for p in "xy"], ("missing", 2)),
    "c": ([finding("c", "duplicated_failed", "blocked_duplicate")], ("duplicated_failed", 1)),
    "d": ([finding("d", "duplicated_failed", "blocked_duplicate")] * 2, ("duplicated_failed", 2)),
    "e": ([finding("e", "duplicated_failed", "failure", error=e) for e in ("x", "y")], ("duplicated_failed", 1)),
    "f": ([finding("f", "duplicated_failed", "failure", error="x", pattern=p) for p in "xy"], ("duplicated_failed", 2)),
    "g": ([finding("g", "duplicated_failed", "duplicate", 0)] * 3, ("duplicated_failed", 0)),
    "h": ([finding("h", "empty", "unexpected_empty", baseline=1001.0)], ("empty", 1)),
    "i": ([finding("i", "empty", "unexpected_empty", baseline=1001.0)] * 2, ("empty", 2)),
    "j": ([finding("j", "empty", "unexpected_empty", baseline=1000.0)] * 2, ("empty", 1)),
    "k": ([finding("k", "empty", "unexpected_empty", 0, baseline=10.0)] * 2, ("empty", 0)),
    "l": ([finding("l", "volume", "volume_up", 2, metric=3.0, baseline=1.0)], ("volume", 2)),
    "m": ([finding("m", "volume", "volume_up", 1, metric=3.0, baseline=2.0)], ("volume", 1)),
    "n": ([finding("n", "late", "late", metric=9.0)] * 5, ("late", 1)),
    "o": ([finding("o", "late", "early", 0, metric=9.0)], ("late", 0)),
    "p": ([finding("p", "late", "early", 1, metric=9.0)], ("late", 1)),
    "q": ([finding("q", "previous", "recent_backfill", 0, metric=1.0)] * 9, ("previous", 0)),
    "r": ([finding("r", "missing", "missing"), finding("r", "late", "late", metric=5.0)], ("late", 0)),
    "s": ([finding("s", "duplicated_failed", "deleted")], ("duplicated_failed", 1)),
}


@pytest.fixture(scope="module")
def hand_made(stored):
    return stored([f for found, _ in SEVERITY_CASES.values() for f in found], FINDINGS)


def test_severity_table(hand_made, manifest_of):
    manifest = manifest_of(file("x.csv", 5, source="a"), file("y.csv", 7, source="z"))
    issues = source_issues(manifest, hand_made).persist()
    got = {(s, d): v for s, d, v in rows(detector_severities(issues), "source_id", "detector", "severity")}
    for source, (_, (detector, severity)) in SEVERITY_CASES.items():
        assert got[source, detector] == severity, source
    overall = dict(rows(issues, "source_id", "severity"))
    assert overall["z"] == 0 and len(overall) == len(SEVERITY_CASES) + 1
    assert all(overall[s] == max(v for (x, _), v in got.items() if x == s) for s in overall)
    assert dict(rows(issues, "source_id", "total_rows"))["z"] == 7


def test_missing_pattern_supersedes_late(hand_made):
    row = issue_counts(hand_made.filter("source_id = 'r'")).first()
    assert (row.n_missing, row.n_late, row.most_hours_late) == (1, 0, None)


def test_ranking_has_an_optional_limit_and_details_are_whole(stored):
    many = [finding("a", "volume", "volume_up", 1, pattern=str(i), metric=float(i), baseline=0.0, message=f"m{i:02d}") for i in range(30)]
    many.append(finding("a", "volume", "volume_up", 2, pattern="u", metric=1.0, baseline=0.0, message="urgent"))
    found = stored(many, FINDINGS)
    assert rows(ranked_findings(found, 3), "rank", "message") == [(1, "urgent"), (2, "m29"), (3, "m28")]
    assert ranked_findings(found).count() == 31
    text = detail_texts(found).first()
    assert text.volume_variation_details == "; ".join(["urgent", *[f"m{i:02d}" for i in reversed(range(30))]])
    assert text.missing_files_details is None


def gone(source, pattern, entity=None):
    return finding(source, "missing", "missing", pattern=pattern, entity=entity, message=f"missing — expected: *_{pattern}")


def test_missing_files_are_named(stored):
    names = [f"e{i:02d}" for i in range(40)]
    found = [gone("a", e, e) for e in [*reversed(names), "e00"]] + [gone("b", "x", "X"), gone("c", "y", "Y"), gone("c", "x")]
    found += [gone("d", p, p.upper() if p < "q" else None) for p in "pzoq"]
    assert rows(missing_names_text(stored(found, FINDINGS)), "source_id", "missing_names") == [
        ("a", "entities: " + ", ".join(names)),
        ("b", "expected: *_x"),
        ("c", "expected: *_x; *_y"),
        ("d", "entities: O, P; expected: *_q; *_z"),
    ]


def test_details_come_in_parts(stored):
    rng = random.Random(1)
    many = [finding("a", "volume", "volume_up", rng.choice([1, 2]), pattern=str(i), metric=rng.choice([5.0, 1e9, rng.random() * 100]), baseline=0.0, message=f"m{i}") for i in range(400)]
    many += [finding("b", "late", "late", metric=9.0, message=f"l{i}") for i in range(3)] + [finding("a", "empty", "unexpected_empty", message="e")]
    found = stored(many, FINDINGS)
    assert rows(detail_texts(found), "source_id", "part") == [("a", 0), ("b", 0)]
    for options in ({}, {"broadcast_bytes": -1, "hot_rows": 10}):
        parts = detail_texts(found, per_part=20, **options).filter("source_id = 'a'").orderBy("part").collect()
        listed = [p.volume_variation_details.split("; ") for p in parts]
        assert sorted(m for part in listed for m in part) == sorted(f"m{i}" for i in range(400)) and max(map(len, listed)) < 80
        assert parts[0].empty_file_details == "e" and parts[1].empty_file_details is None
        order = {m[11]: (m[9], int(math.log2(m[7] + 1) * 8)) for m in many if m[2] == "volume"}
        worst, best = [min(order[x] for x in part) for part in listed], [max(order[x] for x in part) for part in listed]
        assert all(w >= b for w, b in zip(worst, best[1:], strict=False)) and [p.part for p in parts] == list(range(len(parts)))


def test_findings_are_grouped_by_entity(stored):
    found = [
        gone("a", "p", "Shop"),
        finding("a", "late", "late", 1, name="f", pattern="p", entity="Shop", metric=9.0),
        finding("a", "late", "early", 0, name="g", pattern="q", entity="Shop", metric=9.0),
        finding("a", "volume", "volume_up", 2, pattern="q", entity="Shop", metric=2.0, baseline=1.0),
        finding("a", "duplicated_failed", "failure", 1, name="h", pattern="r"),
        finding("a", "duplicated_failed", "duplicate", 0, name="i", pattern="r"),
    ]
    got = rows(entity_issues(stored(found, FINDINGS)), "entity", "leading", "severity", "n_late", "clause")
    assert got == [("Shop", "missing", 2, 0, "Shop: 1 missing, 1 volume, 1 early"), ("r", "failed", 1, 0, "r: 1 failed, 1 duplicate")]


def delivered(hours, source="1", pattern="Shop"):
    return [file(f"h_{pattern}_report.csv", hour=h, source=source, day=DAY + timedelta(days=i)) for i, h in enumerate(hours) if h is not None]


def test_runs_and_shifts_of_upload_times(manifest_of, docs_of):
    m = manifest_of(
        *delivered([8.1, 8.2, 8.1, 13.0, 8.1, 13.0, 13.1, None, 13.2, 13.1]),
        *delivered([13.0, 13.0, 13.0, 13.1], source="2"),
        *delivered([8.0, 8.1, 8.1, 8.0, 1.0, 1.1, 1.0, 8.0], source="3"),
        *delivered([8.0, 12.5, 8.0, 8.0, 13.0, 12.6, 12.9], source="4"),
    )
    text = "# x\nArrives 08:00-08:20 UTC"
    with analyze(m, docs_of(s1=text, s2=text, s3=text, s4=text)) as a:
        runs = {(r.source_id, (r.snapshot_day - DAY).days): (r.direction, r.run_length, r.course) for r in a.timing_runs.collect()}
        lines = {(r.source_id, (r.snapshot_day - DAY).days): r for r in a.lines.collect()}
    assert {k: v for k, v in runs.items() if k[0] == "1"} == {
        ("1", 3): ("late", 1, "once"),
        ("1", 5): ("late", 1, "once"),
        ("1", 6): ("late", 2, "repeated"),
        ("1", 8): ("late", 3, "persistent"),  # day 3 was as late as these
        ("1", 9): ("late", 4, "persistent"),
    }
    assert [runs["2", i][2] for i in range(4)] == ["once", "repeated", "persistent", "persistent"]
    assert [runs["3", i] for i in (4, 5, 6)] == [("early", 1, "once"), ("early", 2, "repeated"), ("early", 3, "shifted")]
    assert runs["4", 1] == ("late", 1, "once") and runs["4", 6] == ("late", 3, "shifted")
    shifted = lines["3", 6]
    assert "upload time shifted by -421 minutes since 2025-09-12" in shifted.summary_line
    assert shifted.recommended_action == "Confirm intentional lag change; keep a short-term volume watch"
    assert lines["2", 3].recommended_action == "Validate downstream completed; track if persists"


@pytest.fixture(scope="module")
def day(manifest_of, docs_of):
    manifest = manifest_of(
        file("a_Shop_report_2025_09_08.csv", 1_233_496, source="10"),
        file("a_Shop_report_2025_09_01.csv", 1_200_000, source="10", period="last_weekday"),
        file("b_x.csv", 61_639, source="20"),
        file("c_Google_report_2025_09_01.csv", 5, source="30", period="last_weekday"),
        file("c_Shop_report_2025_09_01.csv", 5, source="30", period="last_weekday"),
        file("c_Market_report_2025_09_08.csv", 5, source="30"),
        file("d.csv", 9, source="40"),
    )
    docs = docs_of(
        s10="# _n\nEntities: Shop",
        s20="# n\nusual Monday 40k-55k records",
        s30="# n\nArrives 08:08-08:18 UTC",
        s50="# n\nEntities: Shop",
    )
    return manifest, docs


EXPECTED_REPORT = [
    "*Report generated at UTC HOUR*: 14:30 UTC",
    "* Urgent Action Required*",
    "• *Name_30 (id: 30)* – 2025-09-08: 2 files missing past 08:08–08:18 UTC window — expected: *_Google_report.csv; *_Shop_report.csv → *Action:* Notify provider to generate/re-send; re-run ingestion and verify completeness",
    "* Needs Attention*",
    "• *Name_20 (id: 20)* – 2025-09-08: Source volume 61,639 (> usual Monday 40,000–55,000) → *Action:* Confirm coverage/window; monitor next run",
    "* No Action Needed*",
    "• *Name_10 (id: 10)* – 2025-09-08: `[1,233,496] records`",
    "• *Source_40 (id: 40)* – 2025-09-08: `[9] records`",
    "• *Name_50 (id: 50)* – 2025-09-08: `[0] records`",
]


def test_report_text(day):
    assert [r.line for r in run_report(*day, as_of="14:30").collect()] == EXPECTED_REPORT
    unshared = run_report(*day, as_of="14:30", keep=False)
    assert [r.line for r in unshared.collect()] == EXPECTED_REPORT


def test_empty_sections_say_so(day):
    manifest, docs = day
    lines = [r.line for r in run_report(manifest.filter("source_id = '10'"), docs.filter("source_id = '10'")).collect()]
    assert lines[1:5] == [
        "* Urgent Action Required*",
        "• No issues required at this time.",
        "* Needs Attention*",
        "• No attention required at this time.",
    ]


def test_max_sources_takes_the_first_profiles(day):
    lines = [r.line for r in run_report(*day, max_sources=2).collect()]
    assert [line for line in lines if "(id:" in line] == [EXPECTED_REPORT[4], EXPECTED_REPORT[6]]


def test_single_source_report_record(day):
    row = single_source_report(*day, "30").first()
    assert (row.source_id, row.processing_date, row.criticality_level) == ("30", "2025-09-08", "URGENT ACTION REQUIRED")
    assert row.missing_files_details.count("expected: *_") == 2 and row.late_early_upload_details == ""
    assert row.total_records == "" and row.full_report.startswith("## Source: Name_30 (id: 30)\n**Date**: 2025-09-08")
    assert "### Recommended Action\nNotify provider" in row.full_report


def test_every_source_once_per_day(manifest_of, docs_of):
    files = [file(f"h_x{i}.csv", i, source=str(s), day=DAY + timedelta(days=i % 3)) for i in range(9) for s in range(i % 4)]
    analysis = analyze(manifest_of(*files), docs_of(s7="# n", s1="# n"))
    keys = rows(analysis.lines, "snapshot_day", "source_id")
    analysis.release()
    assert len(keys) == len(set(keys))
    delivered = {(f[0], f[2]) for f in files}
    days = {d for d, _ in delivered}
    assert set(keys) == delivered | {(d, s) for d in days for s in ("1", "7")}
