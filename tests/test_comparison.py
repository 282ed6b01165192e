"""Extremes over matching baseline files, checked against all pairs formed by brute force."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest

from dqwatch.operators import near_names, comparison, history, issues, patterns
from dqwatch.schema import FINDINGS
from tests.conftest import DAY, file, rows
from tests.test_synthesis import finding

OPTIONS = [{}, {"broadcast_bytes": -1, "hot_rows": 5}]


@pytest.fixture(scope="module")
def files():
    rng = random.Random(7)
    out = []
    for i in range(120):
        entity = "Hot" if i % 3 == 0 else rng.choice("ABCDE")
        period = rng.choice(["today", "last_weekday"])
        out.append(
            file(
                rng.choice([f"h{i}_{entity}_report_2025_09_08.csv", f"daily_{entity}_report.csv"]),
                rng.choice([0, 0, 5, 50, 500, None]),
                hour=rng.randrange(24),
                period=period,
                source=rng.choice("12"),
                status=rng.choice(["processed", "empty", "failure"]),
            )
        )
    return out + [out[0]] * 10


@pytest.fixture(scope="module")
def manifest(manifest_of, files):
    return manifest_of(*files)


def split(files):
    return [f for f in files if f[1] == "today"], [f for f in files if f[1] == "last_weekday"]


def stem(name):
    tail = name.split("_", 1)[1]
    return tail.replace("_2025_09_08", "")


@pytest.mark.parametrize("options", OPTIONS)
def test_volume_files(manifest, files, options):
    today, last = split(files)
    ok = ("processed", "empty")
    want = []
    for t in today:
        base = [x[4] for x in last if x[2] == t[2] and stem(x[3]) == stem(t[3]) and x[5] in ok and (x[4] or 0) > 0]
        if t[5] in ok and base:
            pct = [None if t[4] is None else (t[4] - b) * 100.0 / b for b in base]
            want.append((t[2], t[3], len(base), min(pct) if t[4] is not None else None, max(pct) if t[4] is not None else None))
    got = comparison.volume_files(manifest, **options).select("source_id", "filename", "n_baseline", "pct_change_min", "pct_change_max").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and want


@pytest.mark.parametrize("options", OPTIONS)
def test_timing_files(manifest, files, options):
    today, last = split(files)
    want = []
    for t in today:
        base = [x[8] for x in last if x[2] == t[2] and stem(x[3]) == stem(t[3])]
        if base:
            hours = [(t[8] - b - timedelta(days=7)).total_seconds() / 3600 for b in base]
            want.append((t[2], t[3], len(base), min(hours), max(hours)))
    got = rows(comparison.timing_files(manifest, **options), "source_id", "filename", "n_baseline", "hour_difference_min", "hour_difference_max")
    assert got == sorted(want) and want


@pytest.mark.parametrize("options", OPTIONS)
def test_empty_files_both_ways(manifest, files, options):
    today, last = split(files)

    def same(x, y):
        return x[2] == y[2] and x[3] == y[3]

    want = [(t[2], t[3], sum(same(t, x) for x in last)) for t in today if t[4] == 0]
    assert rows(comparison.empty_with_baseline(manifest, **options), "source_id", "filename", "n_baseline") == sorted(want)
    want = []
    for x in last:
        matches = [t for t in today if same(t, x)]
        gone = [t for t in matches if not t[4]]
        if (x[4] or 0) > 10 and (not matches or gone):
            want.append((x[2], x[3], x[4], len(matches), len(gone)))
    got = comparison.filled_last_week_empty_today(manifest, **options)
    assert rows(got, "source_id", "filename", "lastweek_rows", "n_today", "n_today_empty") == sorted(want) and want


@pytest.mark.parametrize("options", OPTIONS)
def test_filename_compare(manifest, files, options):
    today, last = split(files)
    want = [
        (t[2], t[3], n)
        for t in today
        if (n := sum(t[2] == x[2] and t[3] == x[3] for x in last))
    ]
    assert rows(comparison.filename_compare(manifest, **options), "source_id", "filename", "n_baseline") == sorted(want)


def test_missing_patterns(manifest, files):
    today, last = split(files)
    gone = {(x[2], stem(x[3])) for x in last} - {(t[2], stem(t[3])) for t in today}
    assert set(rows(patterns.missing_patterns(manifest), "source_id", "pattern")) == gone


@pytest.mark.parametrize("options", OPTIONS)
def test_naming_duplicates_list_every_version(manifest_of, options):
    m = manifest_of(*[file(f"h{i}_a.csv") for i in range(4)], file("h0_a.csv"), file("h_b.csv"))
    got = rows(issues.naming_duplicates(m, **options), "base_name", "part", "n_files", "all_versions")
    assert got == [("a.csv", 0, 5, "h0_a.csv, h0_a.csv, h1_a.csv, h2_a.csv, h3_a.csv")]


def test_volume_bands_against_plain_statistics(manifest_of):
    import statistics

    volumes = [100, 120, 90, 110, 400, 105]
    m = manifest_of(*[file(f"h{i}_x.csv", v, day=DAY + timedelta(days=7 * i)) for i, v in enumerate(volumes)], file("h_x.csv", 7, day=DAY + timedelta(days=1)))
    got = {r.day: r for r in history.volume_bands(history.daily_volumes(m)).collect()}
    assert len(got) == 7
    unknown = [got[DAY + timedelta(days=7 * i)] for i in (0, 1, 2)] + [got[DAY + timedelta(days=1)]]
    assert [(r.n_days, r.mean_volume, r.lower, r.upper, r.outside) for r in unknown] == [(n, *(None,) * 4) for n in (0, 1, 2, 0)]
    assert (unknown[0].lowest, unknown[2].lowest, unknown[2].highest) == (None, 100, 120)
    for i in (3, 4, 5):
        row, earlier = got[DAY + timedelta(days=7 * i)], volumes[:i]
        assert row.n_days == i and (row.lowest, row.highest) == (min(earlier), max(earlier))
        mean, deviation = statistics.mean(earlier), statistics.stdev(earlier)
        assert row.upper == pytest.approx(mean + 1.96 * deviation) and row.lower == pytest.approx(mean - 1.96 * deviation)
    assert [got[d].outside for d in sorted(got) if got[d].n_days >= 3] == [False, True, False]


def test_recurrence_looks_seven_days_back(stored):
    days = [0, 1, 7, 8, 20]
    found = [(DAY + timedelta(days=d), *finding("a", "late", "late")[1:]) for d in days]
    got = rows(history.recurrence(stored(found * 2, FINDINGS)), "snapshot_day", "n_findings", "earlier_days", "is_recurring")
    assert [r[1:] for r in got] == [(2, 0, False), (2, 1, True), (2, 2, True), (2, 2, True), (2, 0, False)]


def test_names_one_edit_apart_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    names = {"", "a", "aa", "ab", "ba", "aab", "aéb", None} | {"".join(rng.choices("abé", k=rng.randrange(1, 7))) for _ in range(250)}
    table = [(DAY, s, n) for s in "12" for n in names if s == "1" or rng.random() < 0.3] + [(DAY, "1", "aa")] * 3

    def apart(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    want = []
    for s in "12":
        mine = {n for _, x, n in table if x == s and n is not None}
        for n in mine:
            near = [o for o in mine if apart(n, o)]
            if near:
                want.append((s, n, len(near), min(near, key=lambda x: x.encode())))
    got = near_names.near_names(spark.createDataFrame(table, "snapshot_day date, source_id string, pattern string"))
    assert rows(got, "source_id", "pattern", "n_near", "nearest") == sorted(want) and len(want) > 100


def test_near_names_are_not_broadcast(spark, stored):
    """Rows of patterns without a character are many times the stored names that Spark sizes them by."""
    names = ["aab", "ab", "aabb", "xab", "b", "", "é😀b", "é😀"]
    table = [(DAY, s, n) for s in ("1", None) for n in names]
    got = near_names.near_names(stored(table, "snapshot_day date, source_id string, pattern string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("Generate inline") == 1

    def one_edit(a, b):
        cut = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
        changed = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        return changed or a in cut(b) or b in cut(a)

    near = {n: sorted(m for m in names if one_edit(n, m)) for n in names}
    assert {(r.source_id, r.pattern, r.n_near, r.nearest) for r in got.collect()} == {
        ("1", n, len(m), m[0]) for n, m in near.items() if m
    }
