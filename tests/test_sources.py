"""Readers, writers and the SQL tools on small generated files."""

from __future__ import annotations

import json
import random
from datetime import date, datetime

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from dqwatch.operators.listings import today, with_status
from dqwatch.operators.summary import quality_rates, quality_summary, source_summary
from dqwatch.plans.analysis import analyze, run_report
from dqwatch.sources import cv_files, json_split, manifest_json, sinks
from dqwatch.sqlview import NO_ROWS, ManifestTools, preview
from tests.conftest import DAY, file, rows

TODAY = {
    "220504": [
        {"filename": "a.csv", "rows": 1200, "status": "processed", "is_duplicated": False, "file_size": 768, "uploaded_at": "2025-09-08T08:09:00+00:00", "status_message": None},
        {"filename": "b.csv", "rows": None, "uploaded_at": "2025-09-08T10:11:00-05:00"},
        {"filename": "c.csv", "uploaded_at": "not a time", "source_id": "override"},
        {"filename": "d.csv", "uploaded_at": "2025-09-08 08:00:00"},
    ],
    "220505": [],
}


@pytest.fixture
def landing(tmp_path):
    for day in ("2025-09-08_20_00_UTC", "2025-09-09_20_00_UTC"):
        folder = tmp_path / "landing" / day
        folder.mkdir(parents=True)
        (folder / "files.json").write_text(json.dumps(TODAY, indent=1))
        (folder / "files_last_weekday.json").write_text("{}" if day > "2025-09-09" else json.dumps({"9": [{"filename": "z.csv"}]}))
    return str(tmp_path / "landing")


def test_manifest_reader(spark, landing):
    one = manifest_json.read_manifest(spark, f"{landing}/2025-09-08_20_00_UTC", strict=True)
    got = {r.filename: r for r in one.collect()}
    assert set(got) == {"a.csv", "b.csv", "c.csv", "d.csv", "z.csv"}
    assert got["a.csv"].snapshot_day == date(2025, 9, 8) and got["a.csv"].from_period == "today"
    assert got["z.csv"].from_period == "last_weekday" and got["c.csv"].source_id == "override"
    stamps = dict(one.selectExpr("filename", "CAST(uploaded_at AS STRING)").collect())
    assert stamps["b.csv"] == "2025-09-08 15:11:00" and stamps["c.csv"] is None and stamps["d.csv"] == "2025-09-08 08:00:00"
    assert got["b.csv"].rows is None and got["b.csv"].status is None
    both = manifest_json.read_manifest(spark, f"{landing}/*")
    assert both.select("snapshot_day").distinct().count() == 2 and both.count() == 9
    assert manifest_json.source_slice(both, "override").count() == 2


def test_strict_reader_needs_both_documents(spark, tmp_path):
    folder = tmp_path / "2025-09-08"
    folder.mkdir()
    (folder / "files.json").write_text("{}")
    assert manifest_json.read_manifest(spark, str(folder)).count() == 0
    with pytest.raises(FileNotFoundError, match="files_last_weekday.json"):
        manifest_json.read_manifest(spark, str(folder), strict=True)


def test_reader_reports_what_it_cannot_read(spark, tmp_path):
    texts = {"2025-09-08": '{"1": [{"filename": "a", "rows": 1200.0, "file_size": "7"}]}', "2025-09-09": '{"1": [{"filena', "today": '{"1": []}'}
    for folder, text in texts.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "files.json").write_text(text)
        (tmp_path / folder / "files_last_weekday.json").write_text("{}")
    assert rows(manifest_json.read_manifest(spark, f"{tmp_path}/2025*"), "rows", "file_size") == [(1200, 7)]
    unread = rows(manifest_json.unread_documents(spark, f"{tmp_path}/*"), "path", "problem")
    assert [(p.split("/")[-2], why) for p, why in unread] == [("2025-09-09", "malformed"), ("today", "undated"), ("today", "undated")]
    cut = manifest_json.unread_elements(spark, f"{tmp_path}/*").first()
    assert (cut.source_id, cut.problem, cut.text, cut.position) == ("1", "document is cut off", '{"filena', 0)
    for folder in ("2025-09-09", "today"):
        with pytest.raises(ValueError, match="unreadable manifest|no date"):
            manifest_json.read_manifest(spark, f"{tmp_path}/{folder}", strict=True).collect()


def plain_elements(documents):
    """(document, source, file name) by Python's own reader."""
    return sorted((d, s, f.get("filename")) for d, text in documents.items() for s, files in json.loads(text).items() for f in files)


def odd_document(rng, n):
    odd = ['plain', 'a}b', 'x},{"y', '{', '],"9":[{"', 'back\\\\', 'quote"', 'é\n', ""]

    def one(i):
        made = {"filename": f"{i}{rng.choice(odd)}", "rows": i, "status_message": rng.choice(odd)}
        if rng.random() < 0.2:
            made["extra"] = rng.choice([{"a": {"b": 1}}, [{"a": 1}, {"b": [2, {"c": "}"}]}], [], {}])
        return made

    sources = [f"s{k}" for k in range(rng.randrange(1, 5))] + ['od}d"s']
    return json.dumps({s: [one(i) for i in range(rng.randrange(0, n))] for s in sources}, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


def test_split_documents_equal_the_plain_reader(spark):
    rng = random.Random(3)
    documents = {str(i): odd_document(rng, 12) for i in range(60)} | {"e": "{}", "n": '{"1": []}'}
    docs = spark.createDataFrame([*documents.items(), ("null", None)], "name string, value string")
    assert rows(manifest_json.flatten_documents(docs, "name", strict=True), "name", "source_id", "filename") == plain_elements(documents)
    assert manifest_json.unread_in_documents(docs, "name").count() == 0


@pytest.mark.parametrize("block", [64, 200, 5000])
def test_files_in_parts_equal_the_plain_reader(spark, tmp_path, block):
    rng, documents = random.Random(block), {}
    for i in range(3):
        folder = tmp_path / f"2025-09-0{i + 1}_22_30_UTC"
        folder.mkdir()
        documents[f"2025-09-0{i + 1}"] = json.dumps({"first": [{"filename": f"{k}.csv", "rows": k} for k in range(12 * i)], "next": [{"filename": "b}c"}], "e": []}, indent=i % 2 or None) + "\n" * i
        (folder / "files.json").write_text(documents[f"2025-09-0{i + 1}"], encoding="utf-8")
        (folder / "files_last_weekday.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        read = manifest_json.read_manifest(spark, f"{tmp_path}/*", strict=True)
        assert rows(read.selectExpr("CAST(snapshot_day AS STRING) AS d", "source_id", "filename"), "d", "source_id", "filename") == plain_elements(documents)
        assert {str(r.snapshot_at) for r in read.collect()} == {f"{d} 22:30:00" for d in documents}
        assert manifest_json.unread_elements(spark, f"{tmp_path}/*").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


BAD_ELEMENTS = {
    '{"filename": "b}': "unreadable",
    '{"filename": "b"': "unreadable",
    '{"filename": "b",}': "element is no JSON",
    '{filename: 7, "rows" 5}': "element is no JSON",
    "17": "element is no object",
    '"text"': "element is no object",
    "null": "element is no object",
}


@pytest.mark.parametrize(("bad", "block"), [(bad, 100_000) for bad in BAD_ELEMENTS] + [(bad, 50) for bad in list(BAD_ELEMENTS)[:3]])
def test_a_bad_element_costs_one_row(spark, tmp_path, bad, block):
    folder = tmp_path / "2025-09-08_20_00_UTC"
    folder.mkdir()
    (folder / "files.json").write_text(f'{{"1": [{{"filename": "a"}}, {bad}, {{"filename": "c"}}], "2": {{"filename": "d"}}, "3": [{{"filename": "e"}}], "4": null}}')
    (folder / "files_last_weekday.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        assert rows(manifest_json.read_manifest(spark, str(folder)), "source_id", "filename") == [("1", "a"), ("1", "c"), ("3", "e")]
        unread = rows(manifest_json.unread_elements(spark, str(folder)), "source_id", "problem")
        assert len(unread) == 3 and ("1", BAD_ELEMENTS[bad]) in unread
        if block > 50:  # a part that begins at a bad element may name it otherwise
            assert unread == sorted([("1", BAD_ELEMENTS[bad]), ("2", "source is no array"), ("4", "source is no array")])
            with pytest.raises(ValueError, match="unreadable manifest"):
                manifest_json.read_manifest(spark, str(folder), strict=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_report_tells_of_unread_elements(spark, docs_of, tmp_path):
    folder = tmp_path / "2025-09-08_20_00_UTC"
    folder.mkdir()
    (folder / "files.json").write_text('{"1": [{"filename": "h_a.csv", "rows": 5, "status": "processed"}, {"filename": "b}], "2": 7}')
    (folder / "files_last_weekday.json").write_text('{"1": [3]}')
    manifest, unread = manifest_json.read_manifest(spark, str(folder)), manifest_json.unread_elements(spark, str(folder))
    lines = [r.line for r in run_report(manifest, docs_of(s1="# x"), unread=unread).collect()]
    assert [x.partition(":")[2].partition(" →")[0].strip() for x in lines if "(id:" in x][0].endswith("1 file missing")
    assert sum("1 file missing" in x for x in lines) == 2 and not [x for x in lines if "[5] records" in x]


def test_combine_periods_fills_missing_columns(spark):
    a, b = spark.createDataFrame([("x", 1)], "filename string, rows long"), spark.createDataFrame([("y",)], "filename string")
    assert rows(manifest_json.combine_periods(a, b).fillna(0), "filename", "rows", "from_period") == [("x", 1, "today"), ("y", 0, "last_weekday")]


CVS = {
    "195385_native.md": "# _Settlement_Layout_2\nEntities: Clien_CBK,  WhiteLabel , \nArrives 08:08-08:18 UTC or 09:10–09:30 UTC\nusual ~17:20 UTC\nodd line",
    "7_native.md": "## \nusual Monday 40k-55k records and typical range 800k-900k",
    "8_native.md": "no heading\n95% confidence band: 50,211-869,600\nexpected volume >1000 records\nExpected coverage: D+3\nNot expected on: Saturday, Sunday",
    "9_native.md": "",
    "notes.md": "# Other",
}


@pytest.fixture
def cv_folder(tmp_path):
    folder = tmp_path / "cvs"
    folder.mkdir()
    for name, text in CVS.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_profiles(spark, cv_folder):
    docs = cv_files.read_cvs(spark, cv_folder)
    assert rows(docs, "source_id", "source_name") == [("195385", "Settlement_Layout_2"), ("7", "Source_7"), ("8", "Source_8"), ("9", "Source_9")]
    generic = cv_files.read_cvs(spark, cv_folder, extract_names=False)
    assert ("195385", "Source_195385") in rows(generic, "source_id", "source_name")
    facts = cv_files.cv_facts(docs)
    assert rows(cv_files.cv_windows(facts), "source_id", "start_min", "end_min") == [("195385", 488, 498), ("195385", 550, 570)]
    assert rows(cv_files.cv_usual_times(facts), "minute") == [(1040,)]
    assert rows(cv_files.cv_entities(facts), "entity") == [("Clien_CBK",), ("WhiteLabel",)]
    ranges = cv_files.cv_volume_ranges(facts).orderBy("kind").select("source_id", "kind", "dow", "lo", "hi").collect()
    assert [tuple(r) for r in ranges] == [
        ("8", "band", None, 50211, 869600),
        ("8", "minimum", None, 1000, None),
        ("7", "typical", None, 800000, 900000),
        ("7", "weekday", "Monday", 40000, 55000),
    ]
    assert rows(cv_files.cv_schedule(facts), "source_id", "not_expected_on") == [("8", "Saturday"), ("8", "Sunday")]
    assert [tuple(r) for r in cv_files.cv_exemptions(facts).collect()] == [("8", "coverage_lag", None, 3)]
    assert rows(cv_files.cv_unparsed(docs), "source_id", "line") == [("195385", "odd line")]
    assert rows(cv_files.first_sources(docs, 2), "source_id") == [("195385",), ("7",)]


def test_profile_folder_without_profiles(spark, tmp_path):
    (tmp_path / "x.md").write_text("# x")
    with pytest.raises(ValueError, match="No CV files"):
        cv_files.read_cvs(spark, str(tmp_path))


def test_missing_profiles(manifest_of, docs_of):
    m, docs = manifest_of(file("a", source="1"), file("b", source="2")), docs_of(s1="# x")
    assert rows(cv_files.missing_cvs(m, docs), "source_id") == [("2",)]
    with pytest.raises(FileNotFoundError, match="2"):
        cv_files.require_cvs(m, docs)
    cv_files.require_cvs(m.filter("source_id = '1'"), docs)


def test_written_tables_and_report(spark, manifest_of, docs_of, tmp_path):
    m = manifest_of(*[file(f"h_{s}.csv", 5, source=str(s), day=d) for s in range(40) for d in (DAY, date(2025, 9, 9))])
    sinks.write_manifest(m, str(tmp_path / "manifest"))
    again = spark.read.parquet(str(tmp_path / "manifest"))
    assert again.count() == m.count()
    plan = again.filter("snapshot_day = DATE'2025-09-08'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot_day" in plan
    analysis = analyze(again, docs_of(s1="# x"))
    sinks.write_findings(analysis.findings, str(tmp_path / "findings"))
    report = analysis.report("20:00")
    folder = tmp_path / "reports"
    paths = sinks.write_report(report, str(folder), "20_00_UTC")
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == [f"data_quality_report_2025-09-0{d}_20_00_UTC.md" for d in (8, 9)]
    lines = (folder / "data_quality_report_2025-09-08_20_00_UTC.md").read_text(encoding="utf-8").splitlines()
    want = report.filter("snapshot_day = DATE'2025-09-08'").orderBy("section", "position", "source_id")
    assert lines == [r.line for r in want.collect()] and len(lines) == 46 and len(paths) == 2
    with pytest.raises(FileExistsError, match="2 reports"):
        sinks.write_report(report, str(folder), "20_00_UTC")
    assert sinks.write_report(report.filter("section = 0"), str(folder), "20_00_UTC", overwrite=True) == paths
    assert (folder / "data_quality_report_2025-09-08_20_00_UTC.md").read_text(encoding="utf-8").count("\n") == 1
    failing = report.withColumn("line", F.when(F.col("source_id") == "7", F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_report(failing, str(tmp_path / "none"), "x")
    assert not [p for p in (tmp_path / "none").rglob("*") if p.is_file() and not p.name.startswith(".")]


def test_summaries_of_an_empty_day(manifest_of):
    m = today(manifest_of(file("a.csv"))).limit(0)
    assert source_summary(m).count() == 0
    row = quality_summary(m).first()
    assert (row.total_files, row.empty_files, row.total_rows) == (0, 0, None)
    assert tuple(quality_rates(quality_summary(m)).first()) == (None, None, None)


def test_source_summary_accepts_both_failure_words(manifest_of):
    m = manifest_of(file("a", status="failure"), file("b", status="failed"), file("c", None), file("d", status="empty"))
    row = source_summary(m).first()
    assert (row.total_files, row.total_rows, row.failed_files, row.processed_files, row.empty_files) == (4, 3000, 2, 1, 1)
    assert with_status(m, "failure", 5).count() == 1


@pytest.fixture
def tools(manifest_of, docs_of):
    tools = ManifestTools(manifest_of(file("a", 0), file("b", 5), file("a", 7, period="last_weekday")), docs_of(s1="# text"))
    yield tools
    tools.close()


def test_sql_tools(tools):
    assert tools.query_today("SELECT count(*) AS n FROM data;").first().n == 2
    joined = tools.query_today_and_last_weekday(
        """SELECT t.filename, t.rows - l.rows AS difference -- rows lost
           FROM (SELECT * FROM data WHERE from_period = 'today') t
           JOIN (SELECT * FROM data WHERE from_period = 'last_weekday') l ON t.filename = l.filename -- end"""
    )
    assert [tuple(r) for r in joined.collect()] == [("a", -7)]
    ordered = tools.query_today("WITH x AS (SELECT * FROM data) SELECT filename FROM x ORDER BY filename DESC")
    assert [r.filename for r in ordered.collect()] == ["b", "a"]
    assert tools.read_cv("1").first().text == "# text"
    assert "- Empty File Rate: 50.0%" in tools.quality_text()


@pytest.mark.parametrize("sql", ["DROP VIEW data", "CREATE VIEW x AS SELECT 1", "INSERT INTO data VALUES (1)", "SELECT 1) ; DROP VIEW data --"])
def test_sql_tools_refuse_everything_but_queries(tools, sql):
    with pytest.raises(ParseException):
        tools.query_today(sql)
    assert tools.query_today("SELECT * FROM data").count() == 2


def test_preview(spark):
    assert preview(spark.range(0)) == NO_ROWS
    assert preview(spark.range(2)).splitlines() == ["| id |", "| --- |", "| 0 |", "| 1 |"]
    text = preview(spark.range(105)).splitlines()
    assert text[0] == "Query returned 105 rows. Showing first 100:" and text[-1] == "... (5 more rows)" and len(text) == 106


def test_upload_times_are_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC" and datetime(2025, 9, 8).weekday() == 0


def test_elements_leave_in_bounded_batches(spark, monkeypatch):
    """Documents of one batch used to leave as one batch, however many elements they hold."""
    monkeypatch.setattr(json_split, "BATCH", 3)
    texts = ['{"1": [{"filename": "a"}, {"filename": "b"}], "2": [' + ", ".join(["{}"] * 7) + "]}", "", None, '{"3": [{"filename": "c"']
    docs = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    made = [list(json_split._elements_of(t or "")) for t in texts]
    assert [len(m) for m in made] == [9, 0, 0, 1]
    got = json_split.split_texts(docs).collect()
    assert sorted((r.source_key, r.n, r.element) for r in got) == sorted((e.source, n, e.text) for m in made for n, e in enumerate(m))
