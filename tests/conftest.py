from __future__ import annotations

import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dqwatch.schema import CV_DOCS, MANIFEST  # noqa: E402
from dqwatch.session import local_session  # noqa: E402
from dqwatch.sources.cv_files import cv_facts  # noqa: E402

DAY = date(2025, 9, 8)  # a Monday


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "dqwatch-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(hour: float, day: date = DAY) -> datetime:
    return datetime.combine(day, datetime.min.time()) + timedelta(hours=hour)


def file(name, rows=1000, hour=8.0, period="today", source="1", status="processed", dup=False, message=None, day=DAY):
    """One manifest row; ``last_weekday`` rows are uploaded a week before the snapshot day."""
    uploaded = at(hour, day - timedelta(days=7) if period == "last_weekday" else day) if hour is not None else None
    return (day, period, source, name, rows, status, dup, None if rows is None else rows * 64, uploaded, message)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """A small table as Parquet, so that its size is known as it is for real inputs."""

    def store(rows, schema):
        path = str(tmp_path_factory.mktemp("table") / "t")
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return store


@pytest.fixture(scope="session")
def manifest_of(stored):
    return lambda *rows: stored(rows, MANIFEST)


@pytest.fixture(scope="session")
def docs_of(stored):
    """``s<source_id>=text`` pairs as profile table."""
    return lambda **texts: stored([(k[1:], f"Name_{k[1:]}", v) for k, v in texts.items()], CV_DOCS)


@pytest.fixture(scope="session")
def facts_of(docs_of):
    return lambda **texts: cv_facts(docs_of(**texts))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
