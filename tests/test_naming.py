from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from dqwatch.functions import naming
from dqwatch.functions.numbers import clock, pct_change, rate, records_text, tenths_text

NAMES = [
    # name, literal pattern, normalised pattern, date
    ("abc123_Clien_CBK_payments_2025_09_07.csv", "Clien_CBK_payments.csv", "Clien_CBK_payments.csv", date(2025, 9, 7)),
    ("ab12__BR_3DS_report_2025_09_08.csv", "_BR_3DS_report.csv", "_BR_3DS_report.csv", date(2025, 9, 8)),
    ("_Shop_report_2025-09-08.csv", "_Shop_report_2025-09-08.csv", "_Shop_report.csv", date(2025, 9, 8)),
    ("h_Shop_20250908.csv", "Shop_20250908.csv", "Shop.csv", date(2025, 9, 8)),
    ("plain.csv", "plain.csv", "plain.csv", None),
    ("h_a_2025_09_08_to_2025_09_09.csv", "a_to_2025_09_09.csv", "a_to_2025_09_09.csv", date(2025, 9, 8)),
    ("h_a_2025_13_40_20250908.csv", "a_20250908.csv", "a_20250908.csv", date(2025, 9, 8)),
    ("h_a_99999999.csv", "a_99999999.csv", "a.csv", None),
    ("", "", "", None),
]


def test_patterns_and_dates(spark):
    df = spark.createDataFrame([(n,) for n, *_ in NAMES], "n string")
    n = F.col("n")
    got = {r[0]: tuple(r)[1:] for r in df.select("n", naming.base_pattern(n), naming.normalized_pattern(n), naming.file_date(n)).collect()}
    assert got == {name: (literal, normal, day) for name, literal, normal, day in NAMES}


@pytest.mark.parametrize(
    "name, e1, e2, e3",
    [
        ("h_Shop_payments_2025_09_07.csv", "Shop", "h_Shop_", "h_Shop_payments"),
        ("h_BR_3DS_payments_accounting_report_2025_09_07.csv", "3DS", "DS_payments_accounting_", "h_BR_3DS_payments_accounting_report"),
        ("plain.csv", "", "", ""),
    ],
)
def test_entities(spark, name, e1, e2, e3):
    n = F.lit(name)
    row = spark.range(1).select(naming.entity_e1(n), naming.entity_e2(n), naming.entity_e3(n)).first()
    assert row[0] == e1 and row[2] == e3
    assert row[1].startswith(e2) if e2 else row[1] == ""


def test_longest_known_entity_wins(spark):
    known = F.array(F.lit("Clien"), F.lit("Clien_CBK"), F.lit("Shop"))
    row = spark.range(1).select(
        naming.known_entity(F.lit("x_Clien_CBK_report.csv"), known),
        naming.known_entity(F.lit("nothing.csv"), known),
        naming.entity_of(F.lit("h_Market_report.csv"), known),
        naming.entity_of(F.lit("h_Market_report.csv"), F.lit(None).cast("array<string>")),
    ).first()
    assert tuple(row) == ("Clien_CBK", None, "Market", "Market")


def test_expected_names(spark):
    name = F.lit("[hash]_Shop_report_YYYY_MM_DD.csv")
    row = spark.range(1).select(
        naming.expected_pattern(name), naming.expected_filename(name, F.lit(date(2025, 9, 7)))
    ).first()
    assert tuple(row) == ("Shop_report.csv", "*_Shop_report_2025_09_07.csv")


def test_error_text(spark):
    row = spark.range(1).select(
        naming.error_text(F.lit("Column 12 Mismatch at row 345")),
        naming.has_error_indicator(F.lit("Schema MISMATCH")),
        naming.has_error_indicator(F.lit("ok")),
        naming.has_error_indicator(F.lit(None).cast("string")),
    ).first()
    assert tuple(row) == ("column # mismatch at row #", True, False, False)


def test_numbers(spark):
    row = spark.range(1).select(
        pct_change(F.lit(150), F.lit(100)),
        pct_change(F.lit(5), F.lit(0)),
        rate(F.lit(1), F.lit(0)),
        records_text(F.lit(1233496)),
        tenths_text(F.lit(425), 100),
        tenths_text(F.lit(424), 100),
        clock(F.lit(488)),
        clock(F.lit(None).cast("int")),
    ).first()
    assert tuple(row) == (50.0, None, None, "`[1,233,496] records`", "4.3", "4.2", "08:08", None)
