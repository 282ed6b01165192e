"""Filename functions: base patterns, entities and file dates, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Filename regular expressions.
HASH_PREFIX = r"^[^_]+_"
# the tail is taken along and put back, so that only the first date goes
UNDERSCORE_DATE_AND_TAIL = r"(?s)_\d{4}_\d{2}_\d{2}(.*)"
ANY_DATE_AND_TAIL = r"(?s)_?(?:\d{4}_\d{2}_\d{2}|\d{4}-\d{2}-\d{2}|\d{8})(.*)"
ENTITY_BEFORE_KEYWORD = r"_([A-Za-z0-9]+)_(?:payments|report|accounting)"
ENTITY_BEFORE_DATE_OR_KEYWORD = r"([A-Za-z_]+)(?:_\d{4}_\d{2}_\d{2}|payments|report)"
ENTITY_BEFORE_DATE = r"([A-Za-z0-9_]+)(?:_\d{4}_\d{2}_\d{2})"
FILE_DATES = [
    (r"(\d{4}_\d{2}_\d{2})", "yyyy_MM_dd"),
    (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"(\d{8})", "yyyyMMdd"),
]
EXPECTED_NAME_PREFIX = r"^(?:\[hash\]|\*)_"
EXPECTED_NAME_DATE = r"(?s)_?(?:YYYY_MM_DD|YYYY-MM-DD|YYYYMMDD)(.*)"


def strip_hash(name: Column) -> Column:
    """Drop everything up to the first underscore; a name that starts with one is left alone."""
    return F.regexp_replace(name, HASH_PREFIX, "")


def base_pattern(name: Column) -> Column:
    """Name without hash prefix and without its first ``_YYYY_MM_DD``."""
    return F.regexp_replace(strip_hash(name), UNDERSCORE_DATE_AND_TAIL, "$1")


def normalized_pattern(name: Column) -> Column:
    """Name without hash prefix and without its first date, in any of the three date forms."""
    return F.regexp_replace(strip_hash(name), ANY_DATE_AND_TAIL, "$1")


def entity_e1(name: Column) -> Column:
    return F.regexp_extract(name, ENTITY_BEFORE_KEYWORD, 1)


def entity_e2(name: Column) -> Column:
    return F.regexp_extract(name, ENTITY_BEFORE_DATE_OR_KEYWORD, 1)


def entity_e3(name: Column) -> Column:
    return F.regexp_extract(name, ENTITY_BEFORE_DATE, 1)


def known_entity(name: Column, entities: Column) -> Column:
    """Longest of the documented entities that the name contains, NULL when there is none."""
    hits = F.filter(entities, lambda e: F.contains(name, e))
    ranked = F.transform(hits, lambda e: F.struct(F.length(e).alias("n"), e.alias("e")))
    return F.array_max(ranked)["e"]


def entity_of(pattern: Column, entities: Column) -> Column:
    """Documented entity if the pattern contains one, else the token before the report keyword.

    The pattern has lost the separator after the hash, which the token expression asks for.
    """
    token = entity_e1(F.concat(F.lit("_"), pattern))
    return F.coalesce(known_entity(pattern, entities), F.nullif(token, F.lit("")))


def file_date(name: Column) -> Column:
    """First date in the filename that parses, trying the three forms in order."""
    return F.coalesce(
        *[F.try_to_date(F.nullif(F.regexp_extract(name, rx, 1), F.lit("")), fmt) for rx, fmt in FILE_DATES]
    )


def days_old(day: Column, name_date: Column) -> Column:
    return F.datediff(day, name_date)


def expected_pattern(expected_name: Column) -> Column:
    """Normalised pattern of a documented name such as ``[hash]_Shop_report_YYYY_MM_DD.csv``."""
    bare = F.regexp_replace(expected_name, EXPECTED_NAME_PREFIX, "")
    return F.regexp_replace(bare, EXPECTED_NAME_DATE, "$1")


def expected_filename(expected_name: Column, day: Column) -> Column:
    """Documented name for one day: the date filled in and ``*`` for the hash."""
    dated = expected_name
    for mark, fmt in [("YYYY_MM_DD", "yyyy_MM_dd"), ("YYYY-MM-DD", "yyyy-MM-dd"), ("YYYYMMDD", "yyyyMMdd")]:
        dated = F.replace(dated, F.lit(mark), F.date_format(day, fmt))
    return F.regexp_replace(dated, EXPECTED_NAME_PREFIX, "*_")


def error_text(message: Column) -> Column:
    """Error message reduced to its shape, so that equal failures with other numbers agree."""
    return F.regexp_replace(F.lower(message), "[0-9]+", "#")


def has_error_indicator(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("error|fail|mismatch|invalid|exception|denied"), F.lit(False))
