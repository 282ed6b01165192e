"""Differences, rates and number texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HUNDRED = 100.0
MICROS_PER_HOUR = 3_600_000_000


def pct_change(now: Column, before: Column) -> Column:
    """Percent change, unrounded; NULL when the baseline is zero."""
    return (now - before) * F.lit(HUNDRED) / F.nullif(before, F.lit(0))


def abs_difference(now: Column, before: Column) -> Column:
    return F.abs(now - before)


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours from ``earlier`` to ``later``, unrounded and negative when ``later`` comes first."""
    return micros_between(later, earlier) / F.lit(float(MICROS_PER_HOUR))


def rate(part: Column, whole: Column) -> Column:
    """Percentage, NULL for an empty whole."""
    return F.try_divide(part * F.lit(HUNDRED), whole)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def records_text(n: Column) -> Column:
    return F.concat(F.lit("`["), thousands(n), F.lit("] records`"))


def int_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def tenths_text(numerator: Column, denominator: Column | int) -> Column:
    """``numerator / denominator`` to one decimal, rounded half up in integer arithmetic."""
    tenths = int_div(numerator * 20 + denominator, denominator * 2)
    return F.concat(thousands(int_div(tenths, 10)), F.lit("."), (tenths % 10).cast("string"))


def clock(minutes: Column) -> Column:
    """Minutes since midnight as ``HH:MM``; negative ones lie on the evening before."""
    of_day = F.pmod(minutes, F.lit(24 * 60))
    hour, minute = int_div(of_day, 60), of_day % 60
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))


def calendar_context(day: Column) -> dict[str, Column]:
    """Weekday name, weekend flag and month-end flag of a day."""
    return {
        "weekday": F.date_format(day, "EEEE"),
        "is_weekend": F.dayofweek(day).isin(1, 7),
        "is_month_end": day == F.last_day(day),
    }
