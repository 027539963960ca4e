"""Date expressions. Timestamps carry no zone, so results do not depend on the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import collapse_blanks

STAMP = r"^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})$"


def parse_timestamp(c: Column) -> Column:
    """`2010-01-01 00:07:00`; other shapes and impossible dates become null.

    The text is used once in the expression, so a filter on the result does not clean it twice.
    """
    return F.regexp_extract(collapse_blanks(c), STAMP, 1).try_cast("timestamp_ntz")


def month_label(c: Column) -> Column:
    return F.date_format(F.to_date(c), "yyyy-MM")


def weekday_name(c: Column) -> Column:
    return F.date_format(F.to_date(c), "EEEE")


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def midnight(day: Column) -> Column:
    """The first instant of a date."""
    return day.cast("timestamp_ntz")


def next_midnight(day: Column) -> Column:
    return F.date_add(day, 1).cast("timestamp_ntz")


def days_in_month(c: Column) -> Column:
    return F.day(F.last_day(c))


def days_remaining(c: Column) -> Column:
    return days_in_month(c) - F.day(c)
