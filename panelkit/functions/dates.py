"""Dates, gaps in days, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_col

MICROS_PER_DAY = 86_400_000_000.0


def parse_date(c: ColumnLike, pattern: str = "dd.MM.yyyy") -> Column:
    """Date by format; an impossible or empty text gives NULL."""
    return F.try_to_date(as_col(c), pattern)


def micros(c: ColumnLike) -> Column:
    return F.unix_micros(as_col(c).cast("timestamp"))


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Fractional days."""
    return (micros(later) - micros(earlier)) / F.lit(MICROS_PER_DAY)


def years_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Whole years, rounded half to even."""
    return F.bround(days_between(later, earlier) / F.lit(365.25)).cast("int")


def age_later(age_then: ColumnLike, later: ColumnLike, earlier: ColumnLike) -> Column:
    return as_col(age_then) + years_between(later, earlier)


def semesters_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Whole half-years elapsed, rounded down."""
    return F.floor(days_between(later, earlier) / F.lit(365.0) * F.lit(2.0)).cast("int")
