"""Jalali calendar on text days ``YYYY-MM-DD``: Column expressions, no UDF.

The calendar is the 33-year rule: year y is a leap year if (8*y + 29) mod 33 < 8.  It is contiguous over the years
supported here and agrees with 1404-01-01 = 2025-03-21.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1300, 1499
_SHIFT = 492268  # day number of 1970-01-01


def is_leap(year: int) -> bool:
    return (8 * year + 29) % 33 < 8


def day_pattern(first: int = FIRST_YEAR, last: int = LAST_YEAR) -> str:
    """A regular expression (no anchors) that matches exactly the days of the years ``first``..``last``."""
    years = "|".join(f"{century}[0-9]{{2}}" for century in range(first // 100, last // 100 + 1))
    if first % 100 or last % 100 != 99:
        years = "|".join(map(str, range(first, last + 1)))
    leap = "|".join(str(y) for y in range(first, last + 1) if is_leap(y))
    return (
        f"(?:(?:{years})-(?:0[1-6]-(?:0[1-9]|[12][0-9]|3[01])|(?:0[7-9]|1[01])-(?:0[1-9]|[12][0-9]|30)"
        f"|12-(?:0[1-9]|1[0-9]|2[0-9]))|(?:{leap})-12-30)"
    )


DAY = day_pattern()


def is_day(c: Column) -> Column:
    """True for a calendar day written in ASCII digits, false for anything else, null included."""
    return F.coalesce(c.rlike(rf"\A{DAY}\z"), F.lit(False))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("int")


def _year_start(y: Column) -> Column:
    """Days before year y: floor((12053*y - 12024) / 33), as 33 years have 12053 days."""
    return _div(12053 * y - 12024, 33)


def to_days(c: Column) -> Column:
    """Days since 1970-01-01 of a valid day; null for anything else."""
    y, m, d = (F.substring(c, at, n).cast("int") for at, n in ((1, 4), (6, 2), (9, 2)))
    before = F.when(m <= 7, 31 * (m - 1)).otherwise(186 + 30 * (m - 7))
    return F.when(is_day(c), (_year_start(y) + before + d - 1 - _SHIFT).cast("int"))


def from_days(n: Column) -> Column:
    """The inverse of :func:`to_days`; null for null."""
    at = n.cast("int") + _SHIFT
    y = _div(33 * at + 12056, 12053)
    doy = at - _year_start(y)
    late = doy >= 186
    m = F.when(late, _div(doy - 186, 30) + 7).otherwise(_div(doy, 31) + 1)
    d = F.when(late, (doy - 186) % 30 + 1).otherwise(doy % 31 + 1)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), two(m), F.lit("-"), two(d))


def next_day(c: Column) -> Column:
    return F.when(is_day(c), from_days(to_days(c) + 1))


def prev_day(c: Column) -> Column:
    return F.when(is_day(c), from_days(to_days(c) - 1))
