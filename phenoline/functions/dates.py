"""Date and time column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def parse_day_month(text: str, separator: str = ":") -> tuple[int, int]:
    """``"01:08"`` -> ``(1, 8)``, that is day 1 of month 8; checks both ranges."""
    day, month = (int(part) for part in text.split(separator))
    return check_start(day, month)


def check_start(day: int, month: int) -> tuple[int, int]:
    if not 1 <= month <= 12:
        raise ValueError(f"start month must be between 1 and 12, got {month}")
    if not 1 <= day <= 31:
        raise ValueError(f"start day must be between 1 and 31, got {day}")
    return day, month


def lenient_date(text, fmt: str = "yyyy-M-d") -> Column:
    """Text to date; anything that is not a date becomes null."""
    return F.try_to_date(F.col(text) if isinstance(text, str) else text, fmt)


def strict_date(text, fmt: str = "yyyy-M-d") -> Column:
    """Text to date; bad text fails the query (ANSI mode)."""
    return F.to_date(F.col(text) if isinstance(text, str) else text, fmt)


def season_start(year, day: int, month: int) -> Column:
    """First day of the season that ends in ``year``; an impossible date fails the query."""
    return F.make_date(year - F.lit(1), F.lit(month), F.lit(day))


def season_year(date: Column, day: int, month: int) -> Column:
    """Year of the season a day belongs to, with seasons running from (day, month) to the day before it."""
    late = F.month(date) * 100 + F.dayofmonth(date) >= month * 100 + day
    return F.year(date) + late.cast("int")


def whole_days(start: Column, end: Column) -> Column:
    """Calendar days from start to end."""
    return F.date_diff(end, start)


def floored_days(start: Column, end: Column) -> Column:
    """Days from start to end rounded toward minus infinity, so minus six hours is -1.

    Clock times are compared as they are written; the session's time zone and its changes of the clock don't enter.
    """
    gap = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    toward_zero = F.extract(F.lit("DAY"), gap)
    return toward_zero - (gap < F.make_dt_interval(toward_zero)).cast("int")


def add_days(date: Column, days: Column) -> Column:
    return F.date_add(date, days)


def add_fractional_days(moment: Column, days: Column) -> Column:
    """Timestamp plus a fractional number of days, to the microsecond."""
    seconds = (days * F.lit(86400.0)).cast("decimal(18,6)")
    zero = F.lit(0)
    return moment.cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def day_of_year(date: Column) -> Column:
    return F.dayofyear(date)


def daily_axis(start: Column, end: Column) -> Column:
    """Array of all days from start to end inclusive; empty if end is before start."""
    axis = F.sequence(start, end, F.expr("interval 1 day"))
    return F.when(end >= start, axis).otherwise(F.array().cast("array<date>"))
