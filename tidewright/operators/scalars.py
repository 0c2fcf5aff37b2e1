"""Scalar expressions: calendars, New York clock, expiries, cuts, strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of_week(ts_ms: Column) -> Column:
    """0 (Monday, 00:00 UTC) to 167."""
    hours = F.floor(ts_ms / 3_600_000)
    return F.pmod(hours + 72, F.lit(168))


def nth_sunday(year: Column, month: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(6 - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def us_summer_time(date: Column) -> Column:
    """From the second Sunday of March to the day before the first Sunday of November."""
    y = F.year(date)
    return (date >= nth_sunday(y, 3, 2)) & (date < nth_sunday(y, 11, 1))


def new_york_slot(date: Column, hour: int, minute: int) -> Column:
    """Milliseconds UTC of a New York clock time on a date."""
    at = F.make_timestamp(F.year(date), F.month(date), F.day(date), F.lit(hour), F.lit(minute), F.lit(0))
    return F.unix_millis(F.to_utc_timestamp(at, "America/New_York"))


def last_friday(date: Column) -> Column:
    end = F.last_day(date)
    return F.date_sub(end, F.pmod(F.weekday(end) - 4, F.lit(7)))


def expiry_kind(date: Column) -> Column:
    """quarterly, monthly or weekly for Fridays; null for other days."""
    last = date == last_friday(date)
    return F.when(last & (F.pmod(F.month(date), F.lit(3)) == 0), "quarterly").when(last, "monthly").when(F.weekday(date) == 4, "weekly")


def cut(x: Column, edges: list[float]) -> Column:
    """Index of the interval (edge, next edge] that holds x; 0 at or below the first edge."""
    return F.when(x.isNull(), None).otherwise(sum((F.when(x > e, 1).otherwise(0) for e in edges[1:]), F.when(x > edges[0], 1).otherwise(0)))


def inverse_pnl(amount: Column, entry: Column, leave: Column) -> Column:
    """Profit in coin of an inverse contract of ``amount`` dollars."""
    return amount * (1 / entry - 1 / leave)
