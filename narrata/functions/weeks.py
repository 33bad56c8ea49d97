"""The five week conventions, as column expressions over dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def monday_start(day: Column) -> Column:
    """The Monday on or before a day."""
    return F.date_trunc("WEEK", day).cast("date")


def sunday_end(day: Column) -> Column:
    """The Sunday on or after a day: bins are right-closed and named by their end."""
    return F.date_add(monday_start(day), 6)


def after_monday(day: Column) -> Column:
    """Bins (Monday, next Monday], named by the first Monday: a Monday belongs to the bin before."""
    return monday_start(F.date_sub(day, 1))


def own_block(day: Column, first: Column) -> Column:
    """Number of the 7-day block since a series' own first day."""
    return F.floor(F.date_diff(day, first) / 7).cast("int")


def frontier_bucket(day: Column, frontier: Column) -> Column:
    """Number of the 7-day bucket counted back from the frontier."""
    return F.floor(F.date_diff(frontier, day) / 7).cast("int")


def first_weekday(year: Column, month: Column, weekday: str) -> Column:
    """First given weekday (Mon..Sun) of a month."""
    return F.next_day(F.date_sub(F.make_date(year, month, F.lit(1)), 1), weekday)


def last_weekday(year: Column, month: Column, weekday: str) -> Column:
    """Last given weekday of a month."""
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, month, F.lit(1))), 7), weekday)
