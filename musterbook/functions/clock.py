"""Punch texts, calendar parts and month windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def punch_parse(text: Column) -> Column:
    """Leading ``yyyy-MM-dd HH:mm:ss`` of a punch text as TIMESTAMP_NTZ.

    Anything after the first 19 characters is ignored, so a flattened list gives
    its first punch. The no-exit marker and other unreadable texts give NULL. The
    cast alone would also read shorter forms, so two separators are looked at
    first; that and the cast cost a fraction of a pattern or a format.
    """
    shaped = (F.substring(text, 11, 1) == " ") & (F.substring(text, 17, 1) == ":")
    return F.when(shaped, F.substring(text, 1, 19).try_cast("timestamp_ntz"))


def at_clock(date: Column, clock: str) -> Column:
    """The given clock time on a date, as TIMESTAMP_NTZ."""
    hours, minutes, seconds = (F.lit(int(part)) for part in clock.split(":"))
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours, minutes, seconds)


def clock_format(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm a")


def is_weekend(date: Column) -> Column:
    return F.dayofweek(date).isin(1, 7)


def epi_week(date: Column) -> Column:
    """US epidemiological week: starts on Sunday, belongs to the year of its Wednesday."""
    wednesday = F.date_add(date, 4 - F.dayofweek(date))
    return (F.floor((F.dayofyear(wednesday) - 1) / 7) + 1).cast("int")


def calendar_parts(date: Column) -> list[Column]:
    return [
        F.dayofweek(date).alias("wday"),
        F.day(date).alias("day"),
        F.month(date).alias("month"),
        F.year(date).alias("year"),
    ]


def window_end_of(month: Column, as_of: dt.date) -> Column:
    """Month end, or the day before ``as_of`` while the month is open."""
    return F.least(F.last_day(month), F.lit(as_of - dt.timedelta(days=1)))


def date_range(first: Column, last: Column) -> Column:
    """Array of the dates from ``first`` to ``last``; empty if reversed or a bound is NULL."""
    none = F.array().cast("array<date>")
    # The bounds are made safe inside the sequence too: it raises on a reversed range.
    return F.when(
        first <= last,
        F.sequence(F.least(first, last), F.greatest(first, last), F.expr("INTERVAL 1 DAY")),
    ).otherwise(none)


def window_dates(month: Column, as_of: dt.date) -> Column:
    return date_range(month, window_end_of(month, as_of))
