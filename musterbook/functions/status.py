"""Classification rules as column expressions (first match wins, NULL never matches)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from musterbook.functions.clock import at_clock, is_weekend, punch_parse
from musterbook.model import CODES, DESIGNATIONS, LEAVE_DAY_CODES, NO_EXIT_TEXT, Cutoffs


def is_late(in_ts: Column, date: Column, cutoffs: Cutoffs) -> Column:
    return in_ts > at_clock(date, cutoffs.entry)


def entry_status(in_ts: Column, date: Column, cutoffs: Cutoffs) -> Column:
    late = is_late(in_ts, date, cutoffs)
    return F.when(late, "Late entry").when(~late, "On time entry")


def exit_status(out_text: Column, date: Column, cutoffs: Cutoffs) -> Column:
    """Only the marker alone means that nobody left; an unreadable text stays unknown."""
    cut = F.when(is_weekend(date), at_clock(date, cutoffs.exit_weekend)).otherwise(
        at_clock(date, cutoffs.exit_weekday)
    )
    early = punch_parse(out_text) < cut
    return (
        F.when(out_text == NO_EXIT_TEXT, "No exit")
        .when(early, "Early exit")
        .when(~early, "On time exit")
    )


def time_status(attendance: Column, entry: Column, exit_: Column) -> Column:
    """Only a code other than ``P`` clears the status; a day without a code keeps that of its punch."""
    late = entry == "Late entry"
    return F.when(
        F.coalesce(attendance == "P", F.lit(True)) & entry.isNotNull(),
        F.when(exit_ == "On time exit", F.when(late, "Late entry").otherwise("On time"))
        .when(exit_ == "Early exit", F.when(late, "Late entry & early exit").otherwise("Early exit"))
        .when(exit_ == "No exit", F.when(late, "Late entry & No exit").otherwise("No exit")),
    )


def day_code(attendance: Column, holiday: Column) -> Column:
    """Code of a day: earned leave outranks a holiday, a holiday everything else."""
    return (
        F.when(attendance == "EL", "EL")
        .when(holiday == "H", "H")
        .otherwise(F.coalesce(attendance, F.lit("A")))
    )


def late_code(attendance: Column, entry: Column) -> Column:
    return F.when((attendance == "P") & (entry == "Late entry"), "Late").otherwise(attendance)


def cell_class(attendance: Column, time: Column) -> Column:
    """Class behind the colour of a calendar cell, strongest rule first."""
    return (
        F.when(attendance.isin(LEAVE_DAY_CODES), "leave")
        .when(attendance == "A", "absent")
        .when(time != "On time", "irregular")
        .when(attendance == "H", "holiday")
        .when(attendance == "P", "present")
    )


def position(value: Column, listed: list[str]) -> Column:
    """1-based place of a value in a fixed list, NULL if it is not listed."""
    place = F.array_position(F.array(*map(F.lit, listed)), value)
    return F.nullif(place, F.lit(0)).cast("int")


def designation_rank(designation: Column) -> Column:
    return position(designation, DESIGNATIONS)


def code_order(attendance: Column) -> Column:
    """Sort key between codes of equal precedence: listed codes first, in list order."""
    return F.when(
        attendance.isNotNull(), F.coalesce(position(attendance, CODES), F.lit(len(CODES) + 1))
    ).otherwise(F.lit(len(CODES) + 2))
