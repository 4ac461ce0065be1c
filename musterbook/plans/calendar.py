"""Personal calendar: one row per day of the month, for one employee or for all."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterbook.functions.clock import clock_format, punch_parse
from musterbook.functions.status import entry_status, exit_status, time_status
from musterbook.functions.text import blank_to_null
from musterbook.model import MASTER_COLUMNS, Cutoffs, Tables
from musterbook.operators.days import day_attendance, employee_days
from musterbook.operators.filters import employee_filter, month_filter
from musterbook.operators.records import collapsed_days, first_punches, unified_records


def timed_days(collapsed: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Entry, exit and time status of collapsed days, read off their flattened texts."""
    return with_status(collapsed, punch_parse(F.col("in_time")), F.col("out_time"), cutoffs)


def timed_punches(days: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """The same of days that hold their first entry and exit, without any list."""
    return with_status(days, F.col("in_ts"), F.col("out_text"), cutoffs)


def with_status(days: DataFrame, in_ts: Column, out_text: Column, cutoffs: Cutoffs) -> DataFrame:
    entry = entry_status(in_ts, F.col("date"), cutoffs)
    exit_ = exit_status(out_text, F.col("date"), cutoffs)
    timed = days.withColumns({"entry": entry, "exit": exit_})
    return timed.withColumn("time", time_status(F.col("attendance"), F.col("entry"), F.col("exit")))


def employee_calendar(
    tables: Tables,
    month: dt.date | str,
    as_of: dt.date,
    emp_id: str | None = None,
    leave_first: bool = True,
    cutoffs: Cutoffs = Cutoffs(),
    places: bool = True,
) -> DataFrame:
    """Attendance, time status, clock times and places per employee-day.

    Without ``places`` no list is built: code, status and clock times follow from the first punch.
    """
    records = unified_records(
        employee_filter(month_filter(tables.leave, "date", month), emp_id),
        employee_filter(month_filter(tables.attend, "log_date", month), emp_id),
        leave_first,
    )
    collapsed = collapsed_days(records) if places else first_punches(records)
    shown = [blank_to_null(F.col(c)).alias(c) for c in ("in_location", "out_location") if places]
    timed = timed_punches(collapsed, cutoffs).select(
        "emp_id",
        "date",
        "attendance",
        "time",
        clock_format(F.col("in_ts")).alias("in_time"),
        clock_format(punch_parse(F.col("out_text"))).alias("out_time"),
        *shown,
    )
    master = employee_filter(tables.emp, emp_id)
    days = employee_days(timed, master, month, as_of, placeholders="active", without_master=True)
    return day_attendance(days, tables.holidays).select(
        "emp_id",
        *MASTER_COLUMNS,
        "date",
        "attendance",
        F.when(F.col("attendance") == "P", F.col("time")).alias("time"),
        *(["in_time", "in_location", "out_time", "out_location"] if places else ["in_time", "out_time"]),
    )
