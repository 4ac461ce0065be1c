"""Schemas, fixed domain values and the parameters every job takes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

EMP_SCHEMA = (
    "emp_id STRING, emp_name STRING, designation STRING, division STRING, "
    "cat STRING, creation_date DATE, active_status STRING"
)
ATTEND_SCHEMA = (
    "emp_id STRING, log_date DATE, in_device_id STRING, in_location STRING, "
    "in_time STRING, out_device_id STRING, out_location STRING, out_time STRING"
)
LEAVE_SCHEMA = "emp_id STRING, date DATE, leave_type STRING"
# Partition column of stored leave: the first of the month of ``date``.
LEAVE_MONTH = "date_month"
HOLIDAY_SCHEMA = "hol_date DATE"

# Fixed values of the domain; results have to agree on them.
NO_EXIT_TEXT = "0000-00-00 00:00:00"
ACTIVE = "A"
ALL_DIVISIONS = "All"
CATEGORIES = ["Faculty", "Senior Resident", "Junior Resident", "Other"]
DESIGNATIONS = [
    "Professor",
    "Associate Professor",
    "Statistician",
    "Assistant Professor",
    "Senior Resident",
    "Junior Resident",
    "Tutor",
    "Other",
]
CODES = ["P", "Late", "A", "H", "RH", "CL", "EL", "SL", "ML", "O", "T"]
LEAVE_DAY_CODES = ["SL", "RH", "CL", "T", "O", "EL", "ML"]
LEAVE_LABELS = {
    "CL": "Casual Leave",
    "EL": "Earned Leave",
    "SL": "Special Leave",
    "ML": "Medical Leave",
    "RH": "Restricted Holiday",
    "O": "Other",
    "T": "Tour",
}

MASTER_COLUMNS = ["emp_name", "designation", "division"]
PUNCH_COLUMNS = [
    "in_device_id", "in_time", "in_location", "out_device_id", "out_time", "out_location",
]


@dataclass(frozen=True)
class Cutoffs:
    """Clock times that decide late entry and early exit."""

    entry: str = "09:20:59"
    exit_weekday: str = "04:45:00"
    exit_weekend: str = "12:45:00"


@dataclass(frozen=True)
class Tables:
    """The four inputs, typed as in the schemas above."""

    emp: DataFrame
    attend: DataFrame
    leave: DataFrame
    holidays: DataFrame


def month_start(month: dt.date | str) -> dt.date:
    """First day of a month given as a date or as ``YYYY-MM[-DD]``."""
    if isinstance(month, str):
        year, number = month.split("-")[:2]
        return dt.date(int(year), int(number), 1)
    return month.replace(day=1)


def next_month(month: dt.date | str) -> dt.date:
    start = month_start(month)
    return (start + dt.timedelta(days=32)).replace(day=1)


def window_end(month: dt.date | str, as_of: dt.date) -> dt.date:
    """Last day counted for a month: its end, or yesterday while it is still open."""
    return min(next_month(month) - dt.timedelta(days=1), as_of - dt.timedelta(days=1))
