"""Employee-days: each employee's window, the days in it, holidays and day codes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from musterbook.functions.clock import date_range, punch_parse
from musterbook.functions.status import day_code, entry_status, late_code
from musterbook.model import ACTIVE, MASTER_COLUMNS, Cutoffs, month_start, next_month, window_end
from musterbook.operators.filters import active_employees, eligible_employees
from musterbook.operators.lookups import distinct_holidays
from musterbook.operators.records import reduced_days


def holiday_dates(holidays: DataFrame) -> DataFrame:
    """Distinct holidays, marked for broadcast: at most one row per calendar day."""
    return F.broadcast(distinct_holidays(holidays))


def window_bounds(month: Column, last_day: Column, last_record: Column) -> tuple[Column, Column]:
    """First and last counted day of an employee; someone who left counts to the last record."""
    first = F.greatest(F.col("creation_date"), month)
    last = F.when(F.col("active_status") == ACTIVE, last_day).otherwise(last_record)
    return first, last


def employee_window(
    emp: DataFrame, records: DataFrame, month: dt.date | str, as_of: dt.date
) -> DataFrame:
    """``min_date`` and ``max_date`` of every employee who had joined.

    ``max_date`` is NULL for an inactive employee without a record.
    """
    last_day = window_end(month, as_of)
    last_record = records.groupBy("emp_id").agg(F.max("date").alias("last_record"))
    first, last = window_bounds(F.lit(month_start(month)), F.lit(last_day), F.col("last_record"))
    return (
        eligible_employees(emp, last_day)
        .join(last_record, "emp_id", "left")
        .select("emp_id", first.alias("min_date"), last.alias("max_date"))
    )


def employee_day_spine(records: DataFrame, window: DataFrame) -> DataFrame:
    """One row per employee-day of the window or with a record.

    The spine joins the records by union and grouping; being NULL in code and
    weakest in precedence, it never names a day that has a record.
    """
    spine = window.select(
        "emp_id",
        F.explode(date_range(F.col("min_date"), F.col("max_date"))).alias("date"),
        F.lit(None).cast("string").alias("attendance"),
        F.lit(9).alias("precedence"),
        F.lit(True).alias("in_window"),
    )
    known = records.select("emp_id", "date", "attendance", "precedence", F.lit(False).alias("in_window"))
    return reduced_days(known.unionByName(spine), in_window=(F.bool_or, F.col("in_window")))


def holidays_in_window(holidays: DataFrame, window: DataFrame) -> DataFrame:
    """Holidays inside each employee's window: the days of the window, looked up by date."""
    days = window.select(
        "emp_id", F.explode(date_range(F.col("min_date"), F.col("max_date"))).alias("date")
    )
    return days.join(holiday_dates(holidays).select("date"), "date").select("emp_id", "date")


def holiday_overlay(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Mark Sundays, and listed holidays that lie inside the employee's window."""
    listed = holiday_dates(holidays).withColumnRenamed("holiday", "listed")
    mark = F.when(F.dayofweek("date") == 1, "H").when(F.col("in_window"), F.col("listed"))
    return days.join(listed, "date", "left").withColumn("holiday", mark).drop("listed")


def day_attendance(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Final code of every day: record code, ``H`` or ``A``."""
    code = day_code(F.col("attendance"), F.col("holiday"))
    return holiday_overlay(days, holidays).withColumn("attendance", code).drop("holiday")


def late_override(days: DataFrame) -> DataFrame:
    """Present with a late entry becomes ``Late``; needs ``attendance`` and ``entry``."""
    return days.withColumn("attendance", late_code(F.col("attendance"), F.col("entry")))


def complete_days(days: Column, fields: list[StructField], wanted: Column) -> Column:
    """An array of day structs plus one of NULL fields for each wanted date not among them."""
    missing = F.array_except(wanted, F.transform(days, lambda d: d["date"]))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    return F.concat(days, F.transform(missing, lambda date: F.struct(date.alias("date"), *empty)))


def day_fields(days: DataFrame) -> list[StructField]:
    return [f for f in days.schema.fields if f.name not in ("emp_id", "date")]


def day_struct(fields: list[StructField]) -> Column:
    return F.struct("date", *[f.name for f in fields])


def employee_days(
    day_rows: DataFrame,
    emp: DataFrame,
    month: dt.date | str,
    as_of: dt.date,
    placeholders: str | None,
    without_master: bool = False,
) -> DataFrame:
    """All days of all employees of one month, with master attributes and ``in_window``.

    ``day_rows`` holds one row per employee-day, so an employee's month is a group
    of at most 31 rows. Grouped, it meets the master row, and the days without a
    record are filled in inside the row, without another exchange.

    ``placeholders`` adds employees without a record: ``active``, ``any`` or None.
    ``without_master`` keeps employees missing in the master, and those who joined
    after the window, with whatever records they have.
    """
    start, last_day = month_start(month), window_end(month, as_of)
    fields = day_fields(day_rows)
    months = day_rows.groupBy("emp_id").agg(
        F.collect_list(day_struct(fields)).alias("days"), F.max("date").alias("last_record")
    )
    master = emp.select("emp_id", *MASTER_COLUMNS, "creation_date", "active_status")
    if not without_master:
        master = eligible_employees(master, last_day)
        joined = master.join(months, "emp_id", "left" if placeholders else "inner")
    else:
        joined = master.join(months, "emp_id", "full" if placeholders else "right")
    recorded = F.col("days").isNotNull()
    if placeholders:
        added = F.col("creation_date") <= F.lit(last_day)
        if placeholders == "active":
            added &= F.col("active_status") == ACTIVE
        joined = joined.filter(recorded | added)

    # The placeholder is a record dated the month start, so it also ends a leaver's window.
    last_record = F.coalesce("last_record", F.lit(start))
    first, last = window_bounds(F.lit(start), F.lit(last_day), last_record)
    last = F.when(F.col("active_status").isNull(), F.lit(last_day)).otherwise(last)
    window = date_range(F.col("min_date"), F.col("max_date"))
    wanted = F.when(recorded, window).otherwise(F.array_union(F.array(F.lit(start)), window))
    day_type = months.schema["days"].dataType
    days = F.coalesce("days", F.array().cast(day_type))
    return (
        joined.select("*", first.alias("min_date"), last.alias("max_date"))
        .select(
            "emp_id",
            *MASTER_COLUMNS,
            "min_date",
            "max_date",
            F.inline(complete_days(days, fields, wanted)),
        )
        .withColumn(
            "in_window",
            F.coalesce(F.col("date").between(F.col("min_date"), F.col("max_date")), F.lit(False)),
        )
        .drop("min_date", "max_date")
    )


def summary_day_rows(records: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Code and entry status per employee-day, as far as the summary needs them.

    The first punch of a day is the earliest readable one, so two ``min``
    aggregates do; nothing is collected.
    """
    days = reduced_days(records, first_in=(F.min, punch_parse(F.col("in_time"))))
    entry = entry_status(F.col("first_in"), F.col("date"), cutoffs)
    return days.select("emp_id", "date", "attendance", entry.alias("entry"))


def no_record_calendar(
    emp: DataFrame,
    records: DataFrame,
    holidays: DataFrame,
    month: dt.date | str,
    as_of: dt.date,
) -> DataFrame:
    """Calendar of active employees without any record: every window day absent or holiday."""
    last_day = window_end(month, as_of)
    idle = active_employees(eligible_employees(emp, last_day)).join(
        records.select("emp_id").distinct(), "emp_id", "left_anti"
    )
    first, last = F.greatest("creation_date", F.lit(month_start(month))), F.lit(last_day)
    dates = F.array_union(F.array(F.lit(month_start(month))), date_range(first, last))
    days = idle.select(
        "emp_id",
        first.alias("min_date"),
        F.explode(dates).alias("date"),
        F.lit(None).cast("string").alias("attendance"),
    ).withColumn("in_window", F.col("date") >= F.col("min_date"))
    return day_attendance(days, holidays).select("emp_id", "date", "attendance")


def month_frame_join(days: DataFrame, month: dt.date | str) -> DataFrame:
    """Every day of the month for each employee in ``days``, other columns NULL where absent.

    ``days`` has one row per employee-day, so an employee's group is a month long.
    """
    fields = day_fields(days)
    first = month_start(month)
    last = next_month(month) - dt.timedelta(days=1)
    grouped = days.groupBy("emp_id").agg(F.collect_list(day_struct(fields)).alias("days"))
    wanted = date_range(F.lit(first), F.lit(last))
    return grouped.select("emp_id", F.inline(complete_days(F.col("days"), fields, wanted))).select(
        *days.columns
    )
