"""Counts over classified employee-days, tallies and the calendar grid."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterbook.functions.clock import epi_week
from musterbook.functions.status import designation_rank, position
from musterbook.functions.text import emp_id_pad, leave_type_label
from musterbook.model import CODES, LEAVE_LABELS, MASTER_COLUMNS, month_start, next_month

GRID_FIELDS = ["attendance", "day", "time", "in_time", "out_time", "in_location", "out_location"]


def status_counts(days: DataFrame) -> DataFrame:
    return days.groupBy("emp_id", *MASTER_COLUMNS, "attendance").agg(F.count(F.lit(1)).alias("n"))


def status_pivot(days: DataFrame, other_codes: bool = False) -> DataFrame:
    """One column per listed code and ``other`` for the rest, 0 where a code is missing.

    ``other_codes`` adds the unlisted codes by name, as a map from code to days. An employee is counted
    per unlisted code first (listed days share one row), so no list of days is held and no pivot
    has to look for the codes beforehand.
    """
    code, key = F.col("attendance"), ["emp_id", *MASTER_COLUMNS]
    is_unlisted = position(code, CODES).isNull()
    counted = [*[F.count_if(code == c).alias(c) for c in CODES], F.count_if(is_unlisted).alias("other")]
    if not other_codes:
        return days.groupBy(*key).agg(*counted)
    by_code = days.groupBy(*key, F.when(is_unlisted, code).alias("unlisted")).agg(*counted)
    named = F.collect_list(F.when(F.col("unlisted").isNotNull(), F.struct("unlisted", "other")))
    return by_code.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in [*CODES, "other"]], F.map_from_entries(F.array_sort(named)).alias("other_codes")
    )


def day_totals(days: DataFrame) -> DataFrame:
    return days.groupBy("emp_id").agg(
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(F.col("attendance") != "A").alias("present_days"),
    )


def absence_flag(summary: DataFrame) -> DataFrame:
    return summary.select(
        "emp_id", (F.col("present_days") != F.col("total_days")).alias("has_absence")
    )


def empty_code_columns(summary: DataFrame) -> DataFrame:
    """Total of each count column and whether a view shows it (``A`` always)."""
    columns = [*CODES, "other", "present_days", "total_days"]
    totals = summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    long = totals.unpivot([], columns, "code", "total")
    return long.withColumn("shown", (F.col("total") != 0) | (F.col("code") == "A"))


def summary_ordered(summary: DataFrame) -> DataFrame:
    """By division, designation level (unknown last) and employee."""
    ranked = summary.withColumn("designation_rank", designation_rank(F.col("designation")))
    return ranked.orderBy("division", F.col("designation_rank").asc_nulls_last(), "emp_id")


def time_status_footer(calendar: DataFrame) -> DataFrame:
    """Days per time status of each employee, with the text shown for it."""
    counted = (
        calendar.filter(F.col("time").isNotNull())
        .groupBy("emp_id", "time")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.withColumn(
        "label", F.concat(F.lit("**"), F.col("n").cast("string"), F.lit("** days "), "time")
    )


def time_status_text(calendar: DataFrame) -> DataFrame:
    """The footer's texts joined per employee, by status name (six at most)."""
    parts = F.array_sort(F.collect_list(F.struct("time", "label")))
    return (
        time_status_footer(calendar)
        .groupBy("emp_id")
        .agg(F.array_join(F.transform(parts, lambda p: p["label"]), ", ").alias("footer"))
    )


def leave_tally_long(leave: DataFrame, emp_id: str | None = None) -> DataFrame:
    """Leave days per employee, year and type name, over all years."""
    if emp_id is not None:
        leave = leave.filter(F.col("emp_id") == emp_id_pad(F.lit(emp_id)))
    labelled = leave.select(
        "emp_id", F.year("date").alias("year"), leave_type_label(F.col("leave_type")).alias("label")
    )
    return labelled.groupBy("emp_id", "year", "label").agg(F.count(F.lit(1)).alias("n"))


def leave_tally(leave: DataFrame, emp_id: str | None = None) -> DataFrame:
    """One column per type; a year that holds only unknown types stays as a row of zeros."""
    if emp_id is not None:
        leave = leave.filter(F.col("emp_id") == emp_id_pad(F.lit(emp_id)))
    counted = [
        F.count_if(F.col("leave_type") == code).alias(label) for code, label in LEAVE_LABELS.items()
    ]
    return (
        leave.groupBy("emp_id", F.year("date").alias("year"))
        .agg(*counted)
        .orderBy("emp_id", F.desc("year"))
    )


def calendar_grid(calendar: DataFrame, month: dt.date | str) -> DataFrame:
    """One row per employee and week, seven values for each weekday (Sunday = 1).

    An employee's month becomes one map from date to day, read once per cell, so days
    that are not in the calendar still have their place. Weeks are told apart by
    their Sunday: the last days of December stay last whatever their week number.
    """
    first, last = month_start(month), next_month(month) - dt.timedelta(days=1)
    sunday = first - dt.timedelta(days=first.isoweekday() % 7)
    sundays = [F.lit(sunday + dt.timedelta(days=n)) for n in range(0, (last - sunday).days + 1, 7)]
    shown = F.struct(*[f for f in GRID_FIELDS if f != "day"])
    months = calendar.groupBy("emp_id").agg(
        F.map_from_entries(F.collect_list(F.struct("date", shown))).alias("days")
    )
    weeks = months.select("emp_id", "days", F.explode(F.array(*sundays)).alias("week_start"))
    dates = {k: F.date_add("week_start", k - 1) for k in range(1, 8)}
    cells = weeks.select(
        "emp_id",
        "week_start",
        epi_week(F.greatest("week_start", F.lit(first))).alias("week"),
        *[F.try_element_at("days", date).alias(f"cell_{k}") for k, date in dates.items()],
    )

    def value(field: str, k: int):
        if field == "day":
            return F.when(dates[k].between(F.lit(first), F.lit(last)), F.day(dates[k]))
        return F.col(f"cell_{k}")[field]

    return cells.select(
        "emp_id",
        "week_start",
        "week",
        *[value(field, k).alias(f"{field}_{k}") for field in GRID_FIELDS for k in dates],
    )
