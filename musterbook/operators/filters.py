"""Selections. Date ranges stay half-open ranges on the bare column so that they
prune partitions and reach the Parquet scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterbook.model import ACTIVE, ALL_DIVISIONS, LEAVE_DAY_CODES, month_start, next_month


def date_filter(df: DataFrame, column: str, first: dt.date, until: dt.date) -> DataFrame:
    """Rows with ``first <= column < until``; stored months of the column are pruned and dropped."""
    rows = df.filter((F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(until)))
    months = f"{column}_month"
    if months not in df.columns:
        return rows
    return rows.filter((F.col(months) >= F.lit(month_start(first))) & (F.col(months) < F.lit(until))).drop(months)


def month_filter(df: DataFrame, column: str, month: dt.date | str) -> DataFrame:
    return date_filter(df, column, month_start(month), next_month(month))


def division_cat_filter(
    emp: DataFrame, division: str | list[str] | None = ALL_DIVISIONS, cat: str | None = None
) -> DataFrame:
    """Employees of one division, a list of divisions or all, and of one category or all."""
    if isinstance(division, str):
        if division != ALL_DIVISIONS:
            emp = emp.filter(F.col("division") == division)
    elif division is not None:
        emp = emp.filter(F.col("division").isin(division))
    return emp if cat is None else emp.filter(F.col("cat") == cat)


def employee_filter(df: DataFrame, emp_id: str | None) -> DataFrame:
    return df if emp_id is None else df.filter(F.col("emp_id") == emp_id)


def eligible_employees(emp: DataFrame, window_end: dt.date) -> DataFrame:
    """Employees who had joined by the last counted day."""
    return emp.filter(F.col("creation_date") <= F.lit(window_end))


def active_employees(emp: DataFrame) -> DataFrame:
    return emp.filter(F.col("active_status") == ACTIVE)


def leave_day_filter(records: DataFrame) -> DataFrame:
    return records.filter(F.col("attendance").isin(LEAVE_DAY_CODES)).select(
        "emp_id", "date", "attendance"
    )
