"""Selector lists and other small reads of one table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterbook.functions.status import position
from musterbook.model import ALL_DIVISIONS, CATEGORIES
from musterbook.operators.filters import active_employees, employee_filter


def employee_lookup(
    emp: DataFrame,
    emp_id: str | None = None,
    columns: list[str] | None = None,
    active_only: bool = False,
    short_id: bool = False,
) -> DataFrame:
    """Master rows, of one id if given; ``short_id`` takes it without its leading zeros."""
    if short_id and emp_id is not None:
        emp_id = emp_id.rjust(8, "0")
    chosen = employee_filter(active_employees(emp) if active_only else emp, emp_id)
    return chosen.select(*(columns or emp.columns))


def distinct_values(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    order = F.col(column).asc() if ascending else F.col(column).desc()
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(order)


def distinct_divisions(emp: DataFrame) -> DataFrame:
    """``All`` first, then the divisions by name."""
    named = emp.select(F.lit(1).alias("ord"), "division").filter("division IS NOT NULL").distinct()
    everything = emp.sparkSession.range(1).select(
        F.lit(0).alias("ord"), F.lit(ALL_DIVISIONS).alias("division")
    )
    return everything.union(named).orderBy("ord", "division")


def category_choices(emp: DataFrame) -> DataFrame:
    """Listed categories that occur, in the fixed order."""
    return (
        emp.select("cat")
        .distinct()
        .select(position(F.col("cat"), CATEGORIES).alias("ord"), "cat")
        .filter("ord IS NOT NULL")
        .orderBy("ord")
    )


def distinct_holidays(holidays: DataFrame) -> DataFrame:
    return (
        distinct_values(holidays, "hol_date")
        .withColumnRenamed("hol_date", "date")
        .withColumn("holiday", F.lit("H"))
    )


def last_log_date(attend: DataFrame) -> DataFrame:
    return attend.agg(F.max("log_date").alias("last_date"))


def days_stale(attend: DataFrame, as_of: dt.date) -> DataFrame:
    """Days between the newest punch and yesterday, and whether a refresh is offered."""
    stale = F.datediff(F.lit(as_of - dt.timedelta(days=1)), "last_date")
    return last_log_date(attend).select(
        "last_date", stale.alias("days_stale"), (stale > 0).alias("refresh_offered")
    )
