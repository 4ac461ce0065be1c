"""Joins with the employee master.

Which side is broadcast is left to Catalyst, which compares its size estimate
with ``spark.sql.autoBroadcastJoinThreshold``; beyond it the joins shuffle on the
key and adaptive execution splits a hot employee's partition. Nothing here forces
a side whose size grows with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterbook.model import MASTER_COLUMNS
from musterbook.operators.filters import (
    active_employees,
    date_filter,
    division_cat_filter,
    employee_filter,
)

MASTER_DETAILS = ["emp_id", *MASTER_COLUMNS, "cat"]


def dedup_columns(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """Join that keeps the first column of each name, so the key is the left one."""
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{on}") == F.col(f"r.{on}"), how)
    extra = [F.col(f"r.{c}") for c in right.columns if c not in left.columns]
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], *extra)


def emp_join(fact: DataFrame, emp: DataFrame, how: str = "inner") -> DataFrame:
    """Fact rows with master attributes: ``inner`` when employees are chosen by division
    or category, ``left`` when they are chosen by the fact's own id."""
    return fact.join(emp.select(*MASTER_DETAILS), "emp_id", how)


def full_outer_raw(fact: DataFrame, emp: DataFrame) -> DataFrame:
    """Unfiltered full outer join; ``emp_id`` is the fact's, NULL on master-only rows.

    Written as left join plus the master rows nobody refers to: a full outer join
    can not be split at a hot employee, its two parts can.
    """
    matched = emp_join(fact, emp, "left")
    unused = emp.select(*MASTER_DETAILS).join(
        fact.select("emp_id").distinct(), "emp_id", "left_anti"
    )
    return matched.unionByName(
        unused.withColumn("emp_id", F.lit(None).cast("string")), allowMissingColumns=True
    )


def fact_details(
    fact: DataFrame,
    date_column: str,
    emp: DataFrame,
    divisions: list[str] | None,
    cat: str,
    first: dt.date,
    until: dt.date,
) -> DataFrame:
    chosen = division_cat_filter(emp, divisions, cat)
    return emp_join(date_filter(fact, date_column, first, until), chosen)


def attend_details(attend, emp, divisions, cat, first, until) -> DataFrame:
    """Punches of one category in a list of divisions (None for all) and a date range."""
    return fact_details(attend, "log_date", emp, divisions, cat, first, until)


def leave_details(leave, emp, divisions, cat, first, until) -> DataFrame:
    return fact_details(leave, "date", emp, divisions, cat, first, until)


def employee_attend_details(attend, emp, first, until, emp_id=None) -> DataFrame:
    """Punches of one employee (or of each), kept without a master row too."""
    own = employee_filter(date_filter(attend, "log_date", first, until), emp_id)
    return emp_join(own, emp, "left")


def employee_leave_details(leave, emp, first, until, emp_id=None) -> DataFrame:
    own = employee_filter(date_filter(leave, "date", first, until), emp_id)
    return emp_join(own, emp, "left")


def employees_without_records(
    emp: DataFrame, records: DataFrame, active_only: bool = True
) -> DataFrame:
    """Master rows whose employee has no record."""
    candidates = active_employees(emp) if active_only else emp
    return candidates.join(records.select("emp_id").distinct(), "emp_id", "left_anti").select(
        "emp_id", *MASTER_COLUMNS
    )
