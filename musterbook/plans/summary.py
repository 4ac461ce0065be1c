"""Monthly summary: code counts per employee, for one month or all of them.

A month has at most 31 days, so "the days on which ..." fits into one BIGINT.
Grouping leave rows and punches by employee and month reduces them to such day
sets with ``bit_or``: fixed-width buffers, hash aggregation inside code
generation, combined on the map side before the only exchange of the facts. A hot
employee or employee-day therefore arrives as one short row per task. The window,
Sundays, holidays and precedence are set operations on those numbers and the
counts are ``bit_count``; no day is ever exploded.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterbook.functions.clock import punch_parse, window_end_of
from musterbook.functions.status import is_late, position
from musterbook.model import (
    ACTIVE,
    ALL_DIVISIONS,
    CODES,
    MASTER_COLUMNS,
    Cutoffs,
    Tables,
    month_start,
    next_month,
)
from musterbook.operators.counts import summary_ordered
from musterbook.operators.days import (
    day_attendance,
    employee_days,
    late_override,
    summary_day_rows,
)
from musterbook.operators.filters import date_filter, division_cat_filter, month_filter
from musterbook.operators.records import unified_records

COUNT_COLUMNS = [*CODES, "other", "present_days", "total_days"]
LEAVE_SETS = [f"leave_{c}" for c in [*CODES, "other", "missing"]]
SET_COLUMNS = [*LEAVE_SETS, "punched", "punctual", "late"]
EVERY_SEVENTH_DAY = sum(1 << day for day in range(0, 31, 7))


def day_bit(date: str) -> str:
    return f"shiftleft(1L, day({date}) - 1)"


def days_where(condition: str, name: str) -> Column:
    return F.expr(f"bit_or(CASE WHEN {condition} THEN {day_bit('date')} END) AS {name}")


def by_employee_month(rows: DataFrame, sets: list[Column]) -> DataFrame:
    month = F.trunc("date", "MM").alias("month")
    return rows.groupBy("emp_id", month).agg(*sets, F.max("date").alias("last_record"))


def punch_sets(attend: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Per employee and month: the days with punches, with punctual and with late entries."""
    rows = attend.select(
        "emp_id",
        F.col("log_date").alias("date"),
        is_late(punch_parse(F.col("in_time")), F.col("log_date"), cutoffs).alias("is_late"),
    )
    sets = {"punched": "TRUE", "punctual": "NOT is_late", "late": "is_late"}
    return by_employee_month(rows, [days_where(condition, name) for name, condition in sets.items()])


def leave_sets(leave: DataFrame) -> DataFrame:
    """Per employee and month: the days of each leave code, of unlisted codes and of rows without one."""
    kind = F.coalesce(
        position(F.col("leave_type"), CODES),
        F.when(F.col("leave_type").isNull(), len(LEAVE_SETS)).otherwise(len(LEAVE_SETS) - 1),
    ).alias("kind")
    rows = leave.select("emp_id", "date", kind)
    sets = [days_where(f"kind = {i}", name) for i, name in enumerate(LEAVE_SETS, start=1)]
    return by_employee_month(rows, sets)


def day_sets(leave: DataFrame, attend: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Both kinds of sets in one row per employee and month, with the last recorded date.

    Leave and punches are reduced apart, each in one pass from scan to partial
    aggregate; what meets here is one row per employee, month and kind.
    """
    both = punch_sets(attend, cutoffs).unionByName(leave_sets(leave), allowMissingColumns=True)
    return united_sets(both)


def united_sets(sets: DataFrame) -> DataFrame:
    """One row per employee and month: the union of the day sets of several."""
    merged = [F.bit_or(name).alias(name) for name in SET_COLUMNS]
    return sets.groupBy("emp_id", "month").agg(*merged, F.max("last_record").alias("last_record"))


def unlisted_sets(leave: DataFrame) -> DataFrame:
    """Per employee and month the days of each unlisted leave code, in the order of the codes.

    A code is reduced to its day set first; what is listed is one entry per different code.
    """
    unlisted = leave.filter(position(F.col("leave_type"), CODES).isNull() & F.col("leave_type").isNotNull())
    month = F.trunc("date", "MM").alias("month")
    by_code = unlisted.groupBy("emp_id", month, F.col("leave_type").alias("code")).agg(days_where("TRUE", "days"))
    listed = F.array_sort(F.collect_list(F.struct("code", "days")))
    return by_code.groupBy("emp_id", "month").agg(listed.alias("unlisted"))


def named_counts() -> Column:
    """Map from unlisted code to its days: of the days that ``other`` names, each goes to its first code."""
    entry = "named_struct('code', u.code, 'n', CAST(bit_count(u.days & acc.left) AS BIGINT))"
    folded = (
        "aggregate(coalesce(unlisted, CAST(array() AS ARRAY<STRUCT<code: STRING, days: BIGINT>>)), "
        "named_struct('left', is_other & ~off, 'found', CAST(array() AS ARRAY<STRUCT<code: STRING, n: BIGINT>>)), "
        f"(acc, u) -> named_struct('left', acc.left & ~u.days, 'found', concat(acc.found, array({entry}))), "
        "acc -> filter(acc.found, f -> f.n > 0))"
    )
    return F.expr(f"map_from_entries({folded}) AS other_codes")


def holiday_sets(holidays: DataFrame) -> DataFrame:
    """Listed holidays per month as a day set; one row per calendar month, so broadcast."""
    listed = F.expr(f"bit_or({day_bit('hol_date')}) AS listed")
    return F.broadcast(holidays.groupBy(F.trunc("hol_date", "MM").alias("month")).agg(listed))


def first_named(leave_first: bool) -> list[str]:
    """Days each code names: of a day's records the first counts, leave codes in list
    order, with the punches before or after them."""
    taken = "0L" if leave_first else "punched"
    named = {}
    for code in [*CODES, "other", "missing"]:
        named[code] = f"leave_{code} & ~({taken})"
        taken = f"{taken} | leave_{code}"
    named["P"] += f" | punched & ~({taken})" if leave_first else " | punched"
    return [f"{days} AS is_{code}" for code, days in named.items()]


def count_codes(
    months: DataFrame, holidays: DataFrame, as_of: dt.date, leave_first: bool
) -> DataFrame:
    """Turn day sets joined to the master into one count per code.

    With a column ``unlisted`` the codes outside the list are counted by name too.

    Records outside the window count too; the window only adds days without one. An
    employee without any record has a placeholder on the first of the month.
    """
    yesterday = as_of - dt.timedelta(days=1)
    bounded = (
        months.na.fill(0, SET_COLUMNS)
        .join(holiday_sets(holidays), "month", "left")
        .selectExpr(
            "*",
            "greatest(creation_date, month) AS min_date",
            f"CASE WHEN active_status = '{ACTIVE}' THEN least(last_day(month), DATE '{yesterday}') "
            "ELSE coalesce(last_record, month) END AS max_date",
            " | ".join(SET_COLUMNS[:-2]) + " AS recorded",
        )
    )
    sets = bounded.selectExpr(
        "*",
        *first_named(leave_first),
        "late & ~punctual AS late_days",
        f"CASE WHEN min_date <= max_date THEN (shiftleft(1L, day(max_date)) - 1) & ~({day_bit('min_date')} - 1) "
        "ELSE 0L END AS window",
        f"shiftleft({EVERY_SEVENTH_DAY}L, pmod(8 - dayofweek(month), 7)) AS sundays",
    )
    marked = sets.selectExpr(
        "*",
        "recorded | window | CASE WHEN recorded = 0 THEN 1L ELSE 0L END AS days",
        "(sundays | window & coalesce(listed, 0L)) & ~is_EL AS marked",
    ).selectExpr("*", "marked & days AS off")
    final = {code: f"is_{code} & ~off" for code in [*CODES, "other"]}
    final |= {
        "P": "is_P & ~off & ~late_days",
        "Late": "(is_Late | is_P & late_days) & ~off",
        # A record without a code counts as absence.
        "A": "(is_A | is_missing | days & ~recorded) & ~off",
        "H": "is_H | off",
        "EL": "is_EL",
    }
    counted = marked.selectExpr(
        "month",
        "emp_id",
        *MASTER_COLUMNS,
        "cat",
        *[f"CAST(bit_count({days}) AS BIGINT) AS {code}" for code, days in final.items()],
        "CAST(bit_count(days) AS BIGINT) AS total_days",
        *(["unlisted", "is_other", "off"] if "unlisted" in months.columns else []),
    )
    if "unlisted" in months.columns:
        counted = counted.withColumn("other_codes", named_counts()).drop("unlisted", "is_other", "off")
    return counted.withColumn("present_days", F.col("total_days") - F.col("A"))


def _summary(
    holidays: DataFrame,
    chosen: DataFrame,
    leave: DataFrame,
    attend: DataFrame,
    months: Column,
    as_of: dt.date,
    leave_first: bool,
    placeholders: str | None,
    cutoffs: Cutoffs,
    other_codes: bool,
) -> DataFrame:
    # Facts are reduced first and meet the chosen employees then: one plan at every size.
    sets = day_sets(leave, attend, cutoffs)
    if other_codes:
        sets = sets.join(unlisted_sets(leave), ["emp_id", "month"], "left")
    return _summary_of_sets(holidays, chosen, sets, months, as_of, leave_first, placeholders)


def _summary_of_sets(
    holidays: DataFrame,
    chosen: DataFrame,
    sets: DataFrame,
    months: Column,
    as_of: dt.date,
    leave_first: bool,
    placeholders: str | None,
) -> DataFrame:
    master = chosen.select("emp_id", *MASTER_COLUMNS, "cat", "creation_date", "active_status")
    if placeholders:
        master = master.select("*", F.explode(months).alias("month"))
        joined = master.join(sets, ["emp_id", "month"], "left")
        if placeholders == "active":
            joined = joined.filter(
                F.col("last_record").isNotNull() | (F.col("active_status") == ACTIVE)
            )
    else:
        joined = master.join(sets, "emp_id", "inner")
    eligible = joined.filter(F.col("creation_date") <= window_end_of(F.col("month"), as_of))
    return count_codes(eligible, holidays, as_of, leave_first)


def default_placeholders(division: str | None) -> str | None:
    """Employees without a record are listed unless ``All`` divisions are asked for at once."""
    return None if division == ALL_DIVISIONS else "active"


def monthly_summary(
    tables: Tables,
    month: dt.date | str,
    as_of: dt.date,
    division: str | None = ALL_DIVISIONS,
    cat: str | None = None,
    leave_first: bool = True,
    placeholders: str | None = "default",
    cutoffs: Cutoffs = Cutoffs(),
    other_codes: bool = False,
) -> DataFrame:
    """One row per employee of a division and category (None: each of them in turn).

    ``other_codes`` adds a map with the days of every unlisted code, which ``other`` adds up.
    """
    if placeholders == "default":
        placeholders = default_placeholders(division)
    start = month_start(month)
    return _summary(
        month_filter(tables.holidays, "hol_date", month),
        division_cat_filter(tables.emp, division, cat),
        month_filter(tables.leave, "date", month),
        month_filter(tables.attend, "log_date", month),
        F.array(F.lit(start)),
        as_of,
        leave_first,
        placeholders,
        cutoffs,
        other_codes,
    ).select("emp_id", *MASTER_COLUMNS, *COUNT_COLUMNS, *(["other_codes"] if other_codes else []))


def summary_all_months(
    tables: Tables,
    as_of: dt.date,
    first_month: dt.date | str,
    leave_first: bool = True,
    placeholders: str | None = None,
    cutoffs: Cutoffs = Cutoffs(),
    other_codes: bool = False,
) -> DataFrame:
    """The summary of every month from ``first_month`` to yesterday's, all divisions and categories, in one job.

    Without placeholders it holds the employees with a record in the month, as the
    choice ``All`` does; with them, also those without.
    """
    first, months = _months_until(as_of, first_month)
    last = month_start(as_of - dt.timedelta(days=1))
    return _summary(
        date_filter(tables.holidays, "hol_date", first, next_month(last)),
        tables.emp,
        date_filter(tables.leave, "date", first, next_month(last)),
        date_filter(tables.attend, "log_date", first, next_month(last)),
        months,
        as_of,
        leave_first,
        placeholders,
        cutoffs,
        other_codes,
    ).select("month", "emp_id", *MASTER_COLUMNS, "cat", *COUNT_COLUMNS, *(["other_codes"] if other_codes else []))


def summary_from_sets(
    sets: DataFrame,
    emp: DataFrame,
    holidays: DataFrame,
    as_of: dt.date,
    first_month: dt.date | str,
    leave_first: bool = True,
    placeholders: str | None = None,
) -> DataFrame:
    """``summary_all_months`` from kept day sets (``sources.day_sets``) instead of the whole history."""
    first, months = _months_until(as_of, first_month)
    last = month_start(as_of - dt.timedelta(days=1))
    counted = _summary_of_sets(
        date_filter(holidays, "hol_date", first, next_month(last)),
        emp,
        sets.filter(F.col("month").between(F.lit(first), F.lit(last))),
        months,
        as_of,
        leave_first,
        placeholders,
    )
    return counted.select("month", "emp_id", *MASTER_COLUMNS, "cat", *COUNT_COLUMNS)


def _months_until(as_of: dt.date, first_month: dt.date | str) -> tuple[dt.date, Column]:
    """The first month, and the months of an employee from there to yesterday's."""
    first, last = month_start(first_month), month_start(as_of - dt.timedelta(days=1))
    joined = F.greatest(F.lit(first), F.trunc("creation_date", "MM"))
    return first, F.when(joined <= F.lit(last), F.sequence(joined, F.lit(last), F.expr("INTERVAL 1 MONTH")))


def division_register(
    tables: Tables, month: dt.date | str, as_of: dt.date, cat: str | None = None, **options
) -> DataFrame:
    """Summary of all divisions at once, grouped by division in its order."""
    summary = monthly_summary(tables, month, as_of, ALL_DIVISIONS, cat, **options)
    return summary_ordered(summary).select("division", *[c for c in summary.columns if c != "division"])


def summary_days(
    tables: Tables,
    month: dt.date | str,
    as_of: dt.date,
    division: str | None = ALL_DIVISIONS,
    cat: str | None = None,
    leave_first: bool = True,
    placeholders: str | None = "default",
    cutoffs: Cutoffs = Cutoffs(),
) -> DataFrame:
    """The classified employee-days behind a summary, one row each."""
    if placeholders == "default":
        placeholders = default_placeholders(division)
    chosen = division_cat_filter(tables.emp, division, cat)
    records = unified_records(
        month_filter(tables.leave, "date", month), month_filter(tables.attend, "log_date", month), leave_first
    )
    days = employee_days(summary_day_rows(records, cutoffs), chosen, month, as_of, placeholders)
    return late_override(day_attendance(days, month_filter(tables.holidays, "hol_date", month))).select(
        "emp_id", *MASTER_COLUMNS, "date", "attendance"
    )


def empty_summary_message(
    summary: DataFrame, division: str, cat: str, month: dt.date | str
) -> DataFrame:
    """One row saying so when a summary is empty, else none."""
    text = f"No {cat} in {division} in {month_start(month):%b %Y}"
    rows = summary.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("n = 0").select(F.lit(text).alias("error"))
