"""One registered query per operator, each over the whole derived tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterbook.functions import clock, status, text
from musterbook.model import MASTER_COLUMNS, Cutoffs, Tables, month_start, next_month
from musterbook.operators import counts, days, fill, filters, joins, lookups, records
from musterbook.plans import calendar, summary
from musterbook.session import shared_folder
from musterbook.sources import day_sets, store
from musterbook.sources.derived import DerivedTables

MONTH = dt.date(2024, 1, 1)
NEXT = next_month(MONTH)
CLOSED = dt.date(2024, 2, 1)
OPEN = dt.date(2024, 1, 20)
FIRST_IN_DATA = dt.date(1995, 1, 1)
CUTS = Cutoffs()
ONE = "00000007"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def on_tables(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a query over the derived attendance tables under the function's name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(DerivedTables(spark, sf_dir))
    return build


def on_files(build: Query) -> Query:
    """Register a query that reads the driver's tables itself."""
    QUERIES[build.__name__] = build
    return build


def all_records(t: Tables) -> DataFrame:
    return records.unified_records(t.leave, t.attend)


def month_records(t: Tables, leave_first: bool = True) -> DataFrame:
    return records.unified_records(
        filters.month_filter(t.leave, "date", MONTH),
        filters.month_filter(t.attend, "log_date", MONTH),
        leave_first,
    )


# Scans, sources, sinks


@on_tables
def attend_details(t):
    return joins.attend_details(t.attend, t.emp, None, "Faculty", MONTH, NEXT)


@on_tables
def leave_details(t):
    return joins.leave_details(t.leave, t.emp, ["NATION_1", "NATION_3", "NATION_8"], "Other", FIRST_IN_DATA, NEXT)


@on_tables
def employee_attend_details(t):
    return joins.employee_attend_details(t.attend, t.emp, MONTH, NEXT)


@on_tables
def employee_leave_details(t):
    return joins.employee_leave_details(t.leave, t.emp, MONTH, NEXT)


@on_tables
def employee_lookup(t):
    return lookups.employee_lookup(t.emp, columns=["emp_id", *MASTER_COLUMNS], active_only=True)


@on_tables
def employee_attend_details_one(t):
    return joins.employee_attend_details(t.attend, t.emp, MONTH, NEXT, ONE)


@on_tables
def employee_leave_details_one(t):
    return joins.employee_leave_details(t.leave, t.emp, FIRST_IN_DATA, NEXT, ONE)


@on_tables
def employee_lookup_one(t):
    return lookups.employee_lookup(t.emp, ONE.lstrip("0"), ["emp_id", *MASTER_COLUMNS], short_id=True)


@on_tables
def distinct_divisions(t):
    return lookups.distinct_divisions(t.emp)


@on_tables
def distinct_holidays(t):
    return lookups.distinct_holidays(t.holidays)


@on_tables
def category_choices(t):
    return lookups.category_choices(t.emp)


@on_tables
def last_log_date(t):
    return lookups.last_log_date(t.attend)


def stored_tables(t: Tables) -> tuple[SparkSession, str]:
    """The derived tables written as the library lays them out."""
    spark = t.attend.sparkSession
    folder = shared_folder(spark, "tables")
    store.write_tables(t, folder)
    return spark, folder


@on_tables
def last_log_date_stored(t):
    return store.stored_last_log_date(*stored_tables(t))


@on_files
def json_record_fields(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return store.json_record_fields(events, "props", "k INT, note STRING")


@on_tables
def summary_csv(t):
    table = summary.monthly_summary(t, MONTH, CLOSED, cat="Other")
    folder = shared_folder(table.sparkSession, "summary")
    path = store.summary_csv(table, folder, "All", "Other", MONTH)
    return table.sparkSession.read.schema(table.schema).option("header", True).csv(path)


# Projections, filters, predicates


@on_tables
def dedup_columns(t):
    return joins.dedup_columns(t.leave, t.emp, "emp_id", "left")


@on_tables
def month_filter(t):
    return filters.month_filter(t.leave, "date", MONTH)


@on_tables
def division_cat_filter(t):
    return filters.division_cat_filter(t.emp, "NATION_3", "Faculty")


@on_tables
def eligible_employees(t):
    return filters.eligible_employees(t.emp, dt.date(2024, 1, 31))


@on_tables
def leave_day_filter(t):
    return filters.leave_day_filter(all_records(t))


# Joins


@on_tables
def leave_emp_join(t):
    return joins.emp_join(t.leave, t.emp)


@on_tables
def attend_emp_join(t):
    return joins.emp_join(t.attend, t.emp)


@on_tables
def full_outer_raw(t):
    return joins.full_outer_raw(t.leave, t.emp)


@on_tables
def employees_without_records(t):
    return joins.employees_without_records(t.emp, month_records(t))


@on_tables
def holidays_in_window(t):
    window = days.employee_window(t.emp, month_records(t), MONTH, CLOSED)
    return days.holidays_in_window(t.holidays, window)


@on_tables
def employee_day_spine(t):
    window = days.employee_window(t.emp, month_records(t), MONTH, OPEN)
    return days.employee_day_spine(month_records(t), window)


@on_tables
def holiday_overlay(t):
    spine = employee_day_spine(t)
    return days.holiday_overlay(spine, t.holidays).drop("in_window")


@on_tables
def month_frame_join(t):
    recorded = records.first_record_of_day(month_records(t))
    return days.month_frame_join(recorded, MONTH)


@on_tables
def no_record_calendar(t):
    return days.no_record_calendar(t.emp, month_records(t), t.holidays, MONTH, CLOSED)


# Aggregations


@on_tables
def day_collapse(t):
    return records.day_collapse(all_records(t))


@on_tables
def day_collapse_distinct(t):
    return records.day_collapse(all_records(t), distinct=True)


@on_tables
def employee_window(t):
    return days.employee_window(t.emp, month_records(t), MONTH, OPEN)


def classified_days(t):
    return summary.summary_days(t, MONTH, CLOSED, division=None)


@on_tables
def summary_days(t):
    return classified_days(t)


@on_tables
def status_counts(t):
    return counts.status_counts(classified_days(t))


@on_tables
def status_pivot(t):
    return counts.status_pivot(classified_days(t))


def named_codes(df: DataFrame) -> DataFrame:
    return df.select("emp_id", F.explode("other_codes").alias("code", "n"))


@on_tables
def status_pivot_other_codes(t):
    return named_codes(counts.status_pivot(classified_days(t), other_codes=True))


@on_tables
def day_totals(t):
    return counts.day_totals(classified_days(t))


def month_calendar(t, places=True):
    return calendar.employee_calendar(t, MONTH, CLOSED, places=places)


@on_tables
def time_status_footer(t):
    return counts.time_status_footer(month_calendar(t, places=False))


@on_tables
def time_status_text(t):
    return counts.time_status_text(month_calendar(t, places=False))


@on_tables
def leave_tally_long(t):
    return counts.leave_tally_long(t.leave)


@on_tables
def leave_tally(t):
    return counts.leave_tally(t.leave)


@on_tables
def leave_tally_one(t):
    return counts.leave_tally(t.leave, ONE.lstrip("0"))


@on_tables
def calendar_grid(t):
    return counts.calendar_grid(month_calendar(t), MONTH)


@on_tables
def empty_code_columns(t):
    return counts.empty_code_columns(summary.monthly_summary(t, MONTH, CLOSED))


@on_tables
def duplicate_punch_days(t):
    return records.duplicate_punch_days(t.attend)


@on_tables
def distinct_rows(t):
    return records.distinct_rows(all_records(t).drop("precedence"))


# Windows


def first_named_days(t):
    """Days of recorded employees, named only where a leave record brought the master row."""
    named = joins.emp_join(t.leave, t.emp, "left")
    plain = t.attend.select("emp_id", F.col("log_date").alias("date"))
    return named.select("emp_id", "date", *MASTER_COLUMNS).unionByName(plain, allowMissingColumns=True)


@on_tables
def fill_downup(t):
    return fill.fill_downup(first_named_days(t), "emp_id", "date", MASTER_COLUMNS)


@on_tables
def fill_down(t):
    return fill.fill_down(first_named_days(t), "emp_id", "date", MASTER_COLUMNS)


@on_tables
def first_record_of_day(t):
    return records.first_record_of_day(records.unified_records(t.leave, t.attend, leave_first=False))


# Sorts


@on_tables
def summary_ordered(t):
    return counts.summary_ordered(summary.monthly_summary(t, MONTH, CLOSED, division=None))


# Set operations


@on_tables
def unified_records(t):
    return records.unified_records(t.leave, t.attend)


@on_tables
def placeholder_union(t):
    return records.placeholder_union(month_records(t), t.emp, MONTH)


# Scalar functions


@on_files
def month_bounds(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("ts"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts")
    months = orders.union(events).select(F.trunc("ts", "MM").alias("month")).distinct()
    return months.select("month", F.explode(clock.window_dates(F.col("month"), OPEN)).alias("date"))


@on_tables
def days_stale(t):
    return lookups.days_stale(t.attend, CLOSED)


@on_tables
def punch_parse(t):
    days = records.first_punches(all_records(t))
    return days.select("emp_id", "date", "in_ts", clock.punch_parse(F.col("out_text")).alias("out_ts"))


@on_tables
def clock_format(t):
    return t.attend.select(
        "emp_id", "in_time", clock.clock_format(clock.punch_parse(F.col("in_time"))).alias("in_clock")
    )


@on_tables
def blank_to_null(t):
    flat = records.day_collapse(all_records(t))
    return flat.select("emp_id", "date", text.blank_to_null(F.col("out_location")).alias("place"))


@on_tables
def flatten_comma(t):
    places = F.array("in_location", F.lit(None).cast("string"), "out_location")
    return t.attend.select("emp_id", "in_time", text.flatten_comma(places).alias("places"))


@on_files
def emp_id_pad(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    short = text.emp_id_pad(F.col("c_custkey").cast("string"))
    return customer.select("c_custkey", short.alias("short_id"), text.emp_id_pad(F.col("c_name")).alias("long_id"))


@on_files
def epi_week(spark, sf_dir):
    date = F.col("o_orderdate").cast("date")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", date.alias("date"), clock.epi_week(date).alias("week"))


@on_files
def calendar_parts(spark, sf_dir):
    date = F.col("l_shipdate").cast("date")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", *clock.calendar_parts(date))


@on_tables
def leave_type_label(t):
    return t.leave.select(
        "emp_id", "date", "leave_type", text.leave_type_label(F.col("leave_type")).alias("label")
    )


# Classification


def timed(t):
    return calendar.timed_punches(records.first_punches(all_records(t), distinct=True), CUTS)


@on_tables
def entry_status(t):
    return timed(t).select("emp_id", "date", "entry")


@on_tables
def exit_status(t):
    return timed(t).select("emp_id", "date", "exit")


@on_tables
def time_status(t):
    return timed(t).select("emp_id", "date", "time")


@on_tables
def day_attendance(t):
    return days.day_attendance(employee_day_spine(t), t.holidays).drop("in_window")


@on_tables
def late_override(t):
    return days.late_override(days.summary_day_rows(all_records(t), CUTS)).drop("entry")


@on_tables
def cell_class(t):
    cells = status.cell_class(F.col("attendance"), F.col("time")).alias("cell_class")
    return month_calendar(t, places=False).select("emp_id", "date", cells)


@on_tables
def absence_flag(t):
    return counts.absence_flag(summary.monthly_summary(t, MONTH, CLOSED))


# Composite jobs


@on_tables
def monthly_summary(t):
    """Every division and category in turn, employees without records included."""
    return summary.monthly_summary(t, MONTH, CLOSED, division=None)


@on_tables
def monthly_summary_other_codes(t):
    """Days of every unlisted code by name."""
    return named_codes(summary.monthly_summary(t, MONTH, CLOSED, division=None, other_codes=True))


@on_tables
def monthly_summary_open(t):
    return summary.monthly_summary(t, MONTH, OPEN, division=None)


@on_tables
def monthly_summary_choice(t):
    """One division and one category, as chosen in a single request."""
    return summary.monthly_summary(t, MONTH, CLOSED, "NATION_3", "Faculty")


@on_tables
def monthly_summary_present_first(t):
    """The service variant: punches outrank leave, leavers without records are listed."""
    return summary.monthly_summary(
        t, MONTH, OPEN, division=None, leave_first=False, placeholders="any"
    )


@on_tables
def employee_calendar(t):
    return month_calendar(t)


@on_tables
def employee_calendar_one(t):
    return calendar.employee_calendar(t, MONTH, CLOSED, ONE)


@on_tables
def employee_calendar_one_stored(t):
    """The same from written tables, where an employee's rows lie together."""
    return calendar.employee_calendar(store.read_tables(*stored_tables(t)), MONTH, CLOSED, ONE)


@on_tables
def employee_calendar_present_first(t):
    return calendar.employee_calendar(t, MONTH, OPEN, leave_first=False)


@on_tables
def division_register(t):
    return summary.division_register(t, MONTH, CLOSED, "Other")


@on_tables
def summary_all_months(t):
    return summary.summary_all_months(t, CLOSED, FIRST_IN_DATA)


@on_tables
def summary_incremental(t):
    """All months from kept day sets: the facts until a day in mid-month first, then the rest merged in."""
    cut = "2024-01-17"
    folder = shared_folder(t.emp.sparkSession, "day-sets")
    day_sets.write_day_sets(t.leave.where(f"date < '{cut}'"), t.attend.where(f"log_date < '{cut}'"), folder)
    day_sets.merge_day_sets(t.leave.where(f"date >= '{cut}'"), t.attend.where(f"log_date >= '{cut}'"), folder)
    kept = day_sets.read_day_sets(t.emp.sparkSession, folder)
    return summary.summary_from_sets(kept, t.emp, t.holidays, CLOSED, FIRST_IN_DATA)


@on_tables
def empty_summary_message(t):
    table = summary.monthly_summary(t, MONTH, CLOSED, "NATION_3", "Visitor")
    return summary.empty_summary_message(table, "NATION_3", "Visitor", month_start(MONTH))

