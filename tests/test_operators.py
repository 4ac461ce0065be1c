"""Stand-alone operators on small tables."""

import datetime as dt

from factories import day, person, punch
from musterbook.model import MASTER_COLUMNS
from musterbook.operators import counts, days, fill, filters, joins, lookups, records
from musterbook.plans import summary


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_master_joins(make_tables):
    t = make_tables([person("1"), person("2")], leave=[("1", day(3), "CL"), ("9", day(4), "EL"), ("9", day(5), "EL")])
    assert [r["emp_id"] for r in joins.emp_join(t.leave, t.emp).collect()] == ["1"]
    left = joins.emp_join(t.leave, t.emp, "left")
    assert {(r["emp_id"], r["emp_name"]) for r in left.collect()} == {("1", "Name 1"), ("9", None)}
    outer = joins.full_outer_raw(t.leave, t.emp).collect()
    assert sorted((r["emp_id"] or "", r["emp_name"] or "") for r in outer) == [
        ("", "Name 2"), ("1", "Name 1"), ("9", ""), ("9", "")
    ]
    assert joins.dedup_columns(t.leave, t.emp, "emp_id", "full").columns[:3] == ["emp_id", "date", "leave_type"]
    assert joins.dedup_columns(t.leave, t.emp, "emp_id", "full").filter("emp_id IS NULL").count() == 1


def test_filters(make_tables):
    t = make_tables(
        [person("1"), person("2", day(10), "I", "Medicine", "Other")],
        leave=[("1", dt.date(2023, 12, 31), "CL"), ("1", day(1), "XX"), ("1", day(31), "EL"), ("1", day(1, 2), "CL"), ("1", None, "CL")],
    )
    assert filters.month_filter(t.leave, "date", "2024-01").count() == 2
    assert filters.division_cat_filter(t.emp).count() == 2
    assert filters.division_cat_filter(t.emp, ["Medicine", "A"]).count() == 1
    assert filters.eligible_employees(t.emp, day(9)).count() == 1
    every = records.unified_records(t.leave, t.attend)
    assert filters.leave_day_filter(every).count() == 4


def test_lookups(make_tables):
    t = make_tables(
        [person("1"), person("2", status="I", division="Anatomy", cat="Other"), person("3", cat="Visitor")],
        [punch("1", day(3), "08:00:00", None), punch("1", day(5), "08:00:00", None)],
        holidays=[day(26), day(15), day(26)],
    )
    assert lookups.employee_lookup(t.emp, "2").count() == 1
    assert lookups.employee_lookup(t.emp, "2", active_only=True).count() == 0
    assert lookups.employee_lookup(t.emp, "1' OR '1'='1").count() == 0
    assert [tuple(r) for r in lookups.distinct_divisions(t.emp).collect()] == [(0, "All"), (1, "Anatomy"), (1, "Surgery")]
    assert [tuple(r) for r in lookups.category_choices(t.emp).collect()] == [(1, "Faculty"), (4, "Other")]
    assert [tuple(r) for r in lookups.distinct_holidays(t.holidays).collect()] == [(day(15), "H"), (day(26), "H")]
    assert [r[0] for r in lookups.distinct_values(t.emp, "division", ascending=False).collect()] == ["Surgery", "Anatomy"]
    assert tuple(lookups.days_stale(t.attend, day(8)).collect()[0]) == (day(5), 2, True)
    assert tuple(lookups.days_stale(t.attend, day(6)).collect()[0]) == (day(5), 0, False)


def test_fill_carries_over_dates(spark):
    df = spark.createDataFrame(
        [("a", day(1), None), ("a", day(2), "x"), ("a", day(3), None), ("a", day(4), "y"), ("a", day(4), None),
         ("a", day(5), None), ("b", day(1), None), (None, day(1), "n"), (None, None, None)],
        "emp_id STRING, date DATE, name STRING",
    )
    down = [("'a'", 1, None), ("'a'", 2, "x"), ("'a'", 3, "x"), ("'a'", 4, "y"), ("'a'", 4, "y"), ("'a'", 5, "y"), ("'b'", 1, None)]

    def known(frame):
        return sorted(
            ((repr(r[0]), r[1].day, r[2]) for r in frame.collect() if r[0] is not None), key=repr
        )

    assert known(fill.fill_down(df, "emp_id", "date", ["name"])) == sorted(down, key=repr)
    assert known(fill.fill_downup(df, "emp_id", "date", ["name"]))[0] == ("'a'", 1, "x")
    assert fill.fill_down(df, "emp_id", "date", ["name"]).count() == df.count()


def test_fill_does_not_mix_rows_of_a_date(spark):
    """Two people's names under one id and date: the least row stands for the date, with its own division."""
    rows = [(1, "Zoe", "Alpha"), (1, "Ann", "Zeta"), (2, None, None), (3, "Bob", None), (3, None, "Beta"), (4, None, None), (0, None, None)]
    df = spark.createDataFrame([("a", day(10 + d), n, v) for d, n, v in rows], "emp_id STRING, date DATE, name STRING, division STRING")
    take = lambda frame: {(r["date"].day - 10, r["name"], r["division"]) for r in frame.collect()}
    down = take(fill.fill_down(df, "emp_id", "date", ["name", "division"]))
    # On the third day Bob's row stands for the date; his division is that of the nearest date before.
    shared = {(1, "Zoe", "Alpha"), (1, "Ann", "Zeta"), (2, "Ann", "Zeta"), (3, "Bob", "Zeta"), (3, "Bob", "Beta"), (4, "Bob", "Zeta")}
    assert down == shared | {(0, None, None)}
    assert take(fill.fill_downup(df, "emp_id", "date", ["name", "division"])) == shared | {(0, "Ann", "Zeta")}


def test_spine_keeps_records_outside_the_window(spark, make_tables):
    t = make_tables([person("1", day(30))], leave=[("1", day(3), "CL"), ("1", day(30), "EL"), ("8", day(3), "CL")])
    recs = records.unified_records(t.leave, t.attend)
    window = days.employee_window(t.emp, recs, day(1), dt.date(2024, 2, 1))
    assert tuples(days.employee_day_spine(recs, window)) == [
        ("1", day(3), "CL", False), ("1", day(30), "EL", True), ("1", day(31), None, True), ("8", day(3), "CL", False)
    ]


def test_month_frame_and_grid(make_tables, spark):
    cells = spark.createDataFrame(
        [("1", dt.date(2024, 12, 30), "P", "On time", "08:00 AM", "05:00 PM", "Gate A", None)],
        "emp_id STRING, date DATE, attendance STRING, time STRING, in_time STRING, out_time STRING, "
        "in_location STRING, out_location STRING",
    )
    framed = days.month_frame_join(cells, "2024-12")
    assert framed.count() == 31 and framed.filter("attendance = 'P'").count() == 1
    grid = counts.calendar_grid(cells, "2024-12").orderBy("week_start").collect()
    assert [r["week"] for r in grid] == [49, 50, 51, 52, 1]
    assert [r["day_1"] for r in grid] == [1, 8, 15, 22, 29]
    assert (grid[-1]["attendance_2"], grid[-1]["day_2"], grid[-1]["day_4"]) == ("P", 30, None)


def test_tally_keeps_years_of_unknown_types(make_tables):
    t = make_tables(leave=[("00000007", dt.date(2021, 5, 1), "XX"), ("00000007", day(3), "CL"), ("00000007", day(4), "CL")])
    rows = counts.leave_tally(t.leave, "7").collect()
    assert [(r["year"], r["Casual Leave"], r["Tour"]) for r in rows] == [(2024, 2, 0), (2021, 0, 0)]
    assert tuples(counts.leave_tally_long(t.leave, "7")) == [
        ("00000007", 2021, None, 1), ("00000007", 2024, "Casual Leave", 2)
    ]
    assert counts.leave_tally(t.leave, "8").count() == 0


def test_footer_texts(spark):
    calendar = spark.createDataFrame(
        [("1", "On time"), ("1", "On time"), ("1", "Early exit"), ("1", None), ("2", None)], "emp_id STRING, time STRING"
    )
    assert tuples(counts.time_status_text(calendar)) == [("1", "**1** days Early exit, **2** days On time")]


def test_summary_views(make_tables):
    t = make_tables(
        [person("1", level="Tutor"), person("2"), person("3", level="Unknown"), person("4", division="Anatomy")],
        [punch(e, day(3), "08:00:00", None) for e in "1234"],
    )
    table = summary.monthly_summary(t, day(1), dt.date(2024, 2, 1))
    assert [r["emp_id"] for r in counts.summary_ordered(table).collect()] == ["4", "2", "1", "3"]
    register = summary.division_register(t, day(1), dt.date(2024, 2, 1))
    assert register.columns[0] == "division"
    assert [r["emp_id"] for r in register.collect()] == ["4", "2", "1", "3"]
    shown = {r["code"]: (r["total"], r["shown"]) for r in counts.empty_code_columns(table).collect()}
    assert shown["P"] == (4, True) and shown["CL"] == (0, False) and shown["A"][1]
    assert {r["has_absence"] for r in counts.absence_flag(table).collect()} == {True}
    none = table.filter("emp_id = 'x'")
    assert counts.empty_code_columns(none).filter("shown").count() == 1
    assert summary.empty_summary_message(none, "Surgery", "Other", "2024-01").collect()[0][0] == "No Other in Surgery in Jan 2024"
    assert summary.empty_summary_message(table, "Surgery", "Other", "2024-01").count() == 0


def test_record_stream(make_tables):
    t = make_tables(
        [person("1"), person("2"), person("3", status="I")],
        [punch("1", day(3), "08:00:00", None), punch("1", day(3), "09:00:00", None)],
        [("1", day(3), "EL"), ("1", day(3), "CL"), ("1", day(3), "XX")],
    )
    both = records.unified_records(t.leave, t.attend)
    assert tuples(records.first_record_of_day(both)) == [("1", day(3), "CL")]
    added = records.placeholder_union(both, t.emp, "2024-01")
    assert tuples(added.filter("precedence = 2").select("emp_id", "date", "attendance")) == [("2", day(1), None)]
    assert records.placeholder_union(both, t.emp, "2024-01", active_only=False).count() == 7
    assert tuples(records.duplicate_punch_days(t.attend)) == [("1", day(3), 2)]
    assert joins.employees_without_records(t.emp, both).columns == ["emp_id", *MASTER_COLUMNS]
