"""Golden cases of the rules, on hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factories import day, person, punch
from musterbook.functions import clock, status, text
from musterbook.model import NO_EXIT_TEXT, Cutoffs
from musterbook.operators.records import day_collapse, unified_records
from musterbook.plans.calendar import employee_calendar, timed_days
from musterbook.plans.summary import monthly_summary, summary_days

JAN, CLOSED = day(1), dt.date(2024, 2, 1)
NAMES = ["Name", "entry", "exit", "time"]


def timed_day(make_tables, punches, distinct=True):
    t = make_tables(attend=punches)
    rows = timed_days(day_collapse(unified_records(t.leave, t.attend), distinct), Cutoffs()).collect()
    return rows[0]["entry"], rows[0]["exit"], rows[0]["time"]


@pytest.mark.parametrize(
    "date, in_time, out_time, expected",
    [
        (day(3), "09:20:59", "17:00:00", ("On time entry", "On time exit", "On time")),
        (day(3), "09:21:00", "17:00:00", ("Late entry", "On time exit", "Late entry")),
        (day(3), "09:00:00", "04:45:00", ("On time entry", "On time exit", "On time")),
        (day(3), "09:00:00", "04:44:59", ("On time entry", "Early exit", "Early exit")),
        (day(3), "10:00:00", "04:44:59", ("Late entry", "Early exit", "Late entry & early exit")),
        (day(6), "09:00:00", "12:44:59", ("On time entry", "Early exit", "Early exit")),
        (day(6), "09:00:00", "12:45:00", ("On time entry", "On time exit", "On time")),
        (day(7), "09:00:00", "12:44:59", ("On time entry", "Early exit", "Early exit")),
        (day(3), "09:00:00", NO_EXIT_TEXT, ("On time entry", "No exit", "No exit")),
        (day(3), "10:00:00", NO_EXIT_TEXT, ("Late entry", "No exit", "Late entry & No exit")),
        (day(3), "09:00:00", "2024-01-04 01:00:00", ("On time entry", "On time exit", "On time")),
        (day(3), "09:00:00", None, ("On time entry", None, None)),
        (day(3), "no time", "17:00:00", (None, "On time exit", None)),
        (day(3), "09:00:00", "2024-13-45 10:00:00", ("On time entry", None, None)),
    ],
)
def test_time_status_of_one_punch(make_tables, date, in_time, out_time, expected):
    assert timed_day(make_tables, [punch("1", date, in_time, out_time)]) == expected


def test_first_of_several_punches_decides(make_tables):
    late_second = [punch("1", day(3), "08:00:00", "17:00:00"), punch("1", day(3), "11:00:00", "18:00:00")]
    assert timed_day(make_tables, late_second) == ("On time entry", "On time exit", "On time")


def test_marker_followed_by_a_time_is_unknown(make_tables):
    mixed = [punch("1", day(3), "08:00:00", NO_EXIT_TEXT), punch("1", day(3), "11:00:00", "18:00:00")]
    assert timed_day(make_tables, mixed) == ("On time entry", None, None)


def test_repeated_marker_depends_on_distinct(make_tables):
    twice = [punch("1", day(3), "08:00:00", NO_EXIT_TEXT)] * 2
    assert timed_day(make_tables, twice, distinct=True)[1] == "No exit"
    assert timed_day(make_tables, twice, distinct=False)[1] is None


def test_repeated_punches_stay_in_the_lists(make_tables):
    twice = [punch("1", day(3), "08:00:00", None)] * 2 + [punch("1", day(3), "09:00:00", "17:00:00", in_loc=None)]
    t = make_tables(attend=twice)
    row = day_collapse(unified_records(t.leave, t.attend)).collect()[0]
    assert row["in_location"] == "Gate A, Gate A"
    assert row["in_time"] == "2024-01-03 08:00:00, 2024-01-03 08:00:00, 2024-01-03 09:00:00"
    assert row["out_time"] == "2024-01-03 17:00:00"


def codes_of(t, **options):
    return {r["date"]: r["attendance"] for r in summary_days(t, JAN, CLOSED, **options).collect()}


def test_holidays_sundays_and_leave(make_tables):
    t = make_tables(
        [person("1")],
        [punch("1", day(d), "08:00:00", "17:00:00") for d in (7, 15, 16, 17)],
        [("1", day(14), "EL"), ("1", day(15), "CL"), ("1", day(17), "CL"), ("1", day(18), "XX"), ("1", day(26), "EL")],
        [day(15), day(26), day(26)],
    )
    codes = codes_of(t)
    assert codes[day(7)] == "H" and codes[day(14)] == "EL" and codes[day(15)] == "H"
    assert codes[day(16)] == "P" and codes[day(17)] == "CL" and codes[day(26)] == "EL"
    assert codes[day(18)] == "XX" and codes[day(19)] == "A" and len(codes) == 31
    assert codes_of(t, leave_first=False)[day(17)] == "P"
    row = monthly_summary(t, JAN, CLOSED).collect()[0]
    assert (row["other"], row["EL"], row["total_days"]) == (1, 2, 31)
    assert row["present_days"] == 31 - row["A"]


def test_earned_leave_and_punch_on_a_holiday(make_tables):
    t = make_tables([person("1")], [punch("1", day(15), "08:00:00", None)], [("1", day(15), "EL")], [day(15)])
    assert codes_of(t)[day(15)] == "EL"
    assert codes_of(t, leave_first=False)[day(15)] == "H"


def test_join_date_limits_the_window(make_tables):
    t = make_tables(
        [person("1", day(10)), person("2", dt.date(2024, 2, 15))],
        [punch("1", day(d), "08:00:00", None) for d in (3, 5, 12)] + [punch("2", day(3), "08:00:00", None)],
        holidays=[day(5)],
    )
    codes = codes_of(t)
    # A punch before joining counts; a listed holiday there does not apply, a Sunday does.
    assert codes[day(3)] == "P" and codes[day(5)] == "P" and len(codes) == 2 + 22
    assert [r["emp_id"] for r in monthly_summary(t, JAN, CLOSED).collect()] == ["1"]


def test_leaver_counts_to_the_last_record(make_tables):
    t = make_tables([person("1", status="I"), person("2", status="I")], [punch("1", day(12), "08:00:00", None)])
    rows = monthly_summary(t, JAN, CLOSED, None).collect()
    assert [(r["emp_id"], r["total_days"]) for r in rows] == [("1", 12)]
    rows = monthly_summary(t, JAN, CLOSED, None, placeholders="any").orderBy("emp_id").collect()
    assert [(r["emp_id"], r["total_days"]) for r in rows] == [("1", 12), ("2", 1)]


def test_employees_without_records(make_tables):
    t = make_tables([person("1"), person("2", day(10))], holidays=[day(15)])
    rows = {r["emp_id"]: r for r in monthly_summary(t, JAN, CLOSED, "Surgery", "Faculty").collect()}
    assert (rows["1"]["A"], rows["1"]["H"], rows["1"]["total_days"]) == (26, 5, 31)
    # The placeholder adds the first of the month to the days from the 10th on.
    assert rows["2"]["total_days"] == 23
    assert monthly_summary(t, JAN, CLOSED, "All", "Faculty").count() == 0


def test_open_month_keeps_future_leave(make_tables):
    t = make_tables([person("1")], leave=[("1", day(25), "CL")])
    row = monthly_summary(t, JAN, dt.date(2024, 1, 20)).collect()[0]
    assert (row["CL"], row["total_days"]) == (1, 20)
    # On the last day of the month the window still ends the day before.
    assert monthly_summary(t, JAN, dt.date(2024, 1, 31)).collect()[0]["total_days"] == 30


def test_late_only_when_present(make_tables):
    t = make_tables(
        [person("1")],
        [punch("1", day(3), "10:00:00", None), punch("1", day(4), "10:00:00", None), punch("1", day(7), "10:00:00", None)],
        [("1", day(4), "CL")],
    )
    row = monthly_summary(t, JAN, CLOSED).collect()[0]
    assert (row["Late"], row["P"], row["CL"]) == (1, 0, 1)
    calendar = {r["date"]: r for r in employee_calendar(t, JAN, CLOSED).collect()}
    assert (calendar[day(3)]["attendance"], calendar[day(4)]["in_time"]) == ("P", "10:00 AM")


def test_calendar_without_master_row_uses_the_whole_window(make_tables):
    t = make_tables(attend=[punch("9", day(12), "08:00:00", None)])
    rows = employee_calendar(t, JAN, CLOSED).collect()
    assert len(rows) == 31 and {r["emp_name"] for r in rows} == {None}
    assert monthly_summary(t, JAN, CLOSED).count() == 0


def test_cutoffs_are_parameters(make_tables):
    t = make_tables([person("1")], [punch("1", day(3), "08:30:00", None)])
    assert monthly_summary(t, JAN, CLOSED, cutoffs=Cutoffs(entry="08:00:00")).collect()[0]["Late"] == 1


def test_scalar_functions(spark):
    ids = spark.createDataFrame([("7",), ("123456789",)], "v STRING")
    assert [r[0] for r in ids.select(text.emp_id_pad(F.col("v"))).collect()] == ["00000007", "123456789"]
    week = spark.createDataFrame(
        [(dt.date(2021, 1, 2), 53), (dt.date(2021, 1, 3), 1), (dt.date(2024, 12, 29), 1), (dt.date(2024, 12, 28), 52)],
        "d DATE, w INT",
    )
    assert week.filter(clock.epi_week(F.col("d")) != F.col("w")).count() == 0
    codes = spark.createDataFrame([("CL",), ("T",), ("XX",), (None,)], "c STRING")
    labels = [r[0] for r in codes.select(text.leave_type_label(F.col("c"))).collect()]
    assert labels == ["Casual Leave", "Tour", None, None]
    texts = spark.createDataFrame([("2024-01-03 08:00:00, 2024-01-03 09:00:00",), (NO_EXIT_TEXT,), ("",), (None,)], "t STRING")
    parsed = [r[0] for r in texts.select(clock.punch_parse(F.col("t"))).collect()]
    assert parsed == [dt.datetime(2024, 1, 3, 8), None, None, None]


def test_reversed_range_is_empty(spark):
    d = spark.createDataFrame([(day(5), day(3)), (day(3), day(5)), (None, day(3)), (day(3), None)], "a DATE, b DATE")
    sizes = [r[0] for r in d.select(F.size(clock.date_range(F.col("a"), F.col("b")))).collect()]
    assert sizes == [0, 3, 0, 0]


def test_cell_class(spark):
    cells = [("A", None, "absent"), ("EL", None, "leave"), ("P", "On time", "present"), ("P", "No exit", "irregular"),
             ("P", None, "present"), ("H", None, "holiday"), ("XX", None, None), (None, None, None)]
    df = spark.createDataFrame(cells, "a STRING, t STRING, c STRING")
    assert df.filter(~status.cell_class(F.col("a"), F.col("t")).eqNullSafe(F.col("c"))).count() == 0
