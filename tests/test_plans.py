"""What the physical plans must look like, and that stored tables prune."""

import datetime as dt
import inspect
import re

import pytest

from factories import day, person, punch
from musterbook.model import CODES
from musterbook.operators.counts import status_pivot
from musterbook.plans.calendar import employee_calendar
from musterbook.plans.summary import monthly_summary, summary_all_months, summary_days
from musterbook.sources import store

JAN, CLOSED = day(1), dt.date(2024, 2, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, make_tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    dates = [day(d, m) for m in (1, 2, 3) for d in (3, 4, 5)]
    tables = make_tables(
        [person("1"), person("2", division="Medicine")],
        [punch(e, d, "08:00:00", "17:00:00") for e in "12" for d in dates],
        [("1", day(8, m), "CL") for m in (1, 2, 3)],
        [day(15)],
    )
    store.write_tables(tables, folder)
    return store.read_tables(spark, folder)


def test_month_reaches_the_partitions(stored):
    for table in (monthly_summary(stored, JAN, CLOSED), employee_calendar(stored, JAN, CLOSED)):
        text = plan(table)
        for column in ("log_date", "date_month"):
            assert re.search(rf"PartitionFilters: \[[^]]*\b{column}#\d+ >= 2024-01-01", text)


def test_summary_reads_only_what_it_needs(stored):
    scan = next(line for line in plan(monthly_summary(stored, JAN, CLOSED)).splitlines() if "/attend]" in line)
    assert scan.endswith("ReadSchema: struct<emp_id:string,in_time:string>")


def test_summary_combines_hashed_before_its_exchange(stored):
    text = plan(summary_all_months(stored, dt.date(2024, 4, 1), JAN))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert re.search(r"HashAggregate\(keys=\[emp_id#\d+, .*partial_bit_or", text)
    assert "Generate" not in text
    facts = [l for l in text.splitlines() if "Exchange hashpartitioning(emp_id" in l and "HashedRelation" not in l]
    assert len(facts) <= 2


def test_one_employee_is_a_pushed_filter(stored):
    text = plan(employee_calendar(stored, JAN, CLOSED, "1"))
    filters = [line for line in text.splitlines() if re.search(r"Filter .*\(emp_id#\d+ = 1\)", line)]
    assert len(filters) == 3 and text.count("EqualTo(emp_id,1)") >= 2


def test_leave_and_punches_meet_without_another_exchange(stored):
    text = plan(summary_all_months(stored, dt.date(2024, 4, 1), JAN))
    after_union = text[: text.index("Union")].splitlines()[-3:]
    assert not any("Exchange" in line for line in after_union)


def test_selection_does_not_change_the_facts_plan(stored):
    """Facts are reduced alike whatever is chosen; no size decides about a semi join."""
    for choice in (("All", None), ("Surgery", "Faculty"), ("Medicine", None)):
        text = plan(monthly_summary(stored, JAN, CLOSED, *choice))
        assert "LeftSemi" not in text and len(re.findall(r"/attend\]", text)) == 1


def test_holidays_are_read_for_the_month_only(stored):
    for table in (monthly_summary(stored, JAN, CLOSED), summary_days(stored, JAN, CLOSED)):
        assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(hol_date,2024-01-01\)", plan(table))


@pytest.mark.parametrize("leave_first", [True, False])
def test_leave_without_a_type_is_absence(make_tables, leave_first):
    t = make_tables([person("1")], [punch("1", day(4), "08:00:00", "17:00:00")], [("1", day(d), None) for d in (3, 4)])
    counted = monthly_summary(t, JAN, CLOSED, leave_first=leave_first).first()
    by_day = status_pivot(summary_days(t, JAN, CLOSED, leave_first=leave_first)).first()
    assert [counted[c] for c in [*CODES, "other"]] == [by_day[c] for c in [*CODES, "other"]]
    assert counted["other"] == 0 and counted["P"] == (0 if leave_first else 1)


@pytest.mark.parametrize("build", [monthly_summary, summary_days, employee_calendar])
def test_no_python_and_no_cross_join(stored, build):
    text = plan(build(stored, JAN, CLOSED))
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_jobs_do_not_grow_with_employees(spark, make_tables):
    """Building a summary starts no job; running it starts one whatever the number of employees."""

    def stages(n):
        t = make_tables([person(str(i)) for i in range(n)], [punch(str(i), day(3), "08:00:00", None) for i in range(n)])
        return plan(monthly_summary(t, JAN, CLOSED)).count("Exchange")

    assert stages(2) == stages(200)


def test_library_never_collects():
    import musterbook.operators as operators
    import musterbook.plans as plans

    from importlib import import_module
    from pkgutil import iter_modules

    for package in (operators, plans):
        for module in iter_modules(package.__path__, package.__name__ + "."):
            source = inspect.getsource(import_module(module.name))
            for call in (".collect()", ".toPandas(", ".toLocalIterator(", ".rdd", "localCheckpoint", "crossJoin"):
                assert call not in source, (module.name, call)


def test_stored_results(stored):
    rows = summary_all_months(stored, dt.date(2024, 4, 1), JAN).orderBy("month", "emp_id").collect()
    assert [(r["month"].month, r["emp_id"], r["P"], r["CL"]) for r in rows][:2] == [(1, "1", 3, 1), (1, "2", 3, 0)]
    assert len(rows) == 6


def test_one_employee_lies_in_few_row_groups(spark, make_tables, tmp_path):
    """Row groups are told apart by their range of ids; few can hold a given employee."""
    import pyarrow.parquet as pq

    ids = [f"{n:08d}" for n in range(3000)]
    t = make_tables(
        [person(i) for i in ids],
        [punch(i, day(3), f"0{n % 10}:00:00", None) for n, i in enumerate(ids) for _ in range(4)],
        [(i, day(1 + n % 28, m), "CL") for n, i in enumerate(ids) for m in (1, 2)],
    )
    store.write_tables(t, str(tmp_path), row_group_bytes=4096)
    for name, one in (("attend", 4), ("leave", 2)):
        groups, held = 0, 0
        for file in (tmp_path / name).rglob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            place = meta.schema.names.index("emp_id")
            ranges = [meta.row_group(k).column(place).statistics for k in range(meta.num_row_groups)]
            groups += len(ranges)
            held += sum(r.min <= "00001234" <= r.max for r in ranges)
        assert groups >= 20 and held <= groups / 5
        assert getattr(store.read_tables(spark, str(tmp_path)), name).filter("emp_id = '00001234'").count() == one


def test_newest_date_without_reading_rows(spark, stored, make_tables, tmp_path):
    store.write_tables(stored, str(tmp_path / "a"))
    newest = store.stored_last_log_date(spark, str(tmp_path / "a"))
    assert "FileScan" not in plan(newest) and newest.first()[0] == stored.attend.agg({"log_date": "max"}).first()[0]
    # A partition that has lost its rows does not count.
    spark.createDataFrame([], stored.attend.drop("log_date").schema).coalesce(1).write.parquet(str(tmp_path / "a/attend/log_date=2030-01-01"))
    assert store.stored_last_log_date(spark, str(tmp_path / "a")).first()[0] == newest.first()[0]
    store.write_tables(make_tables([person("1")]), str(tmp_path / "b"))
    assert store.stored_last_log_date(spark, str(tmp_path / "b")).first()[0] is None


@pytest.mark.parametrize("leave_first", [True, False])
def test_unlisted_codes_come_out_by_name(make_tables, leave_first):
    leave = [("1", day(d), c) for d, c in ((3, "WFH"), (4, "WFH"), (4, "STUDY"), (5, "STUDY"), (5, "CL"), (8, "WFH"), (7, "WFH"), (9, "AAA"))]
    t = make_tables([person("1"), person("2")], [punch("1", day(8), "08:00:00", "17:00:00")], leave, [day(9)])
    names = {"WFH": 2, "STUDY": 1} if leave_first else {"WFH": 1, "STUDY": 1}
    summed = monthly_summary(t, JAN, CLOSED, None, leave_first=leave_first, other_codes=True)
    # The one thing exploded is the month that placeholders are listed for.
    assert plan(summed).count("Generate") == 1
    by_day = status_pivot(summary_days(t, JAN, CLOSED, None, leave_first=leave_first), other_codes=True)
    for df in (summed, by_day):
        rows = {r["emp_id"]: r for r in df.collect()}
        assert rows["1"]["other_codes"] == names and rows["1"]["other"] == sum(names.values())
        assert rows["2"]["other_codes"] == {} and rows["2"]["other"] == 0
