"""Days of punches: two-step lists, first-punch state and packed codes, by rows and by plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factories import day, person, punch
from musterbook.model import NO_EXIT_TEXT, Cutoffs
from musterbook.operators import days, records
from musterbook.plans.calendar import employee_calendar, timed_days, timed_punches

ODD = [None, "", "never", NO_EXIT_TEXT, "2024-13-01 09:00:00", "2024-01-03 09:00:00.5", "2024-01-05 07:00:00", "2024-01-01 23:00:00"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def busy(spark, make_tables):
    rng = random.Random(11)
    pick = lambda: rng.choice([*ODD, *[f"2024-01-03 {h:02d}:{m:02d}:{s:02d}" for h in (4, 9, 12, 23) for m in (0, 20, 59) for s in (0, 59)]])
    punches = [
        punch(rng.choice("112"), day(3), pick(), pick(), rng.choice(["D1", None]), "D2", rng.choice(["Gate A", "", None]), rng.choice([None, "Gate B"]))
        for _ in range(700)
    ]
    punches += [punch(str(k), day(4), pick(), pick()) for k in range(3, 160)] * 2
    leave = [("1", day(3), rng.choice(["WFH", "STUDY", "CL", None])) for _ in range(9)]
    leave += [(str(k), day(4), rng.choice(["WFH", "STUDY", "CL", "P", None])) for k in range(3, 160) for _ in range(2)]
    return make_tables([person("1"), person("2")], punches, leave)


def texts_of(rows, distinct):
    """Comma lists of one employee-day by sorting its rows."""
    last = chr(0x10FFFF)

    def order(r):
        raw = [r[c] for c in ("in_time", "in_device_id", "out_time", "out_device_id", "in_location", "out_location")]
        return (r["in_ts"] is None, str(r["in_ts"]), [last if x is None else x for x in raw])

    held = sorted((r for r in rows if r["precedence"] == 1), key=order)
    if distinct:
        held = [r for n, r in enumerate(held) if n == 0 or order(r)[2][:4] != order(held[n - 1])[2][:4]]
    return {c: ", ".join(r[c] for r in held if r[c] is not None) for c in ("in_time", "out_time", "in_location", "out_location")}


@pytest.mark.parametrize("distinct", [False, True])
def test_lists_of_busy_days(busy, distinct):
    rows = records.unified_records(busy.leave, busy.attend)
    by_day = {}
    for r in rows.withColumn("in_ts", records.punch_parse(F.col("in_time"))).collect():
        by_day.setdefault((r["emp_id"], r["date"]), []).append(r)
    found = records.day_collapse(rows, distinct).collect()
    assert len(found) == len(by_day)
    for r in found:
        want = texts_of(by_day[r["emp_id"], r["date"]], distinct)
        for column in ("in_time", "out_time") if distinct else want:
            assert r[column] == want[column]


@pytest.mark.parametrize("distinct", [False, True])
def test_state_equals_the_lists(busy, distinct):
    """Status from the first punch alone is the status read off the flattened texts."""
    rows = records.unified_records(busy.leave, busy.attend, leave_first=False)
    pick = lambda df: sorted(map(tuple, df.select("emp_id", "date", "attendance", "entry", "exit", "time").collect()), key=repr)
    by_state = pick(timed_punches(records.first_punches(rows, distinct), Cutoffs()))
    assert by_state == pick(timed_days(records.day_collapse(rows, distinct), Cutoffs()))
    assert len({r[4] for r in by_state}) == (4 if distinct else 3)


def test_unlisted_codes_rank_by_text(busy):
    rows = records.unified_records(busy.leave, busy.attend)
    place = {c: n for n, c in enumerate(["P", "Late", "A", "H", "RH", "CL", "EL", "SL", "ML", "O", "T"])}
    best = {}
    for r in rows.collect():
        key = (r["precedence"], place.get(r["attendance"], 50 if r["attendance"] else 60), r["attendance"] or "")
        best[r["emp_id"], r["date"]] = min(best.get((r["emp_id"], r["date"]), key), key)
    found = {(r["emp_id"], r["date"]): r["attendance"] for r in records.first_record_of_day(rows).collect()}
    assert found == {k: v[2] or None for k, v in best.items()}
    assert {"WFH", "STUDY", None} & set(found.values())


def test_status_builds_no_list(busy):
    rows = records.unified_records(busy.leave, busy.attend)
    for df in (records.first_punches(rows), timed_punches(records.first_punches(rows, True), Cutoffs())):
        assert "collect_list" not in plan(df)


def test_day_lists_meet_by_minute(busy):
    """Punches are sorted per minute, in tasks dealt by it; without places no punch is listed at all."""
    rows = records.unified_records(busy.leave, busy.attend)
    assert re.search(r"Exchange hashpartitioning\(emp_id#\d+, date#\d+, \w*chunk#\d+", plan(records.day_collapse(rows)))
    status = plan(employee_calendar(busy, day(1), day(1, 2), places=False))
    assert "chunk#" not in status and "chunk#" in plan(employee_calendar(busy, day(1), day(1, 2)))


def test_raw_rows_meet_hash_aggregates_only(busy):
    rows = records.unified_records(busy.leave, busy.attend)
    window = days.employee_window(busy.emp, rows, day(1), day(1, 2))
    for df in (records.first_record_of_day(rows), days.employee_day_spine(rows, window), days.summary_day_rows(rows, Cutoffs())):
        lines = plan(df).splitlines()
        sorts = [n for n, line in enumerate(lines) if "SortAggregate" in line]
        first = min(n for n, line in enumerate(lines) if "HashAggregate" in line and "unlisted" in line)
        assert sorts and max(sorts) < first
