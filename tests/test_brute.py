"""Summary and calendar against the row-by-row model, on random and on skewed tables."""

import datetime as dt
import random

import pytest

import brute
from factories import day, person, punch
from musterbook.model import CODES, NO_EXIT_TEXT, month_start
from musterbook.operators.counts import status_pivot
from musterbook.plans.calendar import employee_calendar
from musterbook.plans.summary import COUNT_COLUMNS, monthly_summary, summary_all_months, summary_days

START = dt.date(2023, 11, 20)


def random_tables(seed, people=40, days=110, hot=0):
    rng = random.Random(seed)
    ids = [f"{n:08d}" for n in range(people)]
    emp = [
        person(
            i,
            rng.choice([dt.date(2020, 1, 1)] * 4 + [START + dt.timedelta(days=rng.randrange(days))]),
            rng.choice("AAAI"),
            rng.choice(["Surgery", "Medicine", "Pathology"]),
            rng.choice(["Faculty", "Other"]),
            rng.choice(["Professor", "Tutor", "Visiting Fellow"]),
        )
        for i in ids[:-2]
    ]
    odd = [None, "", "never", NO_EXIT_TEXT, "2024-13-01 09:00:00", "2024-1-5 9:00"]

    def moment():
        return f"{rng.choice([4, 8, 9, 12, 17]):02d}:{rng.choice([0, 20, 21, 44, 45]):02d}:{rng.choice([0, 59]):02d}"

    attend, leave = [], []
    for n in range(people * 40):
        date = START + dt.timedelta(days=rng.randrange(days))
        emp_id = ids[-1] if n < hot else rng.choice(ids[: people - people // 5] + ids[-1:])
        if n < hot:
            date = day(16)
        if rng.random() < 0.75:
            row = punch(
                emp_id, date,
                rng.choice(odd) if rng.random() < 0.1 else moment(),
                rng.choice(odd) if rng.random() < 0.3 else moment(),
                rng.choice(["D1", "D2", None]), rng.choice(["D1", "D2", None]),
                rng.choice(["Gate A", "Gate B", None, ""]), rng.choice(["Gate A", None]),
            )
            attend += [row] * rng.choice([1, 1, 1, 2])
        else:
            leave.append((emp_id, date, rng.choice(["CL", "EL", "SL", "ML", "RH", "O", "T", "WFH", "XX", "P", "A", "H", None])))
    holidays = [START + dt.timedelta(days=rng.randrange(days)) for _ in range(12)] * 2
    return {"emp": emp, "attend": attend, "leave": leave, "holidays": holidays}


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["emp_id"])


@pytest.fixture(scope="module", params=[1, 2])
def both(request, make_tables):
    data = random_tables(request.param, hot=500 if request.param == 2 else 0)
    return data, make_tables(**data)


@pytest.mark.parametrize(
    "month, as_of, options",
    [
        (day(1), dt.date(2024, 2, 1), {"division": None}),
        (day(1), dt.date(2024, 1, 17), {"division": None, "leave_first": False, "placeholders": "any"}),
        (dt.date(2023, 12, 1), dt.date(2024, 1, 5), {"division": "All", "cat": "Faculty"}),
        (day(1), dt.date(2024, 1, 31), {"division": "Surgery", "cat": "Other"}),
        (day(1, 2), dt.date(2024, 3, 2), {"division": "Medicine", "cat": "Faculty", "leave_first": False}),
    ],
)
def test_summary_equals_model(both, month, as_of, options):
    data, t = both
    expected = brute.summary(data, month, as_of, **options)
    assert rows(monthly_summary(t, month, as_of, **options)) == expected
    pivot = rows(status_pivot(summary_days(t, month, as_of, **options)))
    assert pivot == [{k: v for k, v in r.items() if not k.endswith("_days")} for r in expected]


@pytest.mark.parametrize("leave_first", [True, False])
@pytest.mark.parametrize("as_of", [dt.date(2024, 2, 1), dt.date(2024, 1, 17)])
def test_calendar_equals_model(both, as_of, leave_first):
    data, t = both
    got = sorted(map(tuple, employee_calendar(t, day(1), as_of, leave_first=leave_first).collect()), key=repr)
    assert got == sorted(brute.calendar(data, day(1), as_of, leave_first), key=repr)


def test_single_employee_is_a_slice_of_all(both):
    _, t = both
    whole = employee_calendar(t, day(1), dt.date(2024, 2, 1))
    for emp_id in ("00000000", "00000039"):
        own = employee_calendar(t, day(1), dt.date(2024, 2, 1), emp_id)
        assert sorted(own.collect(), key=repr) == sorted(whole.filter(whole.emp_id == emp_id).collect(), key=repr)


def test_all_months_equal_single_months(both):
    data, t = both
    as_of = dt.date(2024, 2, 20)
    for placeholders in (None, "active"):
        table = summary_all_months(t, as_of, START, placeholders=placeholders).collect()
        for month in (dt.date(2023, 11, 1), dt.date(2023, 12, 1), day(1), day(1, 2)):
            expected = brute.summary(data, month, as_of, None, placeholders=placeholders)
            got = [r.asDict() for r in table if r["month"] == month]
            got = sorted(({k: v for k, v in r.items() if k not in ("month", "cat")} for r in got), key=lambda r: r["emp_id"])
            assert got == expected
        assert {r["month"] for r in table} <= {month_start(START), dt.date(2023, 12, 1), day(1), day(1, 2)}


def test_counts_add_up(both):
    _, t = both
    for r in monthly_summary(t, day(1), dt.date(2024, 2, 1), None).collect():
        assert sum(r[c] for c in [*CODES, "other"]) == r["total_days"]
        assert set(COUNT_COLUMNS) <= set(r.asDict())
