"""Rows of the attendance tables for tests."""

import datetime as dt


def day(number: int, month: int = 1, year: int = 2024) -> dt.date:
    return dt.date(year, month, number)


def person(emp_id, created=dt.date(2020, 1, 1), status="A", division="Surgery", cat="Faculty", level="Professor"):
    return (emp_id, f"Name {emp_id}", level, division, cat, created, status)


def punch(emp_id, date, in_time, out_time, in_dev="D1", out_dev="D1", in_loc="Gate A", out_loc="Gate B"):
    """Times given as HH:MM:SS on the punch's date; other texts are taken as they are."""

    def text(value):
        return f"{date} {value}" if value is not None and len(value) == 8 else value

    return (emp_id, date, in_dev, in_loc, text(in_time), out_dev, out_loc, text(out_time))
