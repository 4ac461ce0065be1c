"""Row-by-row model of the summary and the calendar, for comparison on small inputs."""

import datetime as dt
import re
from collections import Counter

from musterbook.model import CODES, DESIGNATIONS, LEAVE_DAY_CODES, next_month

SENTINEL = "0000-00-00 00:00:00"
DAY = dt.timedelta(days=1)
LAST = chr(0x10FFFF)


def parse(text):
    match = re.match(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", text or "")
    try:
        return dt.datetime.strptime(match.group(), "%Y-%m-%d %H:%M:%S") if match else None
    except ValueError:
        return None


def punch_key(p):
    _, _, in_dev, in_loc, in_time, out_dev, out_loc, out_time = p
    texts = (in_time, in_dev, out_time, out_dev, in_loc, out_loc)
    return (parse(in_time) or dt.datetime.max, *[LAST if t is None else t for t in texts])


def code_key(code):
    return (CODES.index(code) if code in CODES else len(CODES), code is None, code or "")


def flatten(values):
    return ", ".join(v for v in values if v is not None)


def statuses(date, in_text, out_text):
    entered, left = parse(in_text), parse(out_text)
    late = None if entered is None else entered > dt.datetime.combine(date, dt.time(9, 20, 59))
    if out_text == SENTINEL:
        exit_ = "No exit"
    elif left is None:
        exit_ = None
    else:
        cut = dt.time(12, 45) if date.weekday() >= 5 else dt.time(4, 45)
        exit_ = "On time exit" if left >= dt.datetime.combine(date, cut) else "Early exit"
    return late, exit_


TIMES = {
    (False, "On time exit"): "On time",
    (True, "On time exit"): "Late entry",
    (False, "Early exit"): "Early exit",
    (True, "Early exit"): "Late entry & early exit",
    (False, "No exit"): "No exit",
    (True, "No exit"): "Late entry & No exit",
}


class Month:
    """One employee's month: records, window and overlay."""

    def __init__(self, tables, emp_id, month, as_of, leave_first, master, placeholder):
        self.end = min(next_month(month) - DAY, as_of - DAY)
        inside = lambda d: month <= d < next_month(month)
        self.leave = [r for r in tables["leave"] if r[0] == emp_id and inside(r[1])]
        self.punches = [r for r in tables["attend"] if r[0] == emp_id and inside(r[1])]
        dates = {r[1] for r in self.leave + self.punches}
        self.recorded = bool(dates)
        if not dates and placeholder:
            dates = {month}
        first, last = month, self.end
        if master is not None:
            first = max(master[5], month)
            if master[6] != "A":
                last = max(dates) if dates else None
        self.window = set()
        if last is not None:
            self.window = {first + DAY * n for n in range(max((last - first).days + 1, 0))}
        self.dates = sorted(dates | self.window)
        self.holidays, self.leave_first = set(tables["holidays"]), leave_first

    def first_code(self, date):
        leave = sorted((r[2] for r in self.leave if r[1] == date), key=code_key)
        punched = ["P"] if any(p[1] == date for p in self.punches) else []
        codes = leave + punched if self.leave_first else punched + leave
        return codes[0] if codes else None

    def code(self, date):
        first = self.first_code(date)
        if first == "EL":
            return "EL"
        if date.isoweekday() == 7 or (date in self.holidays and date in self.window):
            return "H"
        return first or "A"

    def texts(self, date, distinct):
        punches = sorted((p for p in self.punches if p[1] == date), key=punch_key)
        if distinct:
            punches = list({(p[2], p[4], p[5], p[7]): p for p in punches}.values())
        return {
            name: flatten(p[i] for p in punches)
            for name, i in {"in_time": 4, "out_time": 7, "in_location": 3, "out_location": 6}.items()
        }


def summary(tables, month, as_of, division="All", cat=None, leave_first=True, placeholders="default"):
    if placeholders == "default":
        placeholders = None if division == "All" else "active"
    out = []
    for master in tables["emp"]:
        if division not in ("All", None) and master[3] != division or cat not in (None, master[4]):
            continue
        listed = placeholders == "any" or (placeholders == "active" and master[6] == "A")
        m = Month(tables, master[0], month, as_of, leave_first, master, listed)
        if master[5] > m.end or not (m.recorded or listed):
            continue
        counts = Counter()
        for date in m.dates:
            late, _ = statuses(date, m.texts(date, True)["in_time"], None)
            code = m.code(date)
            code = "Late" if code == "P" and late else code
            counts[code if code in CODES else "other"] += 1
        total = sum(counts.values())
        row = {"emp_id": master[0], "emp_name": master[1], "designation": master[2], "division": master[3]}
        row |= {c: counts[c] for c in [*CODES, "other"]}
        out.append(row | {"present_days": total - counts["A"], "total_days": total})
    return sorted(out, key=lambda r: r["emp_id"])


def calendar(tables, month, as_of, leave_first=True):
    masters = {m[0]: m for m in tables["emp"]}
    ids = set(masters) | {r[0] for r in tables["leave"] + tables["attend"]}
    out = []
    for emp_id in sorted(ids):
        master = masters.get(emp_id)
        m = Month(tables, emp_id, month, as_of, leave_first, master, True)
        if not m.recorded and (master is None or master[6] != "A" or master[5] > m.end):
            continue
        for date in m.dates:
            texts, code = m.texts(date, False), m.code(date)
            late, exit_ = statuses(date, texts["in_time"], texts["out_time"])
            time = TIMES.get((late, exit_)) if code == "P" else None
            clock = {
                k: parse(texts[k]).strftime("%I:%M %p") if parse(texts[k]) else None
                for k in ("in_time", "out_time")
            }
            out.append(
                (emp_id, *((master[1], master[2], master[3]) if master else (None,) * 3), date, code, time,
                 clock["in_time"], texts["in_location"] or None, clock["out_time"], texts["out_location"] or None)
            )
    return out


def rank(designation):
    return DESIGNATIONS.index(designation) + 1 if designation in DESIGNATIONS else None


def is_leave(code):
    return code in LEAVE_DAY_CODES
