"""SQL counterpart of each registered query, written relationally: full outer joins,
generated day series and ordered aggregates, over the driver's raw tables."""

from __future__ import annotations

BASE = """
emp AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS emp_id, c_name AS emp_name,
         (['Professor', 'Associate Professor', 'Statistician', 'Assistant Professor', 'Senior Resident',
           'Junior Resident', 'Tutor', 'Other', 'Visiting Fellow'])[c_custkey % 9 + 1] AS designation,
         n_name AS division,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Faculty' WHEN 'MACHINERY' THEN 'Senior Resident'
              WHEN 'AUTOMOBILE' THEN 'Junior Resident' ELSE 'Other' END AS cat,
         CASE WHEN c_custkey % 40 = 13 THEN DATE '2024-02-15'
              WHEN c_custkey % 6 = 5 THEN DATE '2024-01-10' ELSE DATE '1994-01-01' END AS creation_date,
         CASE WHEN c_custkey % 11 = 4 THEN 'I' ELSE 'A' END AS active_status
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
visits AS (
  SELECT user_id, CAST(ts AS DATE) AS log_date, CASE WHEN hour(ts) < 20 THEN 'D1' ELSE 'D2' END AS device,
         min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(value) AS top,
         bool_or(event_type = 'error') AS failed
  FROM events WHERE event_type <> 'signup' GROUP BY 1, 2, 3),
visit_copies AS (SELECT * FROM visits UNION ALL SELECT * FROM visits WHERE n = 1 AND top > 15),
attend AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS emp_id, log_date, device AS in_device_id,
         CASE device WHEN 'D1' THEN 'Gate A' ELSE 'Gate B' END AS in_location,
         strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS in_time, device AS out_device_id,
         CASE WHEN n > 1 THEN CASE device WHEN 'D1' THEN 'Gate A' ELSE 'Gate B' END END AS out_location,
         CASE WHEN n > 1 THEN strftime(last_ts, '%Y-%m-%d %H:%M:%S')
              WHEN NOT failed THEN '0000-00-00 00:00:00' END AS out_time
  FROM visit_copies
  UNION ALL
  SELECT CAST(90000000 + s_suppkey AS VARCHAR), DATE '2024-01-03' + CAST(s_suppkey % 25 AS INTEGER), 'D1', 'Gate A',
         strftime(DATE '2024-01-03' + CAST(s_suppkey % 25 AS INTEGER), '%Y-%m-%d 09:15:00'), 'D1', NULL, NULL
  FROM supplier),
leaves AS (
  SELECT lpad(CAST(u AS VARCHAR), 8, '0') AS emp_id, d AS date,
         (['CL', 'EL', 'SL', 'ML', 'RH', 'O', 'T', 'WFH', 'STUDY', NULL])[k % 10 + 1] AS leave_type
  FROM (SELECT user_id AS u, CAST(ts AS DATE) AS d, min(event_id) AS k
        FROM events WHERE event_type = 'signup' GROUP BY 1, 2
        UNION ALL
        SELECT o_custkey, CAST(o_orderdate AS DATE), min(o_orderkey)
        FROM orders GROUP BY 1, 2
        UNION ALL
        SELECT 90000000 + s_suppkey, DATE '2024-01-03' + CAST(s_suppkey % 20 AS INTEGER), s_suppkey FROM supplier)),
hol AS (
  SELECT CAST(ts AS DATE) AS hol_date FROM events WHERE day(ts) IN (1, 15, 26)
  UNION ALL
  SELECT CAST(o_orderdate AS DATE) FROM orders WHERE month(o_orderdate) = 12 AND day(o_orderdate) = 25)
"""

CODES = ["P", "Late", "A", "H", "RH", "CL", "EL", "SL", "ML", "O", "T"]
CODE_LIST = "['P', 'Late', 'A', 'H', 'RH', 'CL', 'EL', 'SL', 'ML', 'O', 'T']"
NAMES = "emp_name, designation, division"
CODE_ORDER = f"precedence, nullif(list_position({CODE_LIST}, attendance), 0) NULLS LAST, attendance NULLS LAST"
PUNCH_ORDER = (
    "in_ts NULLS LAST, in_time NULLS LAST, in_device_id NULLS LAST, out_time NULLS LAST, "
    "out_device_id NULLS LAST, in_location NULLS LAST, out_location NULLS LAST"
)


def stamp(text: str) -> str:
    return f"try_strptime(left({text}, 19), '%Y-%m-%d %H:%M:%S')"


def late(ts: str, date: str = "date") -> str:
    return f"({ts} > {date} + INTERVAL '9 hours 20 minutes 59 seconds')"


def entry_case(ts: str) -> str:
    return f"CASE WHEN {late(ts)} THEN 'Late entry' WHEN NOT {late(ts)} THEN 'On time entry' END"


def exit_case(text: str) -> str:
    cut = (
        "date + CASE WHEN dayofweek(date) IN (0, 6) THEN INTERVAL '12 hours 45 minutes' "
        "ELSE INTERVAL '4 hours 45 minutes' END"
    )
    ts = stamp(text)
    return (
        f"CASE WHEN {text} = '0000-00-00 00:00:00' THEN 'No exit' WHEN {ts} >= {cut} THEN 'On time exit' "
        f"WHEN {ts} < {cut} THEN 'Early exit' END"
    )


TIME_CASE = """CASE WHEN attendance <> 'P' THEN NULL
  WHEN entry = 'On time entry' AND exit = 'On time exit' THEN 'On time'
  WHEN entry = 'Late entry' AND exit = 'On time exit' THEN 'Late entry'
  WHEN entry = 'On time entry' AND exit = 'Early exit' THEN 'Early exit'
  WHEN entry = 'Late entry' AND exit = 'Early exit' THEN 'Late entry & early exit'
  WHEN entry = 'On time entry' AND exit = 'No exit' THEN 'No exit'
  WHEN entry = 'Late entry' AND exit = 'No exit' THEN 'Late entry & No exit' END"""


def with_base(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *ctes]) + "\n" + select


def records(leave_first: bool = True, first: str | None = "2024-01-01", until: str = "2024-02-01") -> str:
    """CTE ``rec``: leave and punch rows of a date range (None: all)."""
    a, b = (0, 1) if leave_first else (1, 0)
    where = f"WHERE date >= DATE '{first}' AND date < DATE '{until}'" if first else ""
    return f"""
rec AS (
  SELECT *, {stamp('in_time')} AS in_ts, CAST(date_trunc('month', date) AS DATE) AS month FROM (
    SELECT emp_id, date, leave_type AS attendance, {a} AS precedence, NULL::VARCHAR AS in_device_id,
           NULL::VARCHAR AS in_time, NULL::VARCHAR AS in_location, NULL::VARCHAR AS out_device_id,
           NULL::VARCHAR AS out_time, NULL::VARCHAR AS out_location FROM leaves
    UNION ALL
    SELECT emp_id, log_date, 'P', {b}, in_device_id, in_time, in_location, out_device_id, out_time, out_location
    FROM attend) {where})"""


RECORD_COLUMNS = (
    "emp_id, date, attendance, precedence, in_device_id, in_time, in_location, "
    "out_device_id, out_time, out_location"
)

COLLAPSE = f"""
flat AS (
  SELECT emp_id, date, first(attendance ORDER BY {CODE_ORDER}) AS attendance,
         coalesce(string_agg(in_time, ', ' ORDER BY {PUNCH_ORDER}), '') AS in_time,
         coalesce(string_agg(out_time, ', ' ORDER BY {PUNCH_ORDER}), '') AS out_time,
         coalesce(string_agg(in_location, ', ' ORDER BY {PUNCH_ORDER}), '') AS in_location,
         coalesce(string_agg(out_location, ', ' ORDER BY {PUNCH_ORDER}), '') AS out_location
  FROM rec GROUP BY emp_id, date)"""

COLLAPSE_DISTINCT = f"""
flat AS (
  SELECT emp_id, date, first(attendance ORDER BY {CODE_ORDER}) AS attendance,
         coalesce(string_agg(in_time, ', ' ORDER BY {PUNCH_ORDER}), '') AS in_time,
         coalesce(string_agg(out_time, ', ' ORDER BY {PUNCH_ORDER}), '') AS out_time
  FROM (SELECT DISTINCT emp_id, date, attendance, precedence, in_device_id, in_time, out_device_id, out_time,
               in_ts, NULL::VARCHAR AS in_location, NULL::VARCHAR AS out_location FROM rec)
  GROUP BY emp_id, date)"""

TIMED = f"""
timed AS (
  SELECT *, {TIME_CASE} AS time FROM (
    SELECT *, {entry_case(stamp('in_time'))} AS entry, {exit_case('out_time')} AS exit FROM flat))"""


def day_ctes(
    as_of: str,
    leave_first: bool = True,
    placeholders: str | None = "active",
    months: str = "SELECT DATE '2024-01-01' AS month",
    first: str = "2024-01-01",
    chosen: str = "TRUE",
) -> list[str]:
    """CTEs up to ``days``: one classified row per employee-day of a summary."""
    status = "AND active_status = 'A'" if placeholders == "active" else ""
    add = f"""UNION ALL BY NAME
  SELECT emp_id, m.month, m.month AS date, 9 AS precedence FROM chosen, ({months}) m
  WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.emp_id = chosen.emp_id AND r.month = m.month) {status}"""
    wend = f"least(last_day(r.month), DATE '{as_of}' - 1)"
    return [
        records(leave_first, first),
        f"chosen AS (SELECT * FROM emp WHERE {chosen})",
        f"recs AS (SELECT * FROM rec {add if placeholders else ''})",
        f"""
bounds AS (
  SELECT e.emp_id, r.month, greatest(e.creation_date, r.month) AS min_date,
         CASE WHEN e.active_status = 'A' THEN {wend} ELSE max(r.date) END AS max_date
  FROM recs r JOIN chosen e ON e.emp_id = r.emp_id
  WHERE e.creation_date <= {wend}
  GROUP BY e.emp_id, r.month, e.creation_date, e.active_status)""",
        """
spine AS (
  SELECT emp_id, month, CAST(unnest(generate_series(CAST(min_date AS TIMESTAMP), CAST(max_date AS TIMESTAMP),
         INTERVAL 1 DAY)) AS DATE) AS date FROM bounds)""",
        """
merged AS (
  SELECT r.attendance, r.precedence, r.in_time, r.in_ts, emp_id, month, date, s.here IS NOT NULL AS in_window
  FROM (SELECT recs.* FROM recs JOIN bounds USING (emp_id, month)) r
  FULL JOIN (SELECT *, TRUE AS here FROM spine) s USING (emp_id, month, date))""",
        """
coded AS (
  SELECT *, CASE WHEN attendance = 'EL' THEN 'EL'
                 WHEN dayofweek(date) = 0 OR (in_window AND date IN (SELECT hol_date FROM hol)) THEN 'H'
                 WHEN attendance IS NULL THEN 'A' ELSE attendance END AS code FROM merged)""",
        f"""
collapsed AS (
  SELECT emp_id, month, date, first(code ORDER BY {CODE_ORDER}) AS code,
         first(in_ts ORDER BY in_ts NULLS LAST) AS first_in FROM coded GROUP BY emp_id, month, date)""",
        f"""
days AS (
  SELECT emp_id, {NAMES}, cat, month, date,
         CASE WHEN code = 'P' AND {late('first_in')} THEN 'Late' ELSE code END AS attendance
  FROM collapsed JOIN emp USING (emp_id))""",
    ]


COUNTS = ", ".join(f"count(*) FILTER (attendance = '{c}') AS \"{c}\"" for c in CODES)
OTHER = f"count(*) FILTER (NOT list_contains({CODE_LIST}, attendance)) AS other"
TOTALS = "count(*) FILTER (attendance <> 'A') AS present_days, count(*) AS total_days"


def summary_select(keys: str = f"emp_id, {NAMES}", source: str = "days") -> str:
    return f"SELECT {keys}, {COUNTS}, {OTHER}, {TOTALS} FROM {source} GROUP BY {keys}"


EACH = day_ctes("2024-02-01")
ALL = day_ctes("2024-02-01", placeholders=None)


def summary_cte(ctes: list[str]) -> list[str]:
    return [*ctes, f"summary AS ({summary_select()})"]


def calendar_ctes(as_of: str, leave_first: bool = True) -> list[str]:
    wend = f"least(DATE '2024-01-31', DATE '{as_of}' - 1)"
    return [
        records(leave_first),
        COLLAPSE,
        TIMED,
        f"""
people AS (
  SELECT emp_id, max(date) AS last_record, TRUE AS recorded FROM rec GROUP BY emp_id
  UNION ALL
  SELECT emp_id, NULL, FALSE FROM emp
  WHERE active_status = 'A' AND creation_date <= {wend} AND emp_id NOT IN (SELECT emp_id FROM rec))""",
        f"""
bounds AS (
  SELECT emp_id, greatest(DATE '2024-01-01', creation_date) AS min_date, recorded,
         CASE WHEN active_status = 'I' THEN last_record ELSE {wend} END AS max_date
  FROM people LEFT JOIN emp USING (emp_id))""",
        """
spine AS (
  SELECT emp_id, CAST(unnest(generate_series(CAST(min_date AS TIMESTAMP), CAST(max_date AS TIMESTAMP),
         INTERVAL 1 DAY)) AS DATE) AS date FROM bounds)""",
        """
wanted AS (
  SELECT emp_id, date, bool_or(inside) AS in_window FROM (
    SELECT emp_id, date, TRUE AS inside FROM spine
    UNION ALL SELECT emp_id, DATE '2024-01-01', FALSE FROM people WHERE NOT recorded
    UNION ALL SELECT emp_id, date, FALSE FROM flat) GROUP BY emp_id, date)""",
        f"""
calendar AS (
  SELECT emp_id, {NAMES}, date, code AS attendance, CASE WHEN code = 'P' THEN time END AS time,
         strftime({stamp('in_time')}, '%I:%M %p') AS in_time, nullif(in_location, '') AS in_location,
         strftime({stamp('out_time')}, '%I:%M %p') AS out_time, nullif(out_location, '') AS out_location
  FROM (SELECT *, CASE WHEN attendance = 'EL' THEN 'EL'
                       WHEN dayofweek(date) = 0 OR (in_window AND date IN (SELECT hol_date FROM hol)) THEN 'H'
                       WHEN attendance IS NULL THEN 'A' ELSE attendance END AS code
        FROM wanted LEFT JOIN timed USING (emp_id, date)) LEFT JOIN emp USING (emp_id))""",
    ]


CALENDAR = calendar_ctes("2024-02-01")

GRID = ", ".join(
    [
        f"max(CASE WHEN dayofweek(date) = {k - 1} THEN {f} END) AS {f}_{k}"
        for f in ["attendance", "time", "in_time", "out_time", "in_location", "out_location"]
        for k in range(1, 8)
    ]
    + [f"max(CASE WHEN dayofweek(date) = {k - 1} THEN CAST(day(date) AS INTEGER) END) AS day_{k}" for k in range(1, 8)]
)


def epi(date: str) -> str:
    wednesday = f"({date} + CAST(3 - dayofweek({date}) AS INTEGER))"
    return f"CAST((dayofyear({wednesday}) - 1) // 7 + 1 AS INTEGER)"


LABEL = """CASE leave_type WHEN 'CL' THEN 'Casual Leave' WHEN 'EL' THEN 'Earned Leave' WHEN 'SL' THEN 'Special Leave'
  WHEN 'ML' THEN 'Medical Leave' WHEN 'RH' THEN 'Restricted Holiday' WHEN 'O' THEN 'Other' WHEN 'T' THEN 'Tour' END"""
LABELS = {
    "CL": "Casual Leave", "EL": "Earned Leave", "SL": "Special Leave", "ML": "Medical Leave",
    "RH": "Restricted Holiday", "O": "Other", "T": "Tour",
}
RANK = """CASE designation WHEN 'Professor' THEN 1 WHEN 'Associate Professor' THEN 2 WHEN 'Statistician' THEN 3
  WHEN 'Assistant Professor' THEN 4 WHEN 'Senior Resident' THEN 5 WHEN 'Junior Resident' THEN 6
  WHEN 'Tutor' THEN 7 WHEN 'Other' THEN 8 END"""


def window_cte(as_of: str) -> str:
    wend = f"least(DATE '2024-01-31', DATE '{as_of}' - 1)"
    return f"""
win AS (
  SELECT emp_id, greatest(creation_date, DATE '2024-01-01') AS min_date,
         CASE WHEN active_status = 'A' THEN {wend} ELSE last_record END AS max_date
  FROM emp LEFT JOIN (SELECT emp_id, max(date) AS last_record FROM rec GROUP BY emp_id) USING (emp_id)
  WHERE creation_date <= {wend}),
win_days AS (
  SELECT emp_id, CAST(unnest(generate_series(CAST(min_date AS TIMESTAMP), CAST(max_date AS TIMESTAMP),
         INTERVAL 1 DAY)) AS DATE) AS date FROM win)"""


OPEN_SPINE = [
    records(),
    window_cte("2024-01-20"),
    f"""
firsts AS (SELECT emp_id, date, first(attendance ORDER BY {CODE_ORDER}) AS attendance FROM rec GROUP BY 1, 2),
spine_days AS (
  SELECT emp_id, date, attendance, w.here IS NOT NULL AS in_window
  FROM firsts FULL JOIN (SELECT *, TRUE AS here FROM win_days) w USING (emp_id, date)),
marked AS (
  SELECT *, CASE WHEN dayofweek(date) = 0 OR (in_window AND date IN (SELECT hol_date FROM hol)) THEN 'H' END AS holiday
  FROM spine_days)""",
]

NAMED_DAYS = f"""
named AS (
  SELECT emp_id, date, {NAMES} FROM leaves LEFT JOIN emp USING (emp_id)
  UNION ALL
  SELECT emp_id, log_date, NULL, NULL, NULL FROM attend)"""


def filled(column: str, upwards: bool) -> str:
    by_date = "PARTITION BY emp_id ORDER BY date"
    down = f"last_value({column} IGNORE NULLS) OVER ({by_date} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    up = f"first_value({column} IGNORE NULLS) OVER ({by_date} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"coalesce({down}{', ' + up if upwards else ''}) AS {column}"


def fill_sql(upwards: bool) -> str:
    """Of each date the least named row, by all columns in order, is carried."""
    columns = ["emp_name", "designation", "division"]
    order = ", ".join(f"{c} NULLS LAST" for c in columns)
    known = (
        f"known AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY emp_id, date ORDER BY {order}) = 1)"
    )
    carried = f"carried AS (SELECT emp_id, date, {', '.join(filled(c, upwards) for c in columns)} FROM known)"
    shown = ", ".join(f"coalesce(n.{c}, c.{c}) AS {c}" for c in columns)
    return with_base(
        [NAMED_DAYS, known, carried], f"SELECT n.emp_id, n.date, {shown} FROM named n LEFT JOIN carried c USING (emp_id, date)"
    )


ONE = "emp_id = '00000007'"
NAMED_CODES = with_base(
    EACH, f"SELECT emp_id, attendance AS code, count(*) AS n FROM days WHERE NOT list_contains({CODE_LIST}, attendance) GROUP BY 1, 2")
JAN = "date >= DATE '2024-01-01' AND date < DATE '2024-02-01'"
DETAILS = "emp_name, designation, division, cat"

ORACLE: dict[str, str] = {
    # Scans, sources, sinks
    "attend_details": with_base(
        [], f"SELECT attend.*, {DETAILS} FROM attend JOIN emp USING (emp_id) WHERE cat = 'Faculty' AND log_date "
        "BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"),
    "leave_details": with_base(
        [], f"SELECT leaves.*, {DETAILS} FROM leaves JOIN emp USING (emp_id) WHERE cat = 'Other' AND division IN "
        "('NATION_1', 'NATION_3', 'NATION_8') AND date BETWEEN DATE '1995-01-01' AND DATE '2024-01-31'"),
    "employee_attend_details": with_base(
        [], f"SELECT attend.*, {DETAILS} FROM attend LEFT JOIN emp USING (emp_id) WHERE log_date "
        "BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"),
    "employee_leave_details": with_base(
        [], f"SELECT leaves.*, {DETAILS} FROM leaves LEFT JOIN emp USING (emp_id) WHERE {JAN}"),
    "employee_lookup": with_base([], f"SELECT emp_id, {NAMES} FROM emp WHERE active_status = 'A'"),
    "distinct_divisions": with_base(
        [], "SELECT 0 AS ord, 'All' AS division UNION ALL SELECT DISTINCT 1, division FROM emp ORDER BY ord, division"),
    "distinct_holidays": with_base([], "SELECT DISTINCT hol_date AS date, 'H' AS holiday FROM hol ORDER BY 1"),
    "category_choices": with_base(
        [], "SELECT DISTINCT CASE cat WHEN 'Faculty' THEN 1 WHEN 'Senior Resident' THEN 2 "
        "WHEN 'Junior Resident' THEN 3 ELSE 4 END AS ord, cat FROM emp ORDER BY 1"),
    "last_log_date": with_base([], "SELECT max(log_date) AS last_date FROM attend"),
    "json_record_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, "
    "json_extract_string(props, '$.note') AS note FROM events",
    "summary_csv": with_base(day_ctes("2024-02-01", placeholders=None, chosen="cat = 'Other'"), summary_select()),
    # Projections, filters, predicates
    "dedup_columns": with_base(
        [], f"SELECT leaves.*, {DETAILS}, creation_date, active_status FROM leaves LEFT JOIN emp USING (emp_id)"),
    "month_filter": with_base([], "SELECT * FROM leaves WHERE date_trunc('month', date) = DATE '2024-01-01'"),
    "division_cat_filter": with_base([], "SELECT * FROM emp WHERE division = 'NATION_3' AND cat = 'Faculty'"),
    "eligible_employees": with_base([], "SELECT * FROM emp WHERE NOT creation_date > DATE '2024-01-31'"),
    "leave_day_filter": with_base(
        [], "SELECT emp_id, date, leave_type AS attendance FROM leaves "
        "WHERE leave_type IN ('SL', 'RH', 'CL', 'T', 'O', 'EL', 'ML')"),
    # Joins
    "leave_emp_join": with_base([], f"SELECT leaves.*, {DETAILS} FROM leaves JOIN emp USING (emp_id)"),
    "attend_emp_join": with_base([], f"SELECT attend.*, {DETAILS} FROM attend JOIN emp USING (emp_id)"),
    "full_outer_raw": with_base(
        [], f"SELECT leaves.*, {DETAILS} FROM leaves FULL OUTER JOIN emp ON leaves.emp_id = emp.emp_id"),
    "employees_without_records": with_base(
        [records()], f"SELECT emp_id, {NAMES} FROM emp WHERE active_status = 'A' "
        "AND emp_id NOT IN (SELECT emp_id FROM rec)"),
    "holidays_in_window": with_base(
        [records(), window_cte("2024-02-01")],
        "SELECT win.emp_id, h.hol_date AS date FROM win JOIN (SELECT DISTINCT hol_date FROM hol) h "
        "ON h.hol_date BETWEEN win.min_date AND win.max_date"),
    "employee_day_spine": with_base(OPEN_SPINE, "SELECT * FROM spine_days"),
    "holiday_overlay": with_base(OPEN_SPINE, "SELECT emp_id, date, attendance, holiday FROM marked"),
    "month_frame_join": with_base(
        OPEN_SPINE, "SELECT emp_id, date, attendance FROM (SELECT DISTINCT emp_id FROM rec) CROSS JOIN "
        "(SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) "
        "AS date) LEFT JOIN firsts USING (emp_id, date)"),
    "no_record_calendar": with_base(
        CALENDAR, "SELECT emp_id, date, attendance FROM calendar WHERE emp_id NOT IN (SELECT emp_id FROM rec)"),
    # Aggregations
    "day_collapse": with_base([records(first=None), COLLAPSE], "SELECT * FROM flat"),
    "day_collapse_distinct": with_base([records(first=None), COLLAPSE_DISTINCT], "SELECT * FROM flat"),
    "employee_window": with_base([records(), window_cte("2024-01-20")], "SELECT * FROM win"),
    "summary_days": with_base(EACH, f"SELECT emp_id, {NAMES}, date, attendance FROM days"),
    "status_counts": with_base(
        EACH, f"SELECT emp_id, {NAMES}, attendance, count(*) AS n FROM days GROUP BY emp_id, {NAMES}, attendance"),
    "status_pivot": with_base(
        EACH, f"SELECT emp_id, {NAMES}, {COUNTS}, {OTHER} FROM days GROUP BY emp_id, {NAMES}"),
    "day_totals": with_base(EACH, f"SELECT emp_id, {TOTALS} FROM days GROUP BY emp_id"),
    "time_status_footer": with_base(
        CALENDAR, "SELECT emp_id, time, count(*) AS n, '**' || count(*) || '** days ' || time AS label "
        "FROM calendar WHERE time IS NOT NULL GROUP BY emp_id, time"),
    "time_status_text": with_base(
        CALENDAR, "SELECT emp_id, string_agg('**' || n || '** days ' || time, ', ' ORDER BY time) AS footer FROM "
        "(SELECT emp_id, time, count(*) AS n FROM calendar WHERE time IS NOT NULL GROUP BY 1, 2) GROUP BY emp_id"),
    "leave_tally_long": with_base(
        [], f"SELECT emp_id, CAST(year(date) AS INTEGER) AS year, {LABEL} AS label, count(*) AS n "
        "FROM leaves GROUP BY 1, 2, 3"),
    "leave_tally": with_base(
        [], "SELECT emp_id, CAST(year(date) AS INTEGER) AS year, "
        + ", ".join(f"count(*) FILTER (leave_type = '{k}') AS \"{v}\"" for k, v in LABELS.items())
        + " FROM leaves GROUP BY 1, 2 ORDER BY emp_id, year DESC"),
    "calendar_grid": with_base(
        [*CALENDAR, """
framed AS (
  SELECT * FROM (SELECT DISTINCT emp_id FROM calendar) CROSS JOIN
    (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date)
  LEFT JOIN calendar USING (emp_id, date))"""],
        f"SELECT emp_id, date - CAST(dayofweek(date) AS INTEGER) AS week_start, {epi('min(date)')} AS week, {GRID} "
        "FROM framed GROUP BY 1, 2"),
    "empty_code_columns": with_base(
        summary_cte(ALL),
        " UNION ALL ".join(
            f"SELECT '{c}' AS code, CAST(coalesce(sum(\"{c}\"), 0) AS BIGINT) AS total, "
            f"{'TRUE' if c == 'A' else f'coalesce(sum(\"{c}\"), 0) <> 0'} AS shown FROM summary"
            for c in [*CODES, "other", "present_days", "total_days"])),
    "duplicate_punch_days": with_base(
        [], "SELECT emp_id, log_date, count(*) AS punches FROM attend GROUP BY 1, 2 HAVING count(*) > 1"),
    "distinct_rows": with_base(
        [records(first=None)], "SELECT DISTINCT emp_id, date, attendance, in_device_id, in_time, in_location, "
        "out_device_id, out_time, out_location FROM rec"),
    # Windows
    "fill_downup": fill_sql(True),
    "fill_down": fill_sql(False),
    "first_record_of_day": with_base(
        [records(False, None)], "SELECT emp_id, date, attendance FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY emp_id, date ORDER BY {CODE_ORDER}) AS rn FROM rec) WHERE rn = 1"),
    # Sorts
    "summary_ordered": with_base(
        summary_cte(EACH), f"SELECT *, {RANK} AS designation_rank FROM summary "
        "ORDER BY division, designation_rank NULLS LAST, emp_id"),
    # Set operations
    "unified_records": with_base([records(first=None)], f"SELECT {RECORD_COLUMNS} FROM rec"),
    "placeholder_union": with_base(
        [records()], f"SELECT {RECORD_COLUMNS} FROM rec UNION ALL SELECT emp_id, DATE '2024-01-01', NULL, 2, NULL, "
        "NULL, NULL, NULL, NULL, NULL FROM emp WHERE active_status = 'A' AND emp_id NOT IN (SELECT emp_id FROM rec)"),
    # Scalar functions
    "month_bounds": "SELECT month, CAST(unnest(generate_series(CAST(month AS TIMESTAMP), "
    "CAST(CASE WHEN DATE '2024-01-20' > last_day(month) THEN last_day(month) ELSE DATE '2024-01-19' END AS TIMESTAMP), "
    "INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) AS month FROM "
    "(SELECT o_orderdate AS ts FROM orders UNION ALL SELECT ts FROM events))",
    "days_stale": with_base(
        [], "SELECT max(log_date) AS last_date, CAST(date_diff('day', max(log_date), DATE '2024-01-31') AS INTEGER) "
        "AS days_stale, date_diff('day', max(log_date), DATE '2024-01-31') > 0 AS refresh_offered FROM attend"),
    "punch_parse": with_base(
        [records(first=None), COLLAPSE],
        f"SELECT emp_id, date, {stamp('in_time')} AS in_ts, {stamp('out_time')} AS out_ts FROM flat"),
    "clock_format": with_base(
        [], f"SELECT emp_id, in_time, strftime({stamp('in_time')}, '%I:%M %p') AS in_clock FROM attend"),
    "blank_to_null": with_base(
        [records(first=None), COLLAPSE], "SELECT emp_id, date, CASE WHEN out_location <> '' THEN out_location END AS place FROM flat"),
    "flatten_comma": with_base(
        [], "SELECT emp_id, in_time, concat_ws(', ', in_location, out_location) AS places FROM attend"),
    "emp_id_pad": "SELECT c_custkey, repeat('0', greatest(8 - length(CAST(c_custkey AS VARCHAR)), 0)) || c_custkey "
    "AS short_id, repeat('0', greatest(8 - length(c_name), 0)) || c_name AS long_id FROM customer",
    "epi_week": f"SELECT o_orderkey, date, {epi('date')} AS week FROM "
    "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)",
    "calendar_parts": "SELECT l_orderkey, l_linenumber, CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS wday, "
    "CAST(day(l_shipdate) AS INTEGER) AS day, CAST(month(l_shipdate) AS INTEGER) AS month, "
    "CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem",
    "leave_type_label": with_base([], f"SELECT *, {LABEL} AS label FROM leaves"),
    # Classification
    "entry_status": with_base([records(first=None), COLLAPSE_DISTINCT, TIMED], "SELECT emp_id, date, entry FROM timed"),
    "exit_status": with_base([records(first=None), COLLAPSE_DISTINCT, TIMED], "SELECT emp_id, date, exit FROM timed"),
    "time_status": with_base([records(first=None), COLLAPSE_DISTINCT, TIMED], "SELECT emp_id, date, time FROM timed"),
    "day_attendance": with_base(
        OPEN_SPINE, "SELECT emp_id, date, CASE WHEN attendance = 'EL' THEN 'EL' WHEN holiday = 'H' THEN 'H' "
        "WHEN attendance IS NULL THEN 'A' ELSE attendance END AS attendance FROM marked"),
    "late_override": with_base(
        [records(first=None), COLLAPSE_DISTINCT, TIMED],
        "SELECT emp_id, date, CASE WHEN attendance = 'P' AND entry = 'Late entry' THEN 'Late' ELSE attendance END "
        "AS attendance FROM timed"),
    "cell_class": with_base(
        CALENDAR, "SELECT emp_id, date, CASE WHEN attendance IN ('SL', 'RH', 'CL', 'T', 'O', 'EL', 'ML') THEN 'leave' "
        "WHEN attendance = 'A' THEN 'absent' WHEN time <> 'On time' THEN 'irregular' WHEN attendance = 'H' THEN 'holiday' "
        "WHEN attendance = 'P' THEN 'present' END AS cell_class FROM calendar"),
    "absence_flag": with_base(
        summary_cte(ALL), "SELECT emp_id, present_days <> total_days AS has_absence FROM summary"),
    # Composite jobs
    "monthly_summary": with_base(EACH, summary_select()),
    "monthly_summary_open": with_base(day_ctes("2024-01-20"), summary_select()),
    "monthly_summary_choice": with_base(
        day_ctes("2024-02-01", chosen="division = 'NATION_3' AND cat = 'Faculty'"), summary_select()),
    "monthly_summary_present_first": with_base(
        day_ctes("2024-01-20", leave_first=False, placeholders="any"), summary_select()),
    "employee_calendar": with_base(CALENDAR, "SELECT * FROM calendar"),
    "employee_calendar_present_first": with_base(calendar_ctes("2024-01-20", False), "SELECT * FROM calendar"),
    "division_register": with_base(
        day_ctes("2024-02-01", placeholders=None, chosen="cat = 'Other'"),
        f"SELECT * FROM ({summary_select()}) ORDER BY division, {RANK} NULLS LAST, emp_id"),
    "summary_all_months": with_base(
        day_ctes("2024-02-01", placeholders=None, first="1995-01-01"),
        summary_select(f"month, emp_id, {NAMES}, cat")),
    "summary_incremental": with_base(
        day_ctes("2024-02-01", placeholders=None, first="1995-01-01"),
        summary_select(f"month, emp_id, {NAMES}, cat")),
    "empty_summary_message": with_base(
        day_ctes("2024-02-01", chosen="division = 'NATION_3' AND cat = 'Visitor'"),
        "SELECT 'No Visitor in NATION_3 in Jan 2024' AS error WHERE NOT EXISTS (SELECT 1 FROM days)"),
    # One employee, stored tables, unlisted codes by name
    "employee_attend_details_one": with_base(
        [], f"SELECT attend.*, {DETAILS} FROM attend LEFT JOIN emp USING (emp_id) WHERE {ONE} AND log_date "
        "BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"),
    "employee_leave_details_one": with_base(
        [], f"SELECT leaves.*, {DETAILS} FROM leaves LEFT JOIN emp USING (emp_id) WHERE {ONE} AND date "
        "BETWEEN DATE '1995-01-01' AND DATE '2024-01-31'"),
    "employee_lookup_one": with_base([], f"SELECT emp_id, {NAMES} FROM emp WHERE {ONE}"),
    "employee_calendar_one": with_base(CALENDAR, f"SELECT * FROM calendar WHERE {ONE}"),
    "employee_calendar_one_stored": with_base(CALENDAR, f"SELECT * FROM calendar WHERE {ONE}"),
    "last_log_date_stored": with_base([], "SELECT max(log_date) AS last_date FROM attend"),
    "status_pivot_other_codes": NAMED_CODES,
    "monthly_summary_other_codes": NAMED_CODES,
}
ORACLE["leave_tally_one"] = ORACLE["leave_tally"].replace("FROM leaves GROUP", f"FROM leaves WHERE {ONE} GROUP")
