"""Leave and punch rows as one record stream, and what one day's records mean."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterbook.functions.clock import punch_parse
from musterbook.functions.status import code_order, position
from musterbook.model import CODES, PUNCH_COLUMNS, month_start
from musterbook.operators.joins import employees_without_records

# Precedence of a record within its employee-day; the lowest one names the day.
FIRST, SECOND, PLACEHOLDER = 0, 1, 2
# Stands for NULL in sort keys; it sorts behind every text.
NULL_TEXT = chr(0x10FFFF)
# Chunks of a day besides its 1,440 minutes, in the order of punches.
BEFORE, AFTER, UNREADABLE = -1, 1440, 1441


def unified_records(leave: DataFrame, attend: DataFrame, leave_first: bool = True) -> DataFrame:
    """Leave rows and punch rows (code ``P``) by name, missing columns NULL."""
    leave_rank, punch_rank = (FIRST, SECOND) if leave_first else (SECOND, FIRST)
    leaves = leave.select(
        "emp_id", "date", F.col("leave_type").alias("attendance"), F.lit(leave_rank).alias("precedence")
    )
    punches = attend.select(
        "emp_id",
        F.col("log_date").alias("date"),
        F.lit("P").alias("attendance"),
        F.lit(punch_rank).alias("precedence"),
        *PUNCH_COLUMNS,
    )
    return punches.unionByName(leaves, allowMissingColumns=True)


def placeholder_union(
    records: DataFrame, emp: DataFrame, month: dt.date | str, active_only: bool = True
) -> DataFrame:
    """Add employees without a record as one row without code, dated the month start."""
    absent = employees_without_records(emp, records, active_only).select(
        "emp_id",
        F.lit(month_start(month)).alias("date"),
        F.lit(None).cast("string").alias("attendance"),
        F.lit(PLACEHOLDER).alias("precedence"),
    )
    return records.unionByName(absent, allowMissingColumns=True)


def distinct_rows(records: DataFrame) -> DataFrame:
    return records.distinct()


def code_key() -> Column:
    """Precedence and place in the code list as one BIGINT: the least names the day.

    Unlisted codes share a place behind the listed ones and are told apart by their text;
    no code at all comes last.
    """
    return F.col("precedence").cast("long") * 100 + code_order(F.col("attendance"))


def unlisted_code() -> Column:
    """The code where the list does not have it, else NULL."""
    return F.when(position(F.col("attendance"), CODES).isNull(), F.col("attendance"))


def code_of(first: Column) -> Column:
    """Code of the least (key, unlisted) of a group."""
    place = (first["key"] % 100).cast("int")
    listed = F.get(F.array(*map(F.lit, CODES)), place - 1)
    return F.when(place <= len(CODES), listed).otherwise(first["unlisted"])


def code_struct() -> Column:
    return F.struct(code_key().alias("key"), unlisted_code().alias("unlisted"))


def reduced_days(records: DataFrame, **further: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """One row per employee-day: code of the first record, and further (aggregate, column) values.

    Raw rows meet fixed-width buffers only (``min`` of a BIGINT in a hash aggregate, combined on
    the map side): the text of a code is part of the key, and only where it is unlisted. What is
    left, a row per day and unlisted code, is ordered by key and text. The further
    aggregates must be such that they can be applied twice.
    """
    values = [aggregate(column).alias(name) for name, (aggregate, column) in further.items()]
    by_code = records.groupBy("emp_id", "date", unlisted_code().alias("unlisted")).agg(F.min(code_key()).alias("key"), *values)
    days = by_code.groupBy("emp_id", "date").agg(
        F.min(F.struct("key", "unlisted")).alias("first"),
        *[aggregate(F.col(name)).alias(name) for name, (aggregate, _) in further.items()],
    )
    return days.select("emp_id", "date", code_of(F.col("first")).alias("attendance"), *further)


def first_record_of_day(records: DataFrame) -> DataFrame:
    return reduced_days(records)


def punch_order() -> list[Column]:
    """Order of punches within a day: by readable entry time, then by the raw texts.

    It is total over the listed columns; NULL comes last, as a text no value can have.
    """
    last_time = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    raw = ["in_time", "in_device_id", "out_time", "out_device_id", "in_location", "out_location"]
    return [
        F.coalesce(punch_parse(F.col("in_time")), last_time).alias("in_ts"),
        *[F.coalesce(F.col(c), F.lit(NULL_TEXT)).alias(c) for c in raw],
    ]


def day_chunk() -> Column:
    """Minute of the day of a punch; before and after its date, and unreadable, one chunk each.

    It rises with the order of punches, so the chunks of a day in order hold its punches in order.
    """
    in_ts = punch_parse(F.col("in_time"))
    on = in_ts.cast("date")
    return (
        F.when(in_ts.isNull(), UNREADABLE)
        .when(on < F.col("date"), BEFORE)
        .when(on > F.col("date"), AFTER)
        .otherwise(F.hour(in_ts) * 60 + F.minute(in_ts))
    )


def folded_punches(records: DataFrame, distinct: bool) -> DataFrame:
    """Different records with their number of ``copies``; a repetition counts once if ``distinct``.

    The exchange is keyed by the whole record, so a hot employee-day spreads over all tasks.
    ``distinct`` leaves places out of what is equal.
    """
    columns = [c for c in PUNCH_COLUMNS if not (distinct and c.endswith("location"))]
    rows = records.select("emp_id", "date", "precedence", "attendance", *columns)
    if not distinct:
        return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    place = F.lit(None).cast("string")
    return rows.distinct().withColumns({"copies": F.lit(1).cast("long"), "in_location": place, "out_location": place})


def first_punch() -> dict[str, tuple[Callable[[Column], Column], Column]]:
    """What the status of a day needs of its punches, as (aggregate, column): one punch's width, whatever the day."""
    left = F.col("out_time").isNotNull()
    return {
        "first": (F.min, code_struct()),
        "in_ts": (F.min, punch_parse(F.col("in_time"))),
        "exits": (F.sum, F.when(left, F.col("copies"))),
        "exit_punch": (F.min, F.when(left, F.struct(*punch_order()))),
    }


def shown_punch() -> list[Column]:
    """Code, first entry and exit text; an exit that is not alone carries a comma, as in the day's list."""
    out = F.col("exit_punch")["out_time"]
    text = F.when(F.col("exits") > 1, F.concat(out, F.lit(", "))).otherwise(F.coalesce(out, F.lit("")))
    return ["emp_id", "date", code_of(F.col("first")).alias("attendance"), "in_ts", text.alias("out_text")]


def first_punches(records: DataFrame, distinct: bool = False) -> DataFrame:
    """``attendance``, ``in_ts`` and ``out_text`` of every employee-day; no list is built."""
    state = [aggregate(column).alias(name) for name, (aggregate, column) in first_punch().items()]
    return folded_punches(records, distinct).groupBy("emp_id", "date").agg(*state).select(*shown_punch())


def collapsed_days(records: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per employee-day: code, first entry and exit, and the comma lists of times and places.

    A list holds every punch of its day, so the cell itself is as long as the day is busy. It is
    put together in two steps: punches are sorted and joined per minute, a group that a
    hot day spreads over tasks, and at most 1,443 such texts are joined in order. Lists that a caller does
    not select are not built.
    """
    punch = F.when(F.coalesce(*PUNCH_COLUMNS).isNotNull(), F.struct(*punch_order(), "copies"))
    state = first_punch()
    chunks = (
        folded_punches(records, distinct)
        .withColumn("chunk", day_chunk())
        .groupBy("emp_id", "date", "chunk")
        .agg(*[f(c).alias(n) for n, (f, c) in state.items()], F.array_sort(F.collect_list(punch)).alias("punches"))
    )

    def joined(column: str) -> Column:
        """The values in order, each with a leading separator and as often as it occurs."""

        def texts(p: Column) -> Column:
            text = F.concat(F.lit(", "), F.nullif(p[column], F.lit(NULL_TEXT)))
            return F.repeat(text, p["copies"].cast("int"))

        return F.array_join(F.transform("punches", texts), "")

    shown = [c for c in ("in_time", "out_time", "in_location", "out_location") if not (distinct and c.endswith("location"))]
    texts = chunks.select("emp_id", "date", "chunk", *state, *[joined(c).alias(c) for c in shown])
    days = texts.groupBy("emp_id", "date").agg(
        *[f(F.col(n)).alias(n) for n, (f, _) in state.items()],
        *[F.array_sort(F.collect_list(F.struct("chunk", F.col(c).alias("text")))).alias(c) for c in shown],
    )
    lists = [F.substr(F.array_join(F.col(c)["text"], ""), F.lit(3)).alias(c) for c in shown]
    return days.select(*shown_punch(), *lists)


def day_collapse(records: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per employee-day: first code and the comma lists of times and places."""
    return collapsed_days(records, distinct).drop("in_ts", "out_text")


def duplicate_punch_days(attend: DataFrame) -> DataFrame:
    """Employee-days with more than one punch row."""
    return (
        attend.groupBy("emp_id", "log_date")
        .agg(F.count(F.lit(1)).alias("punches"))
        .filter("punches > 1")
    )
