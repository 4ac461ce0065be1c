"""Carry values over missing ones along the dates of an employee.

A window over all rows of an employee would put a hot employee into one task.
Instead each (employee, date) is first reduced to one known row; the window runs
over those, at most one row per calendar day, and the result returns to the
rows by an equi-join that adaptive execution can split. Rows of one date are
peers: what is known on the date counts for all of them. Where they differ, the least
row in the order of the columns, NULL last, stands for the date as a whole, so values of two rows
of a date are never mixed. A column that this row lacks comes from the nearest date whose row has it.
Rows without an employee or a date have no place in the order and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_row(cols: list[str]) -> Column:
    """The columns as one struct in which NULL sorts last; NULL where none of them is known."""
    parts = [x for c in cols for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c))]
    return F.when(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull(), F.struct(*parts))


def _fill(df: DataFrame, partition: str, order: str, cols: list[str], upwards: bool) -> DataFrame:
    # Equal rows are folded by a hash aggregate before any struct is compared.
    different = df.select(partition, order, *cols).distinct()
    known = different.groupBy(partition, order).agg(F.min(known_row(cols)).alias("known"))
    by_date = Window.partitionBy(partition).orderBy(order)
    before = by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = by_date.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def carried(column: str) -> Column:
        value = F.col("known")[column]
        down = F.last(value, ignorenulls=True).over(before)
        return F.coalesce(down, F.first(value, ignorenulls=True).over(after)) if upwards else down

    carry = known.select(partition, order, *[carried(c).alias(f"_{c}") for c in cols])
    filled = {c: F.coalesce(c, f"_{c}") for c in cols}
    return df.join(carry, [partition, order], "left").select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])


def fill_down(df: DataFrame, partition: str, order: str, cols: list[str]) -> DataFrame:
    return _fill(df, partition, order, cols, upwards=False)


def fill_downup(df: DataFrame, partition: str, order: str, cols: list[str]) -> DataFrame:
    """Down first, then up for what precedes the first known row."""
    return _fill(df, partition, order, cols, upwards=True)
