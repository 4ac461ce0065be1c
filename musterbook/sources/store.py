"""Where the tables come from and where results go."""

from __future__ import annotations

import datetime as dt
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from musterbook.model import (
    ATTEND_SCHEMA,
    EMP_SCHEMA,
    HOLIDAY_SCHEMA,
    LEAVE_MONTH,
    LEAVE_SCHEMA,
    Tables,
    month_start,
)
from musterbook.operators.counts import summary_ordered


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """The four tables of a Parquet folder, as ``write_tables`` lays them out.

    Leave has its partition column ``date_month`` besides; date filters use it and drop it.
    """
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    return Tables(
        read("emp", EMP_SCHEMA),
        read("attend", ATTEND_SCHEMA),
        read("leave", f"{LEAVE_SCHEMA}, {LEAVE_MONTH} DATE"),
        read("holidays", HOLIDAY_SCHEMA),
    )


def write_tables(tables: Tables, folder: str, row_group_bytes: int | None = None) -> None:
    """Facts partitioned by time and clustered by employee.

    A month is a partition filter: punches lie by date, leave, of which an employee has a few days a
    year, by month. Inside a file rows are sorted by employee, so ranges of row groups hardly overlap,
    and a bloom filter tells most of the others apart: one employee's rows take few row groups.
    The rebalance hint lets adaptive execution gather a date's rows and split a
    date that is too large for one task.
    """
    tables.emp.write.parquet(f"{folder}/emp")
    tables.holidays.write.parquet(f"{folder}/holidays")
    _write_clustered(tables.attend, "log_date", ["emp_id", "in_time"], f"{folder}/attend", row_group_bytes)
    leave = tables.leave.select("emp_id", "date", "leave_type", F.trunc("date", "MM").alias(LEAVE_MONTH))
    _write_clustered(leave, LEAVE_MONTH, ["emp_id", "date"], f"{folder}/leave", row_group_bytes)


def _write_clustered(df: DataFrame, part: str, order: list[str], path: str, row_group_bytes: int | None) -> None:
    rows = df.hint("rebalance", F.col(part)).sortWithinPartitions(part, *order)
    writer = rows.write.partitionBy(part).option("parquet.bloom.filter.enabled#emp_id", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def stored_last_log_date(spark: SparkSession, folder: str) -> DataFrame:
    """Newest punch date of written tables, from the names of the date partitions: no row of the others is looked at.

    Partitions are listed, not files: one name per date. A partition that has lost its rows is passed over.
    """
    attend = f"{folder}/attend"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(attend)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [status.getPath().getName() for status in found if status.isDirectory()]
    dates = sorted((name.partition("=")[2] for name in names if re.fullmatch(r"log_date=\d{4}-\d\d-\d\d", name)), reverse=True)
    rows = spark.read.schema(ATTEND_SCHEMA).parquet(attend)
    newest = next((d for d in dates if rows.filter(F.col("log_date") == F.lit(d).cast("date")).head(1)), None)
    return spark.range(1).select(F.lit(newest).cast("date").alias("last_date"))


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    user: str,
    password: str,
    date_column: str | None = None,
    first: dt.date | None = None,
    until: dt.date | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A table of a live database; of a date range only its rows, in that many parallel slices."""
    options = jdbc_slices(date_column, first, until, partitions)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password, **options)
    rows = reader.load()
    # Bounds only set the slices; the filter is what the database evaluates.
    return rows.filter(in_range(date_column, first, until)) if options else rows


def jdbc_slices(
    date_column: str | None, first: dt.date | None, until: dt.date | None, partitions: int
) -> dict[str, str]:
    """Reader options of a date range; all of column, first and end or none of them."""
    given = [x is not None for x in (date_column, first, until)]
    if not any(given):
        return {}
    if not all(given):
        raise ValueError("a date range needs its column, first date and end")
    return {
        "partitionColumn": date_column,
        "lowerBound": str(first),
        "upperBound": str(until),
        "numPartitions": str(partitions),
    }


def in_range(column: str, first: dt.date, until: dt.date) -> Column:
    return (F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(until))


def read_json_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Files holding arrays of JSON objects, or (``lines``) one object per line; an absent field is NULL.

    An array is one document, so its file is one task. A large file of lines is split over tasks;
    blank lines give no row, a line that is no object gives a row of NULLs.
    """
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def json_record_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Replace a JSON text column by typed fields; an absent field is NULL."""
    parsed = df.withColumn("_record", F.from_json(column, schema))
    return parsed.select(*[c for c in df.columns if c != column], "_record.*")


def summary_name(division: str, cat: str, month: dt.date | str) -> str:
    return quote(f"{division}_{cat}_{month_start(month):%B_%Y}.csv", safe=" ,&()")


def summary_csv(
    summary: DataFrame, folder: str, division: str, cat: str, month: dt.date | str
) -> str:
    """Write a summary, in its order, as a CSV directory named after its choice; returns the path."""
    path = f"{folder}/{summary_name(division, cat, month)}"
    summary_ordered(summary).drop("designation_rank").write.option("header", True).csv(path)
    return path
