"""Attendance tables derived from the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from musterbook.model import NO_EXIT_TEXT

# Fixed rules of the derivation, by remainder.
DESIGNATION_OF = [
    "Professor", "Associate Professor", "Statistician", "Assistant Professor", "Senior Resident",
    "Junior Resident", "Tutor", "Other", "Visiting Fellow",
]
# The last two with a name are unlisted codes, the very last stands for a leave row without a type.
LEAVE_CODE_OF = ["CL", "EL", "SL", "ML", "RH", "O", "T", "WFH", "STUDY", None]
CAT_OF = {"BUILDING": "Faculty", "MACHINERY": "Senior Resident", "AUTOMOBILE": "Junior Resident"}


def _pick(values: list[str], number: Column) -> Column:
    place = F.pmod(number, F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, values)), place)


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 8, "0")


def _text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def emp_table(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    cat = F.coalesce(*[F.when(segment == k, v) for k, v in CAT_OF.items()], F.lit("Other"))
    created = (
        F.when(key % 40 == 13, "2024-02-15").when(key % 6 == 5, "2024-01-10").otherwise("1994-01-01")
    )
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _padded(key).alias("emp_id"),
            F.col("c_name").alias("emp_name"),
            _pick(DESIGNATION_OF, key).alias("designation"),
            F.col("n_name").alias("division"),
            cat.alias("cat"),
            created.cast("date").alias("creation_date"),
            F.when(key % 11 == 4, "I").otherwise("A").alias("active_status"),
        )
    )


def attend_table(events: DataFrame) -> DataFrame:
    ts = F.col("ts")
    device = F.when(F.hour(ts) < 20, "D1").otherwise("D2")
    visits = (
        events.filter("event_type <> 'signup'")
        .groupBy("user_id", ts.cast("date").alias("log_date"), device.alias("device"))
        .agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.count(F.lit(1)).alias("n"),
            F.max("value").alias("top"),
            F.bool_or(F.col("event_type") == "error").alias("failed"),
        )
    )
    single = F.col("n") == 1
    gate = F.when(F.col("device") == "D1", "Gate A").otherwise("Gate B")
    left_at = (
        F.when(~single, _text(F.col("last_ts"))).when(~F.col("failed"), NO_EXIT_TEXT)
    )
    # A single visit of high value is a punch the device sent twice.
    copies = F.when(single & (F.col("top") > 15), 2).otherwise(1)
    return visits.select(
        _padded(F.col("user_id")).alias("emp_id"),
        "log_date",
        F.col("device").alias("in_device_id"),
        gate.alias("in_location"),
        _text(F.col("first_ts")).alias("in_time"),
        F.col("device").alias("out_device_id"),
        F.when(~single, gate).alias("out_location"),
        left_at.alias("out_time"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def leave_table(events: DataFrame, orders: DataFrame) -> DataFrame:
    def coded(rows: DataFrame, user: str, date: Column, key: str) -> DataFrame:
        days = rows.groupBy(user, date.cast("date").alias("date")).agg(F.min(key).alias("k"))
        code = _pick(LEAVE_CODE_OF, F.col("k")).alias("leave_type")
        return days.select(_padded(F.col(user)).alias("emp_id"), "date", code)

    signups = coded(events.filter("event_type = 'signup'"), "user_id", F.col("ts"), "event_id")
    return signups.union(coded(orders, "o_custkey", F.col("o_orderdate"), "o_orderkey"))


def outsider_punches(supplier: DataFrame) -> DataFrame:
    """One punch without exit per supplier: records of people without a master row."""
    day = F.date_add(F.lit("2024-01-03").cast("date"), (F.col("s_suppkey") % 25).cast("int"))
    none = F.lit(None).cast("string")
    return supplier.select(
        _outsider_id(),
        day.alias("log_date"),
        F.lit("D1").alias("in_device_id"),
        F.lit("Gate A").alias("in_location"),
        F.concat(day.cast("string"), F.lit(" 09:15:00")).alias("in_time"),
        F.lit("D1").alias("out_device_id"),
        none.alias("out_location"),
        none.alias("out_time"),
    )


def outsider_leave(supplier: DataFrame) -> DataFrame:
    """One leave row per supplier, on the day of the punch for some of them."""
    key = F.col("s_suppkey")
    day = F.date_add(F.lit("2024-01-03").cast("date"), (key % 20).cast("int"))
    return supplier.select(_outsider_id(), day.alias("date"), _pick(LEAVE_CODE_OF, key).alias("leave_type"))


def _outsider_id() -> Column:
    return _padded(F.col("s_suppkey") + 90_000_000).alias("emp_id")


def holiday_table(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Many rows per holiday: event days 1, 15 and 26, and every Christmas with an order."""
    event_day, order_day = F.col("ts").cast("date"), F.col("o_orderdate").cast("date")
    marked = events.filter(F.day(event_day).isin(1, 15, 26)).select(event_day.alias("hol_date"))
    christmas = (F.month(order_day) == 12) & (F.day(order_day) == 25)
    return marked.union(orders.filter(christmas).select(order_day.alias("hol_date")))


class DerivedTables:
    """The four tables over a folder of test tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._folder = spark, sf_dir
        self._schemas: dict[str, StructType] = {}

    def _read(self, name: str) -> DataFrame:
        """A test table; its schema is read off the files once."""
        path = f"{self._folder}/{name}.parquet"
        if path not in self._schemas:
            self._schemas[path] = self._spark.read.parquet(path).schema
        return self._spark.read.schema(self._schemas[path]).parquet(path)

    @cached_property
    def emp(self) -> DataFrame:
        return emp_table(self._read("customer"), self._read("nation"))

    @cached_property
    def attend(self) -> DataFrame:
        return attend_table(self._read("events")).unionByName(outsider_punches(self._read("supplier")))

    @cached_property
    def leave(self) -> DataFrame:
        leave = leave_table(self._read("events"), self._read("orders"))
        return leave.unionByName(outsider_leave(self._read("supplier")))

    @cached_property
    def holidays(self) -> DataFrame:
        return holiday_table(self._read("events"), self._read("orders"))
