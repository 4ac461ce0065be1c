"""Trial of one employee-day with very many different punches: seconds, tasks and the longest cell.

``python checks/hot_day.py [punches]``; a third of the rows of the table falls on that day.
"""

import datetime as dt
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from musterbook.operators import records  # noqa: E402
from musterbook.session import local_session  # noqa: E402


def main(punches: int) -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "hot day")
    number = F.col("id")
    hot = number % 3 == 0
    day = F.lit(dt.date(2024, 1, 3))
    at = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + number % 86400)
    text = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    attend = spark.range(3 * punches).select(
        F.when(hot, "hot").otherwise(number.cast("string")).alias("emp_id"),
        day.alias("log_date"),
        F.concat(F.lit("D"), number.cast("string")).alias("in_device_id"),
        F.lit("Gate A").alias("in_location"),
        text.alias("in_time"),
        F.lit("D").alias("out_device_id"),
        F.lit("Gate B").alias("out_location"),
        text.alias("out_time"),
    )
    leave = spark.createDataFrame([], "emp_id string, date date, leave_type string")
    rows = records.unified_records(leave, attend)
    for name, build in (("status", records.first_punches), ("lists", records.day_collapse)):
        begun = time.perf_counter()
        column = "out_text" if name == "status" else "in_time"
        longest = build(rows).agg(F.max(F.length(column)).alias("longest")).first()["longest"]
        print(f"{name}: {punches} punches on one day, {time.perf_counter() - begun:.1f} s, longest cell {longest}")
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000)
