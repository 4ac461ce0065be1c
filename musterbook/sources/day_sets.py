"""Day sets kept by month, so that a new day costs its own month and not the history.

The sets of an employee and month (``plans.summary.day_sets``) unite by ``bit_or``, which neither order
nor repetition changes: new facts are reduced alone, united with the stored sets of the months they touch,
and only these partitions are written again. Facts that come twice, or late, are therefore harmless;
facts can not be taken back, a corrected month is written anew from its facts (``replace_day_sets``).
Cut-off times are part of the sets: a store belongs to one ``Cutoffs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from musterbook.model import Cutoffs
from musterbook.plans.summary import SET_COLUMNS, day_sets, united_sets

SETS_SCHEMA = ", ".join(["emp_id STRING", *[f"{name} BIGINT" for name in SET_COLUMNS], "last_record DATE", "month DATE"])


def read_day_sets(spark: SparkSession, folder: str) -> DataFrame:
    """All kept sets; ``month`` is the partition, so a range of months is a partition filter."""
    return spark.read.schema(SETS_SCHEMA).parquet(folder)


def write_day_sets(leave: DataFrame, attend: DataFrame, folder: str, cutoffs: Cutoffs = Cutoffs()) -> None:
    """A new store of all facts."""
    _by_month(day_sets(leave, attend, cutoffs)).partitionBy("month").parquet(folder)


def merge_day_sets(leave: DataFrame, attend: DataFrame, folder: str, cutoffs: Cutoffs = Cutoffs()) -> None:
    """Unite new facts with the store; a month without new facts is neither read nor written.

    The months touched come from the reduced facts by a semi join, which prunes the stored partitions.
    One writer at a time: a failed run leaves the store as it was or with whole months replaced, and can be repeated.
    """
    new = day_sets(leave, attend, cutoffs)
    stored = read_day_sets(leave.sparkSession, folder)
    touched = stored.join(new.select("month").distinct(), "month", "left_semi")
    replace_day_sets(united_sets(touched.unionByName(new)), folder)


def replace_day_sets(sets: DataFrame, folder: str) -> None:
    """Write the months of ``sets`` over the stored ones."""
    _by_month(sets).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(folder)


def _by_month(sets: DataFrame) -> DataFrameWriter:
    # Small months are gathered and large ones split, each sorted by employee.
    rows = sets.select("emp_id", *SET_COLUMNS, "last_record", "month").hint("rebalance", F.col("month"))
    return rows.sortWithinPartitions("month", "emp_id").write
