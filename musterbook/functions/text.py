"""Text helpers on columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from musterbook.model import LEAVE_LABELS


def emp_id_pad(emp_id: Column) -> Column:
    """Left-pad with zeros to 8 characters; longer ids stay whole (``lpad`` would cut them)."""
    return F.when(F.length(emp_id) < 8, F.lpad(emp_id, 8, "0")).otherwise(emp_id)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def flatten_comma(values: Column) -> Column:
    """Join an array of strings with ``, ``; NULLs are left out and no value gives ``''``."""
    return F.array_join(values, ", ")


def leave_type_label(code: Column) -> Column:
    """Long name of a leave code, NULL for a code without one."""
    labels = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LEAVE_LABELS.items()))
    return F.try_element_at(labels, code)
