"""Attendance analytics expressed as Spark DataFrame operations."""

from musterbook.model import Cutoffs, Tables

__all__ = ["Cutoffs", "Tables"]
