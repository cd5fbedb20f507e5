"""Rounding as the reports have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score4(c: Column) -> Column:
    """Four decimals, halves up on the shortest decimal; scores of two probes a side never tie."""
    return F.round(c, 4)


def seconds2(c: Column) -> Column:
    return F.round(c, 2)
