"""Ratios that give null, not an error, on a zero divisor."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def percent_change(before: Column, after: Column) -> Column:
    return (ratio(after, before) - 1) * 100


def across(aggregate: Column) -> Column:
    """An aggregate over all rows of a report that has one row per segment, season or pair of
    them; such a frame is a few rows, so one task may hold it."""
    return aggregate.over(Window.partitionBy())
