"""Segment names and the rules that assign them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment names in rank order, and the right-closed spend bands.
PRICE_SEGMENTS = ("Budget", "Regular", "Premium", "Luxury")
CUSTOMER_SEGMENTS = ("VIP", "Loyal", "Regular", "At Risk")
SPEND_BANDS = ("At Risk", "Regular", "Loyal", "VIP")
SPEND_EDGES = (0, 500, 1000, 5000, float("inf"))


def price_segment(price: Column, q1: Column, median: Column, q3: Column) -> Column:
    return (
        F.when(price <= q1, "Budget")
        .when(price <= median, "Regular")
        .when(price <= q3, "Premium")
        .when(price.isNotNull(), "Luxury")
    )


def price_segment_rank(segment: Column) -> Column:
    """0 for Budget to 3 for Luxury; for ordering reports."""
    return F.array_position(F.lit(list(PRICE_SEGMENTS)), segment) - 1


def score_low(value: Column, q1: Column, median: Column, q3: Column) -> Column:
    """4 for the lowest quarter down to 1 for the highest."""
    return F.when(value <= q1, 4).when(value <= median, 3).when(value <= q3, 2).otherwise(1)


def score_high(value: Column, q1: Column, median: Column, q3: Column) -> Column:
    """4 for the highest quarter down to 1 for the lowest."""
    return F.when(value >= q3, 4).when(value >= median, 3).when(value >= q1, 2).otherwise(1)


def customer_segment(r: Column, f: Column, m: Column) -> Column:
    """Mean score of 3.5 VIP, 2.5 Loyal, 1.5 Regular, on the integer sum of the three scores."""
    total = r + f + m
    return (
        F.when(total >= 10.5, "VIP")
        .when(total >= 7.5, "Loyal")
        .when(total >= 4.5, "Regular")
        .otherwise("At Risk")
    )


def spend_band(
    spend: Column, edges: Sequence[float] = SPEND_EDGES, names: Sequence[str] = SPEND_BANDS
) -> Column:
    """Right-closed bands; null outside all of them."""
    value = spend.cast("double")
    band = F.lit(None).cast("string")
    for low, high, name in zip(edges, edges[1:], names):
        band = F.when((value > float(low)) & (value <= float(high)), name).otherwise(band)
    return band
