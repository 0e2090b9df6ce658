"""Cleaning and per-line enrichment. All narrow: no operator here shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions import calendar

VALUE_TYPE = "decimal(18,4)"


def clean_transactions(df: DataFrame) -> DataFrame:
    """Keep sold lines of known customers and products: quantity and price above 0, both present."""
    return df.where("quantity > 0 and price > 0 and customer_id is not null and stock_code is not null")


def with_total_value(df: DataFrame) -> DataFrame:
    """``total_value`` = quantity * price, exact; a line of 1e14 or more fails the query."""
    return df.withColumn("total_value", (F.col("quantity") * F.col("price")).cast(VALUE_TYPE))


def with_calendar(df: DataFrame) -> DataFrame:
    """month, day_of_week (Monday is 0) and hour of the invoice."""
    date = F.col("invoice_date")
    return df.withColumns(
        {"month": F.month(date), "day_of_week": F.weekday(date), "hour": F.hour(date)}
    )


def with_season(df: DataFrame) -> DataFrame:
    return df.withColumn("season", calendar.season(F.col("invoice_date")))


def with_holiday_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_holiday_season", calendar.holiday_season(F.col("invoice_date")))


def with_year_month(df: DataFrame) -> DataFrame:
    date = F.col("invoice_date")
    return df.withColumns(
        {"year": F.year(date), "month": F.month(date), "year_month": calendar.month_start(date)}
    )


def filter_period(df: DataFrame, start: str, end: str) -> DataFrame:
    """Lines with ``start <= invoice_date <= end``, both ends included."""
    kind = df.schema["invoice_date"].dataType
    return df.where(F.col("invoice_date").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def dataset_overview(tx: DataFrame, exact: bool = True) -> DataFrame:
    """Revenue, distinct customers and invoices, and revenue per invoice, in one row.

    ``exact=False`` counts the distinct keys by sketches, which shuffles no keys.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return tx.agg(
        F.sum("total_value").alias("total_revenue"),
        distinct("customer_id").alias("unique_customers"),
        distinct("invoice").alias("total_transactions"),
    ).withColumn(
        "avg_order_value",
        F.try_divide(F.col("total_revenue").cast("double"), F.col("total_transactions")),
    )
