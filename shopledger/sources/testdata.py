"""The given star-schema tables seen as transaction lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.operators.cleaning import clean_transactions, with_total_value
from shopledger.sources.readers import MONEY, read_transactions

LINE_COLUMNS = ("invoice", "stock_code", "quantity", "invoice_date", "price", "customer_id")


def raw_lines(
    spark: SparkSession, folder: str, extra: Sequence[str] = (), sold: bool = False
) -> DataFrame:
    """One row per order line; ``extra`` may ask for ``description`` and ``country``.

    A lookup table is joined only when one of its columns is asked for.
    """
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    if sold:
        lines = lines.where("l_quantity >= 1 and l_extendedprice > 0")
        orders = orders.where("o_custkey is not null")
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    columns = {
        "invoice": F.col("l_orderkey").cast("string"),
        "stock_code": F.col("l_partkey").cast("string"),
        "quantity": F.col("l_quantity").cast("int"),
        "invoice_date": F.col("o_orderdate"),
        "price": F.col("l_extendedprice").cast(MONEY),
        "customer_id": F.col("o_custkey").cast("string"),
    }
    if "description" in extra:
        part = spark.read.parquet(f"{folder}/part.parquet")
        df = df.join(part, df.l_partkey == part.p_partkey, "left")
        columns["description"] = F.col("p_name")
    if "country" in extra:
        customer = spark.read.parquet(f"{folder}/customer.parquet")
        nation = spark.read.parquet(f"{folder}/nation.parquet")
        home = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        df = df.join(home, df.o_custkey == home.c_custkey, "left")
        columns["country"] = F.col("n_name")
    return df.select(*[c.alias(name) for name, c in columns.items()])


def lines(spark: SparkSession, folder: str, extra: Sequence[str] = ()) -> DataFrame:
    """Cleaned lines with ``total_value``.

    The cleaning conditions are repeated on the stored columns, so that the scans can skip rows
    by them; the conditions on the cast values still decide.
    """
    return with_total_value(clean_transactions(raw_lines(spark, folder, extra, sold=True)))


#: Columns of the given line and event tables that are transaction columns.
STORED_LINES = {
    "l_orderkey": "invoice", "l_partkey": "stock_code", "l_quantity": "quantity", "l_extendedprice": "price",
}
STORED_EVENTS = {"event_id": "invoice", "ts": "invoice_date", "value": "price", "user_id": "customer_id"}


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One file through the reader."""
    return read_transactions(spark, f"{folder}/lineitem.parquet", columns=STORED_LINES)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The line and event files as the reader sees them: two parts with different columns."""
    files = [f"{folder}/lineitem.parquet", f"{folder}/events.parquet"]
    return read_transactions(spark, files, columns=STORED_LINES | STORED_EVENTS)


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as one-item lines; unlike orders they carry a time of day."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.col("event_id").cast("string").alias("invoice"),
        F.lit(1).alias("quantity"),
        F.col("ts").alias("invoice_date"),
        F.col("value").cast(MONEY).alias("price"),
        F.col("user_id").cast("string").alias("customer_id"),
    )
