"""Transaction tables from files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("invoice", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("invoice_date", T.TimestampNTZType()),
        T.StructField("price", MONEY),
        T.StructField("customer_id", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)

# Column headers of the retail workbook and the names used here.
HEADERS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}


def read_transactions(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "parquet",
    columns: Mapping[str, str] | None = None,
    malformed: str = "fail",
    **options: str,
) -> DataFrame:
    """Read every part and stack them; one path reads a single file or folder.

    ``columns`` maps the files' headers to the names used here, ``HEADERS`` by default.
    ``malformed="null"`` turns cells that do not fit the schema into nulls instead of failing.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"header": "true", **options} if fmt == "csv" else options
    parts = [rename_headers(spark.read.format(fmt).options(**options).load(p), columns) for p in paths]
    return apply_schema(stack(parts), malformed=malformed)


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rename_headers(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    columns = HEADERS if columns is None else columns
    return df.withColumnsRenamed({h: n for h, n in columns.items() if h in df.columns})


def apply_schema(
    df: DataFrame, schema: T.StructType = TRANSACTION_SCHEMA, malformed: str = "fail"
) -> DataFrame:
    """Select and cast the columns of ``schema``; absent ones become null.

    Whole numbers may be written with zeros after the point (``6.0``). Any other cell that does
    not fit its column fails the read, or is null with ``malformed="null"``.
    """
    df = normalize_keys(df)

    def cell(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType)
        c = F.col(field.name)
        if isinstance(field.dataType, T.IntegralType) and isinstance(df.schema[field.name].dataType, T.StringType):
            c = F.regexp_replace(F.trim(c), r"^([+-]?\d+)\.0*$", "$1")
        return c.try_cast(field.dataType) if malformed == "null" else c.cast(field.dataType)

    return df.select(*[cell(f).alias(f.name) for f in schema])


def normalize_keys(
    df: DataFrame, keys: Sequence[str] = ("customer_id", "stock_code", "invoice")
) -> DataFrame:
    """Keys as text: whole numbers as integer text, ``13085.0`` style text without its zeros.

    A number that is not whole keeps its own text, so no two keys become one.
    """
    for key in keys:
        if key not in df.columns:
            continue
        kind, c = df.schema[key].dataType, F.col(key)
        text = c.cast("string")
        if isinstance(kind, T.StringType):
            text = F.regexp_replace(key, r"^(\d+)\.0+$", "$1")
        elif isinstance(kind, T.FractionalType):
            whole = c.try_cast("decimal(38,0)")
            text = F.when(c == F.floor(c), F.coalesce(whole.cast("string"), text)).otherwise(text)
        df = df.withColumn(key, text)
    return df
