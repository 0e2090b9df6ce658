"""One-row frames as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add the only row of ``one_row`` as a struct column, by one scalar subquery."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())
