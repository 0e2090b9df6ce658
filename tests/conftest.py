import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shopledger.operators.cleaning import clean_transactions, with_total_value  # noqa: E402
from shopledger.sources.readers import apply_schema  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        # Keep every range its own partition, so that sums across ranges are exercised.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COLUMNS = "invoice string, stock_code string, description string, quantity int,\
 invoice_date timestamp_ntz, price decimal(18,4), customer_id string, country string"


@pytest.fixture(scope="session")
def make_lines(spark):
    """Lines from (invoice, stock, quantity, date text, price, customer)."""

    def make(rows, clean=True):
        data = [
            (i, s, f"item {s}", q, dt.datetime.fromisoformat(d), Decimal(str(p)), c, "UK")
            for i, s, q, d, p, c in rows
        ]
        df = apply_schema(spark.createDataFrame(data, COLUMNS))
        return with_total_value(clean_transactions(df)) if clean else df

    return make


def rows(df, *columns):
    """Rows as sorted tuples of the named columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
