"""KPIs, segment reports and the distributions behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions.ratios import across, percent
from shopledger.plans.distribution import Distribution, long_form
from shopledger.plans.rows import with_row

def kpis(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Revenue, mean order value, customers, orders and percent VIP, in one row."""
    orders = tx.groupBy("invoice").agg(F.sum("total_value").alias("order_value"))
    people = lookup.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("customer_segment") == "VIP").alias("vips"),
    )
    totals = orders.agg(
        F.sum("order_value").alias("total_revenue"),
        (F.sum("order_value").cast("double") / F.count(F.lit(1))).alias("avg_order_value"),
        F.count(F.lit(1)).alias("total_orders"),
    )
    customers, vips = F.col("_people")["customers"], F.col("_people")["vips"]
    shares = {"total_customers": customers, "vip_percentage": percent(vips, customers)}
    return with_row(totals, people, "_people").withColumns(shares).drop("_people")


def segment_distribution(cust: DataFrame) -> DataFrame:
    """Customers per segment and their share, largest first."""
    rows = cust.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"))
    share = percent(F.col("customers"), across(F.sum("customers")))
    return rows.withColumn("share", share).orderBy(F.desc("customers"), "customer_segment")


def histogram(df: DataFrame, column: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin between the lowest and the highest value; nulls are left out.

    ``df`` is read twice (limits, then counts) and should be pinned. Without ``by`` empty bins
    are listed with 0; with ``by`` the bin edges are shared and only filled bins are listed.
    """
    value = F.col(column).cast("double")
    limits = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    low = F.col("_limits")["low"]
    width = (F.col("_limits")["high"] - low) / bins
    # The highest value closes the last bin; equal values all lie in bin 0.
    place = F.coalesce(F.floor(F.try_divide(value - low, width)), F.lit(0))
    counts = (
        with_row(df.where(value.isNotNull()), limits, "_limits")
        .groupBy(*by, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    if not by:
        every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        counts = every.join(counts, "bin", "left").fillna(0, ["customers"])
    edge = low + F.col("bin") * width
    edges = {"low": edge, "high": edge + width}
    return with_row(counts, limits, "_limits").withColumns(edges).drop("_limits")


def spend_histogram(cust: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(cust, "total_spend", bins)


def spend_histogram_by_segment(cust: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(cust, "total_spend", bins, ["customer_segment"])


def clv_histogram(clv: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(clv, "clv_score", bins)


def avg_order_value_by_segment(cust: DataFrame) -> DataFrame:
    """Mean over customers of their mean line value."""
    return cust.groupBy("customer_segment").agg(
        F.avg("avg_line_value").alias("avg_order_value")
    )


def lines_with_segment(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """(customer_segment, total_value) of the lines whose customer has a segment."""
    return tx.join(lookup, "customer_id").select("customer_segment", "total_value")


BY_SEGMENT = ["customer_segment"]


def describe_spend_by_segment(cust: DataFrame) -> DataFrame:
    """Statistics of customer spend per segment, highest total first."""
    stats = Distribution(long_form(cust, ["total_spend"], BY_SEGMENT), BY_SEGMENT).describe()
    return stats.drop("measure").orderBy(F.desc("total"))


def describe_line_value_by_segment(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Statistics of line values per customer segment, highest mean first."""
    lines = long_form(lines_with_segment(tx, lookup), ["total_value"], BY_SEGMENT)
    return Distribution(lines, BY_SEGMENT).describe().drop("measure").orderBy(F.desc("mean"))


SCORES = ("r_score", "f_score", "m_score")


def rfm_profile(cust: DataFrame) -> DataFrame:
    """Mean scores per segment."""
    return cust.groupBy("customer_segment").agg(*[F.avg(s).alias(s) for s in SCORES])


def rfm_summary(cust: DataFrame) -> DataFrame:
    """Mean scores per segment and their mean, rounded to 2, highest first."""
    mean = (F.col("r_score") + F.col("f_score") + F.col("m_score")) / 3
    profile = rfm_profile(cust).withColumn("avg_score", mean)
    rounded = {c: F.round(c, 2) for c in (*SCORES, "avg_score")}
    return profile.withColumns(rounded).orderBy(F.desc("avg_score"), "customer_segment")


def box_stats_by_segment(cust: DataFrame, tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Box statistics per segment of tenure, rate, spend (per customer) and line value."""
    per_customer = long_form(cust, ["tenure_days", "frequency", "total_spend"], BY_SEGMENT)
    per_line = long_form(lines_with_segment(tx, lookup), ["total_value"], BY_SEGMENT)
    return Distribution(per_customer.unionByName(per_line), BY_SEGMENT).box()


def rfm_box_stats(rfm: DataFrame) -> DataFrame:
    """Box statistics of recency, frequency and monetary value over all customers."""
    return Distribution(long_form(rfm, ["recency", "frequency", "monetary"])).box()


def spend_and_line_values(cust: DataFrame, tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Customer spend and line values in long form per segment, in one frame."""
    spend = cust.withColumnRenamed("total_spend", "lifetime_value")
    line = lines_with_segment(tx, lookup).withColumnRenamed("total_value", "line_value")
    return long_form(spend, ["lifetime_value"], BY_SEGMENT).unionByName(
        long_form(line, ["line_value"], BY_SEGMENT)
    )


def distribution_compare(cust: DataFrame, tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Customer spend beside line value per segment."""
    both = Distribution(spend_and_line_values(cust, tx, lookup), BY_SEGMENT)
    return both.describe().select(
        "customer_segment", "measure", "count", "mean", "q1", "median", "q3"
    )


FEATURES = ("tenure_days", "frequency", "total_spend", "avg_line_value")


def describe_features(cust: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Statistics of the model features, one row per feature."""
    return Distribution(long_form(cust, features)).describe().withColumnRenamed("measure", "feature")
