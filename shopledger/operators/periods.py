"""Year-over-year comparison, retention between two years, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import calendar
from shopledger.functions.ratios import across, percent, percent_change, ratio
from shopledger.operators.products import with_price_segment


def two_years(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    """Lines of the two years with their ``year``.

    The date bounds are range predicates, which reach the scan; the year test alone would not.
    """
    kind = tx.schema["invoice_date"].dataType
    date = F.col("invoice_date")

    def within(y: int) -> Column:
        return (date >= F.lit(f"{y}-01-01").cast(kind)) & (date < F.lit(f"{y + 1}-01-01").cast(kind))

    return tx.where(within(y0) | within(y1)).withColumn("year", F.year(date))


def metrics_by_year(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    """Revenue, distinct invoices, distinct customers and quantity per year."""
    return (
        two_years(tx, y0, y1)
        .groupBy("year")
        .agg(
            F.sum("total_value").alias("revenue"),
            F.count_distinct("invoice").alias("orders"),
            F.count_distinct("customer_id").alias("customers"),
            F.sum("quantity").alias("volume"),
        )
    )


def _compare(rows: DataFrame, metrics: list[str], y0: int, y1: int) -> DataFrame:
    """One row per metric with both years side by side; ``rows`` has one row per year."""
    sides = rows.agg(
        *[
            F.max(F.when(F.col("year") == y, F.col(m))).cast("double").alias(f"{m}_{side}")
            for m in metrics
            for y, side in ((y0, "before"), (y1, "after"))
        ]
    )
    each = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}_before").alias("before"),
            F.col(f"{m}_after").alias("after"),
        )
        for m in metrics
    ]
    return (
        sides.select(F.explode(F.array(*each)).alias("m"))
        .select("m.*")
        .withColumns(
            {
                "change_pct": F.round(percent_change(F.col("before"), F.col("after")), 1),
                "change": F.col("after") - F.col("before"),
            }
        )
    )


def yoy_changes(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    """Percent and absolute change of revenue, orders, customers and volume."""
    rows = metrics_by_year(tx, y0, y1)
    return _compare(rows, ["revenue", "orders", "customers", "volume"], y0, y1)


def revenue_yoy(tx: DataFrame, key: str, y0: int, y1: int) -> DataFrame:
    """Revenue per ``key`` in both years side by side, and growth in percent."""
    wide = tx.groupBy(key).agg(
        F.sum(F.when(F.col("year") == y0, F.col("total_value"))).alias("before"),
        F.sum(F.when(F.col("year") == y1, F.col("total_value"))).alias("after"),
    )
    growth = F.round(percent_change(F.col("before"), F.col("after")), 1)
    return wide.withColumn("growth_pct", growth)


def monthly_yoy(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    lines = two_years(tx, y0, y1).withColumn("month", F.month("invoice_date"))
    return revenue_yoy(lines, "month", y0, y1)


def price_segment_yoy(tx: DataFrame, lookup: DataFrame, y0: int, y1: int) -> DataFrame:
    """Lines are combined per (product, year) before the segment lookup."""
    per_product = (
        two_years(tx, y0, y1)
        .groupBy("stock_code", "year")
        .agg(F.sum("total_value").alias("total_value"))
    )
    return revenue_yoy(with_price_segment(per_product, lookup), "price_segment", y0, y1)


def seasonal_yoy(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    """Seasons of one calendar year: Winter is its January, February and December."""
    lines = two_years(tx, y0, y1).withColumn("season", calendar.season(F.col("invoice_date")))
    return revenue_yoy(lines, "season", y0, y1)


def customer_yoy(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    """Means per customer of spend, line value and orders in both years, and their change."""
    per_customer = (
        two_years(tx, y0, y1)
        .groupBy("year", "customer_id")
        .agg(
            F.sum("total_value").alias("spend"),
            F.count(F.lit(1)).alias("num_lines"),
            F.count_distinct("invoice").alias("orders"),
        )
    )
    rows = per_customer.groupBy("year").agg(
        ratio(F.sum("spend"), F.count(F.lit(1))).alias("total_spend"),
        F.avg(ratio(F.col("spend"), F.col("num_lines"))).alias("avg_line_value"),
        ratio(F.sum("orders"), F.count(F.lit(1))).alias("num_orders"),
    )
    return _compare(rows, ["total_spend", "avg_line_value", "num_orders"], y0, y1)


def _customer_years(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    """One row per customer: value in each year, null where the customer bought nothing."""
    return (
        two_years(tx, y0, y1)
        .groupBy("customer_id")
        .agg(
            F.sum(F.when(F.col("year") == y0, F.col("total_value"))).alias("before"),
            F.sum(F.when(F.col("year") == y1, F.col("total_value"))).alias("after"),
        )
    )


def _retention_totals(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    first, second = F.col("before").isNotNull(), F.col("after").isNotNull()
    both = first & second
    return _customer_years(tx, y0, y1).agg(
        F.count_if(first).alias("base_customers"),
        F.count_if(second).alias("next_customers"),
        F.count_if(both).alias("retained"),
        F.count_if(second & ~first).alias("new_customers"),
        F.sum(F.when(both, F.col("before"))).alias("retained_value_before"),
        F.sum(F.when(both, F.col("after"))).alias("retained_value_after"),
    )


def retention_rates(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    """Customers of both years and only of the second, in percent of the first year's."""
    base = F.col("base_customers")
    return _retention_totals(tx, y0, y1).select(
        "base_customers",
        "next_customers",
        "retained",
        "new_customers",
        F.round(percent(F.col("retained"), base), 1).alias("retention_rate"),
        F.round(percent(F.col("new_customers"), base), 1).alias("acquisition_rate"),
    )


def retained_value(tx: DataFrame, y0: int, y1: int) -> DataFrame:
    """Revenue of the retained customers in each year."""
    return _retention_totals(tx, y0, y1).select(
        "retained_value_before", "retained_value_after"
    )


def retention_summary(tx: DataFrame, y0: int, y1: int, win_back: float = 0.1) -> DataFrame:
    """Net change of the customer base, value per retained customer, and two targets:
    winning back a tenth of the base, and the acquisitions that offset the churn."""
    base, kept = F.col("base_customers"), F.col("retained")
    per_before = ratio(F.col("retained_value_before"), kept)
    per_after = ratio(F.col("retained_value_after"), kept)
    rate = F.round(percent(kept, base), 1)
    return _retention_totals(tx, y0, y1).select(
        percent_change(base, F.col("next_customers")).alias("net_change_pct"),
        per_before.alias("value_per_retained_before"),
        per_after.alias("value_per_retained_after"),
        percent_change(per_before, per_after).alias("value_change_pct"),
        F.floor(base * win_back).alias("win_back_target"),
        (per_before * (base * win_back)).alias("win_back_revenue"),
        F.floor(base * (1 - rate / 100)).alias("acquisition_target"),
    )


def cohort_activity(tx: DataFrame) -> DataFrame:
    """Customers per (invoice month, month of their first purchase).

    Each task ORs the months of a customer into bitmaps, one for every ``ERA`` months; only these
    small rows are shuffled. The first month and all others are read off the bits. Lines
    without a date have no month.
    """
    eras = customer_months(tx)
    begin = F.col("era") * ERA
    first = F.min(begin + F.bit_count(F.col("bits").bitwiseAND(-F.col("bits")) - 1))
    customers = eras.groupBy("customer_id").agg(first.alias("first"), F.collect_list(F.struct(begin.alias("at"), "bits")).alias("eras"))
    bits = F.sequence(F.lit(0), F.lit(ERA - 1))
    set_bits = lambda e: F.filter(bits, lambda k: F.getbit(e["bits"], k) == 1)
    months = F.flatten(F.transform("eras", lambda e: F.transform(set_bits(e), lambda k: e["at"] + k)))
    date = lambda m: F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))
    cells = customers.select("customer_id", "first", F.explode(months).alias("month")).groupBy("month", "first")
    return cells.agg(F.count("customer_id").alias("customers")).select(
        date(F.col("month")).alias("invoice_month"), date(F.col("first")).alias("first_month"), "customers"
    )


#: Months in one bitmap of a customer; the sign bit stays free.
ERA = 63


def customer_months(tx: DataFrame) -> DataFrame:
    """The months in which a customer bought: ``customer_id``, ``era``, ``bits``.

    Bit k of era e stands for month ``ERA * e + k`` counted from year 0. Rows of several parts of
    the lines are put together by another ``bit_or``.
    """
    date = F.col("invoice_date")
    month = F.year(date) * 12 + F.month(date) - 1
    one = F.expr(f"shiftleft(1L, CAST(pmod(month, {ERA}) AS INT))")
    lines = tx.where(date.isNotNull()).select("customer_id", month.alias("month"))
    return lines.groupBy("customer_id", F.floor(F.col("month") / ERA).cast("int").alias("era")).agg(F.bit_or(one).alias("bits"))


def cohort_retention(activity: DataFrame) -> DataFrame:
    """Percent of each cohort still buying, by whole months since the first purchase."""
    since = F.months_between("invoice_month", "first_month").cast("int")
    size = F.max(
        F.when(F.col("invoice_month") == F.col("first_month"), F.col("customers"))
    ).over(Window.partitionBy("first_month"))
    return activity.select(
        F.col("first_month").alias("cohort_month"),
        since.alias("months_since_first"),
        "customers",
        percent(F.col("customers"), size).alias("retention"),
    )


def cohort_matrix_literal(activity: DataFrame) -> DataFrame:
    """Each invoice month's customers by first month, relative to those of the oldest cohort.

    ``activity`` holds one row per pair of months, so the oldest cohort is found by a window
    over few rows.
    """
    oldest = across(F.min("first_month"))
    row = Window.partitionBy("invoice_month")
    base = F.max(F.when(F.col("first_month") == F.col("oldest"), F.col("customers"))).over(row)
    return (
        activity.withColumn("oldest", oldest)
        .withColumn("share", percent(F.col("customers"), base))
        .drop("oldest")
    )


def cohort_lines(retention: DataFrame) -> DataFrame:
    """One row per cohort: its number of months, and the retention of each in order.

    ``retentions`` is text with four digits per month, comma-separated and empty for a month
    without purchases, so every month of any data fits. A cohort has one element per month.
    """
    pairs = F.map_from_entries(F.collect_list(F.struct("months_since_first", "retention")))
    df = retention.groupBy("cohort_month").agg((F.max("months_since_first") + 1).alias("months"), pairs.alias("by"))
    digits = F.transform(
        F.sequence(F.lit(0), F.col("months") - 1),
        lambda m: F.coalesce(F.format_string("%.4f", F.rint(F.try_element_at("by", m) * 10000.0) / 10000.0), F.lit("")),
    )
    missing = F.transform(F.sequence(F.lit(0), F.col("months") - 1), lambda m: F.try_element_at("by", m).isNull())
    told = F.zip_with(digits, missing, lambda d, none: F.when(none, F.lit("")).otherwise(d))
    return df.select("cohort_month", "months", F.array_join(told, ",").alias("retentions"))


def cohort_wide(retention: DataFrame, months: int) -> DataFrame:
    """Retention as one row per cohort and one column per month, 0 to ``months``."""
    return (
        retention.groupBy("cohort_month")
        .pivot("months_since_first", list(range(months + 1)))
        .max("retention")
    )
