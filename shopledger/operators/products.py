"""Products, price segments and sales by price segment.

Reports by price segment sum the lines per product first and look the segment up afterwards, so
the join sees product rows, not invoice lines. Where a report needs sums only, the segments come
out of the same pass over the lines; ``lookup`` gives segments found elsewhere, such as those of
the whole data when ``tx`` is one period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import calendar, segments
from shopledger.functions.ratios import across, percent, ratio
from shopledger.plans.distribution import Distribution, long_form, one_row_quantiles
from shopledger.plans.pinning import pin
from shopledger.plans.placement import place, running_sums
from shopledger.plans.rows import with_row

def product_stats(tx: DataFrame) -> DataFrame:
    """First description, mean price, quantity and revenue per product.

    The first description is that of the earliest invoice date; equal dates go by text. Lines are
    combined per (product, text) first, which keeps the large step a hash aggregation.
    """
    per_text = tx.groupBy("stock_code", "description").agg(
        F.min("invoice_date").alias("seen"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("prices"),
        F.sum("quantity").alias("quantity"),
        F.sum("total_value").alias("revenue"),
    )
    age = F.when(F.col("description").isNotNull(), F.struct("seen", "description"))
    return per_text.groupBy("stock_code").agg(
        F.min_by("description", age).alias("description"),
        (F.sum("price_sum").cast("double") / F.sum("prices")).alias("mean_price"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("revenue").alias("revenue"),
    )


def product_prices(tx: DataFrame) -> DataFrame:
    """(stock_code, mean_price), pinned for the quartiles and the rows they apply to."""
    mean = F.sum("price").cast("double") / F.count("price")
    return pin(tx.groupBy("stock_code").agg(mean.alias("mean_price")), "prices")


def price_thresholds(prices: DataFrame) -> DataFrame:
    """Quartiles of the products' mean prices, in one row."""
    return one_row_quantiles(prices, ["mean_price"]).select(
        F.col("mean_price_q1").alias("q1"),
        F.col("mean_price_median").alias("median"),
        F.col("mean_price_q3").alias("q3"),
    )


def price_segments(prices: DataFrame) -> DataFrame:
    """Budget, Regular, Premium or Luxury by the quartile of the mean price."""
    cut = F.col("_cut")
    name = segments.price_segment(F.col("mean_price"), cut["q1"], cut["median"], cut["q3"])
    with_cut = with_row(prices, price_thresholds(prices), "_cut")
    return with_cut.withColumn("price_segment", name).drop("_cut")


def price_segment_lookup(tx: DataFrame) -> DataFrame:
    """(stock_code, price_segment); a projection of a pinned table, so the planner knows its
    size when it joins lines to it."""
    return price_segments(product_prices(tx)).select("stock_code", "price_segment")


def with_price_segment(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """The product's segment on every line."""
    return tx.join(lookup, "stock_code", "left")


def by_price_segment(
    tx: DataFrame,
    lookup: DataFrame | None = None,
    keys: Sequence[str | Column] = (),
    **sums: Column,
) -> DataFrame:
    """Sums of ``sums`` per (price_segment, keys), combined per product before the lookup.

    Without ``lookup`` the segments follow from the prices in ``tx`` itself, which are summed in
    the same pass over the lines.
    """
    parts = {name: F.sum(c).alias(name) for name, c in sums.items()}
    if lookup is None:
        parts["_price_sum"] = F.sum("price").alias("_price_sum")
        parts["_prices"] = F.count("price").alias("_prices")
    per_product = tx.groupBy("stock_code", *keys).agg(*parts.values())
    names = [c for c in per_product.columns if c not in ("stock_code", *parts)]
    if lookup is None:
        per_product = pin(per_product, "products")
        mean = F.sum("_price_sum").cast("double") / F.sum("_prices")
        prices = per_product.groupBy("stock_code").agg(mean.alias("mean_price"))
        lookup = price_segments(prices).select("stock_code", "price_segment")
    return (
        with_price_segment(per_product, lookup)
        .groupBy("price_segment", *names)
        .agg(*[F.sum(name).alias(name) for name in sums])
    )


def _season() -> Column:
    return calendar.season(F.col("invoice_date")).alias("season")


def segment_season_stats(tx: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Revenue, mean line value and line count per (price segment, season)."""
    rows = by_price_segment(
        tx, lookup, [_season()], revenue=F.col("total_value"), num_lines=F.lit(1)
    )
    return rows.withColumn("avg_line_value", ratio(F.col("revenue"), F.col("num_lines")))


def segment_season_pivot(stats: DataFrame, fill: float | None = 0) -> DataFrame:
    """Revenue as one row per segment and one column per season."""
    wide = stats.groupBy("price_segment").pivot("season", list(calendar.SEASONS)).sum("revenue")
    return wide if fill is None else wide.fillna(fill, list(calendar.SEASONS))


def price_segment_share(tx: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Revenue and share of revenue per price segment."""
    rows = by_price_segment(tx, lookup, revenue=F.col("total_value"))
    return rows.withColumn("share", percent(F.col("revenue"), across(F.sum("revenue"))))


def season_revenue(tx: DataFrame) -> DataFrame:
    """Revenue and mean line value per season."""
    return (
        tx.groupBy(_season())
        .agg(F.sum("total_value").alias("revenue"), F.count(F.lit(1)).alias("num_lines"))
        .withColumn("avg_line_value", ratio(F.col("revenue"), F.col("num_lines")))
    )


def top_products(tx: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` products of highest revenue, with description and price segment."""
    products = pin(product_stats(tx), "products")
    named = price_segments(products)
    return named.orderBy(F.desc("revenue"), "stock_code").limit(k)


def price_ranges(tx: DataFrame, prices: DataFrame) -> DataFrame:
    """Price range of each segment; the last one ends at the highest line price."""
    top = tx.agg(F.max("price").cast("double").alias("top"))
    cut = F.col("_cut")
    edges = F.array(F.lit(0.0), cut["q1"], cut["median"], cut["q3"], F.col("top"))
    names = F.posexplode(F.lit(list(segments.PRICE_SEGMENTS)))
    rows = with_row(top, price_thresholds(prices), "_cut").select(edges.alias("edges"), names)
    return rows.select(
        F.col("col").alias("price_segment"),
        F.col("edges")[F.col("pos")].alias("low"),
        F.col("edges")[F.col("pos") + 1].alias("high"),
    )


def price_stats_by_segment(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Line price statistics, products and share of products per price segment."""
    by = ["price_segment"]
    lines = Distribution(long_form(with_price_segment(tx, lookup), ["price"], by), by).describe()
    products = lookup.groupBy("price_segment").agg(F.count(F.lit(1)).alias("num_products"))
    share = percent(F.col("num_products"), across(F.sum("num_products")))
    return (
        lines.join(products, "price_segment")
        .withColumn("product_share", share)
        .select(
            "price_segment",
            *[F.col(c).alias(f"{c}_price") for c in ("min", "max", "mean", "median", "std")],
            "num_products",
            "product_share",
        )
    )


def segment_sales_performance(tx: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Lines, quantity and value per price segment, their shares, and value per line."""
    rows = by_price_segment(
        tx,
        lookup,
        num_lines=F.lit(1),
        quantity=F.col("quantity"),
        revenue=F.col("total_value"),
    )
    return rows.withColumns(
        {
            "quantity_share": percent(F.col("quantity"), across(F.sum("quantity"))),
            "revenue_share": percent(F.col("revenue"), across(F.sum("revenue"))),
            "avg_line_value": ratio(F.col("revenue"), F.col("num_lines")),
        }
    )


def segment_performance_normalized(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Value, quantity and customers per price segment, each also relative to the largest.

    Lines are combined per (segment, customer) first; the distinct customers are then a count.
    """
    per_customer = (
        with_price_segment(tx, lookup)
        .groupBy("price_segment", "customer_id")
        .agg(F.sum("total_value").alias("revenue"), F.sum("quantity").alias("quantity"))
    )
    rows = per_customer.groupBy("price_segment").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.count("customer_id").alias("customers"),
    )
    return rows.withColumns(
        {
            f"{c}_norm": ratio(F.col(c), across(F.max(c)))
            for c in ("revenue", "quantity", "customers")
        }
    )


def ranked_products(tx: DataFrame) -> DataFrame:
    """Products by rising revenue with running count and running revenue."""
    sales = (
        tx.groupBy("stock_code")
        .agg(F.sum("total_value").alias("revenue"))
        .withColumn("one", F.lit(1))
    )
    order = ["revenue", "stock_code"]
    return running_sums(place(sales, order), [], order, ["one", "revenue"])


def lorenz_curve(ranked: DataFrame) -> DataFrame:
    """Cumulative share of products against cumulative share of revenue, lowest first."""
    return ranked.select(
        "stock_code",
        ratio(F.col("one_upto"), F.col("one_all")).alias("product_share"),
        ratio(F.col("revenue_upto"), F.col("revenue_all")).alias("revenue_share"),
    )


def top_share_concentration(ranked: DataFrame, share: float = 0.05) -> DataFrame:
    """Products, how many of them make the top ``share`` (at least 1), and their revenue share."""
    top = F.greatest(F.lit(1), F.floor(F.col("one_all") * F.lit(share)))
    is_top = F.col("one_upto") > F.col("one_all") - top
    return ranked.agg(
        F.max("one_all").alias("products"),
        F.max(top).alias("top_products"),
        percent(F.sum(F.when(is_top, F.col("revenue"))), F.max("revenue_all")).alias(
            "top_revenue_share"
        ),
    )


def customer_purchases(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Per (customer, price segment): the earliest line and the value.

    ``first_line`` orders lines by date and, at one instant, by product code.
    """
    return (
        with_price_segment(tx, lookup)
        .groupBy("customer_id", "price_segment")
        .agg(
            F.min(F.struct("invoice_date", "stock_code")).alias("first_line"),
            F.sum("total_value").alias("revenue"),
        )
    )


def initial_segment(bought: DataFrame) -> DataFrame:
    """Price segment of each customer's earliest line."""
    return bought.groupBy("customer_id").agg(
        F.min_by("price_segment", "first_line").alias("initial_segment")
    )


def cross_sell_matrix(bought: DataFrame, base: str = "row") -> DataFrame:
    """Customers by (initial segment, bought segment), and as percent of the row.

    A customer counts once in every segment bought, the initial one included. ``base="row"``
    divides by the row sum, ``base="customers"`` by the customers of the initial segment.
    """
    flags = {
        s: F.max(F.when(F.col("price_segment") == s, 1).otherwise(0)).alias(s)
        for s in segments.PRICE_SEGMENTS
    }
    first = F.min_by("price_segment", "first_line").alias("initial_segment")
    per_customer = bought.groupBy("customer_id").agg(first, *flags.values())
    counts = per_customer.groupBy("initial_segment").agg(
        F.count(F.lit(1)).alias("starters"), *[F.sum(s).alias(s) for s in flags]
    )
    long = counts.unpivot(
        ["initial_segment", "starters"], list(flags), "next_segment", "customers"
    )
    whole = F.sum("customers").over(Window.partitionBy("initial_segment"))
    if base == "customers":
        whole = F.col("starters")
    return long.withColumn("share", percent(F.col("customers"), whole)).drop("starters")


def cross_sell_wide(matrix: DataFrame) -> DataFrame:
    """The percentages as one row per initial segment."""
    columns = list(segments.PRICE_SEGMENTS)
    wide = matrix.groupBy("initial_segment").pivot("next_segment", columns).sum("share")
    return wide.fillna(0, columns)


def segment_affinity(bought: DataFrame, customer_lookup: DataFrame) -> DataFrame:
    """Revenue by (customer segment, price segment), and as percent of the customer segment."""
    rows = (
        bought.join(customer_lookup, "customer_id", "left")
        .groupBy("customer_segment", "price_segment")
        .agg(F.sum("revenue").alias("revenue"))
    )
    whole = F.sum("revenue").over(Window.partitionBy("customer_segment"))
    return rows.withColumn("share", percent(F.col("revenue"), whole))


def segment_affinity_wide(affinity: DataFrame) -> DataFrame:
    """The percentages as one row per customer segment."""
    columns = list(segments.PRICE_SEGMENTS)
    wide = affinity.groupBy("customer_segment").pivot("price_segment", columns).sum("share")
    return wide.fillna(0, columns)
