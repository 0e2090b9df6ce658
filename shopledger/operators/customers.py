"""Customer features, RFM scores and segments, lifetime value, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import segments
from shopledger.plans.distribution import one_row_quantiles
from shopledger.plans.pinning import pin
from shopledger.plans.placement import place, running_sums
from shopledger.plans.rows import with_row


def customer_features(tx: DataFrame) -> DataFrame:
    """One row per customer. ``avg_line_value`` is the mean over invoice lines.

    One aggregation: both distinct counts are combined on the map side per
    (customer, invoice) and (customer, item), so a customer with very many lines is spread.
    """
    return (
        tx.groupBy("customer_id")
        .agg(
            F.count_distinct("invoice").alias("num_orders"),
            F.count(F.lit(1)).alias("num_lines"),
            F.sum("total_value").alias("total_spend"),
            F.min("invoice_date").alias("first_purchase"),
            F.max("invoice_date").alias("last_purchase"),
            F.count_distinct("stock_code").alias("unique_items"),
            F.sum("quantity").alias("total_items"),
        )
        .withColumn("avg_line_value", F.col("total_spend").cast("double") / F.col("num_lines"))
    )


def with_tenure(cust: DataFrame) -> DataFrame:
    """Whole elapsed days between the first and the last purchase."""
    days = F.timestamp_diff("DAY", F.col("first_purchase"), F.col("last_purchase"))
    return cust.withColumn("tenure_days", days)


def with_purchase_rate(cust: DataFrame) -> DataFrame:
    """Orders per day of tenure; a tenure below one day counts as one."""
    days = F.greatest(F.col("tenure_days"), F.lit(1))
    return cust.withColumn("frequency", F.col("num_orders") / days)


def with_days_since_last(cust: DataFrame) -> DataFrame:
    """Calendar days from a customer's last purchase to the last purchase of all."""
    newest = cust.agg(F.max("last_purchase")).scalar()
    return cust.withColumn("days_since_last", F.datediff(newest, F.col("last_purchase")))


def customer_base(tx: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Features with tenure and rate, pinned: the fact table is read once for all uses.

    ``columns`` keeps only the named features (besides the key), so the aggregation skips
    the others.
    """
    base = with_purchase_rate(with_tenure(customer_features(tx)))
    return pin(base.select("customer_id", *columns) if columns else base, "customers")


SCORED = ("tenure_days", "frequency", "total_spend")


def rfm_scores(cust: DataFrame, recency: str = "tenure_days") -> DataFrame:
    """Scores 1 to 4 by exact quartiles; a short ``recency`` scores high.

    ``recency`` may be ``tenure_days`` or ``days_since_last``.
    """
    if recency == "days_since_last" and recency not in cust.columns:
        cust = with_days_since_last(cust)
    limits = one_row_quantiles(cust, [recency, "frequency", "total_spend"])

    def cuts(name: str) -> list[Column]:
        return [F.col("_limits")[f"{name}_{q}"] for q in ("q1", "median", "q3")]

    spend = F.col("total_spend").cast("double")
    scores = {
        "r_score": segments.score_low(F.col(recency), *cuts(recency)),
        "f_score": segments.score_high(F.col("frequency"), *cuts("frequency")),
        "m_score": segments.score_high(spend, *cuts("total_spend")),
    }
    return with_row(cust, limits, "_limits").withColumns(scores).drop("_limits")


def customer_segments(scored: DataFrame) -> DataFrame:
    """VIP, Loyal, Regular or At Risk from the mean of the three scores."""
    names = segments.customer_segment(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    return scored.withColumn("customer_segment", names)


def customer_table(
    tx: DataFrame, columns: Sequence[str] = (), recency: str = "tenure_days"
) -> DataFrame:
    """Features, scores and segment of every customer.

    ``columns`` names the features wanted besides the scored ones.
    """
    if recency == "days_since_last" and columns:
        columns = [*columns, "last_purchase"]
    keep = [*SCORED, *[c for c in columns if c not in SCORED]] if columns else ()
    return customer_segments(rfm_scores(customer_base(tx, keep), recency))


def segment_lookup(tx: DataFrame) -> DataFrame:
    """(customer_id, customer_segment); a projection of a pinned table, so the planner knows
    its size when it joins lines to it."""
    return customer_table(tx, SCORED).select("customer_id", "customer_segment")


def customer_spend(tx: DataFrame, cust: DataFrame | None = None) -> DataFrame:
    """Orders and total spend of each customer in one pass, or the spend joined to ``cust``."""
    spend = F.sum("total_value").alias("line_spend")
    if cust is None:
        return tx.groupBy("customer_id").agg(F.count_distinct("invoice").alias("num_orders"), spend)
    return cust.join(tx.groupBy("customer_id").agg(spend), "customer_id", "left")


def spend_band_segments(
    cust: DataFrame, edges: Sequence[float] = segments.SPEND_EDGES
) -> DataFrame:
    """Segment by fixed right-closed spend bands; null outside them."""
    return cust.withColumn("spend_band", segments.spend_band(F.col("total_spend"), edges))


def rfm_analysis(tx: DataFrame) -> DataFrame:
    """Days since the last purchase, distinct invoices and spend per customer."""
    per_customer = pin(
        tx.groupBy("customer_id").agg(
            F.max("invoice_date").alias("last_purchase"),
            F.count_distinct("invoice").alias("frequency"),
            F.sum("total_value").alias("monetary"),
        ),
        "rfm",
    )
    return with_days_since_last(per_customer).select(
        "customer_id", F.col("days_since_last").alias("recency"), "frequency", "monetary"
    )


RFM = ("recency", "frequency", "monetary")


def rfm_quartiles(rfm: DataFrame, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """One row with an array of three quartiles per measure.

    ``exact=False`` reads sketches in one pass instead of ranking the values.
    """
    if not exact:
        return rfm.agg(
            *[
                F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], accuracy).alias(
                    f"{c}_quartiles"
                )
                for c in RFM
            ]
        )
    row = one_row_quantiles(rfm, RFM)
    return row.select(
        *[F.array(f"{c}_q1", f"{c}_median", f"{c}_q3").alias(f"{c}_quartiles") for c in RFM]
    )


def quartiles_within(rfm: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Whether each approximate quartile is right: its ranks lie within n / ``accuracy`` of the
    wanted one. One pass for the sketches, one to count the rows below and up to each."""
    near = rfm_quartiles(rfm, exact=False).first()
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    checks = []
    for c in RFM:
        for (name, p), value in zip(shares.items(), near[f"{c}_quartiles"]):
            x, n = F.col(c).cast("double"), F.count(c)
            below = F.count(F.when(x < value, 1)) <= n * p + n / accuracy + 1
            upto = F.count(F.when(x <= value, 1)) >= n * p - n / accuracy - 1
            checks.append((below & upto).alias(f"{c}_{name}"))
    return rfm.agg(*checks)


def clv_analysis(tx: DataFrame) -> DataFrame:
    """Spend per day between first and last purchase; null for one-day customers."""
    return (
        tx.groupBy("customer_id")
        .agg(
            F.sum("total_value").alias("total_spend"),
            F.count("invoice").alias("num_transactions"),
            F.datediff(F.max("invoice_date"), F.min("invoice_date")).alias(
                "customer_lifetime_days"
            ),
        )
        .withColumn("avg_transaction", F.col("total_spend").cast("double") / F.col("num_transactions"))
        .withColumn(
            "clv_score",
            F.try_divide(F.col("total_spend").cast("double"), F.col("customer_lifetime_days")),
        )
    )


def running_total(tx: DataFrame, key: str) -> DataFrame:
    """Running value per ``key`` in date order on every line; lines of one instant share it.

    Lines are summed per (key, instant) first, so the ordered part works on those sums, and a
    key that holds most lines is spread by its dates.
    """
    summed = tx.groupBy(key, "invoice_date").agg(F.sum("total_value").alias("value"))
    totals = running_sums(
        place(summed, [key, "invoice_date"], [key]), [key], ["invoice_date"], ["value"]
    ).select(
        F.col(key).alias("_key"),
        F.col("invoice_date").alias("_date"),
        F.col("value_upto").alias("running_total"),
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("invoice_date").eqNullSafe(F.col("_date"))
    return tx.join(totals, same).drop("_key", "_date")


def running_total_by_month(tx: DataFrame, by: str = "month") -> DataFrame:
    """Partitioned by month of the year (years mixed), or by ``year_month``."""
    part = F.month("invoice_date") if by == "month" else F.trunc("invoice_date", "month")
    return running_total(tx.withColumn(by, part), by)


def running_total_by_customer(tx: DataFrame) -> DataFrame:
    return running_total(tx, "customer_id")


def retention_labels(cust: DataFrame, year: int, include_new: bool = True) -> DataFrame:
    """1 if the last purchase lies in ``year``; without ``include_new`` the first must precede it."""
    kept = F.year("last_purchase") == year
    if not include_new:
        kept = kept & (F.year("first_purchase") < year)
    return cust.withColumn("is_retained", kept.cast("int"))


def retention_label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("is_retained").agg(F.count(F.lit(1)).alias("customers"))
