"""Headline findings as one-row frames, and the list of business insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions.ratios import percent, percent_change
from shopledger.operators.products import price_segment_share, season_revenue


def vip_revenue_share(cust: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """Percent of revenue from VIP customers.

    The revenue is the customers' total spend, or that of ``tx`` (say, of one period), summed
    per customer before the segments are looked up.
    """
    rows = cust.select("customer_segment", F.col("total_spend").alias("spend"))
    if tx is not None:
        spend = tx.groupBy("customer_id").agg(F.sum("total_value").alias("spend"))
        rows = spend.join(cust.select("customer_id", "customer_segment"), "customer_id")
    vip = F.when(F.col("customer_segment") == "VIP", F.col("spend"))
    return rows.agg(percent(F.sum(vip), F.sum("spend")).alias("vip_share"))


def season_gap(tx: DataFrame) -> DataFrame:
    """Best and worst season by revenue, and the gap in percent; equal revenues go by name."""
    return season_revenue(tx).agg(
        F.max_by("season", F.struct("revenue", "season")).alias("best_season"),
        F.min_by("season", F.struct("revenue", "season")).alias("worst_season"),
        percent_change(F.min("revenue"), F.max("revenue")).alias("gap_pct"),
    )


def dominant_price_segment(tx: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Price segment of highest revenue and its share."""
    return price_segment_share(tx, lookup).agg(
        F.max_by("price_segment", F.struct("revenue", "price_segment")).alias("price_segment"),
        F.max("share").alias("share"),
    )


def business_insights(
    tx: DataFrame, cust: DataFrame, price_lookup: DataFrame | None = None
) -> DataFrame:
    """Three rows of title, finding, action, impact and priority."""

    def row(df: DataFrame, title: str, finding: Column, action: Column, impact: str, rank: str):
        return df.select(
            F.lit(title).alias("title"),
            finding.alias("finding"),
            action.alias("action"),
            F.lit(impact).alias("impact"),
            F.lit(rank).alias("priority"),
        )

    vip = row(
        vip_revenue_share(cust),
        "VIP customers",
        F.format_string("VIP customers bring %.1f%% of revenue", "vip_share"),
        F.lit("Run a personal VIP programme"),
        "+15% VIP retention",
        "High",
    )
    season = row(
        season_gap(tx),
        "Seasons",
        F.format_string(
            "Revenue differs by %.1f%% between %s and %s", "gap_pct", "best_season", "worst_season"
        ),
        F.format_string("Adjust the inventory for %s", "worst_season"),
        "+20% revenue in the low season",
        "Medium",
    )
    price = row(
        dominant_price_segment(tx, price_lookup),
        "Leading price segment",
        F.format_string("The %s segment brings %.1f%% of revenue", "price_segment", "share"),
        F.format_string("Extend the %s range", "price_segment"),
        "+15% total revenue",
        "High",
    )
    return vip.unionByName(season).unionByName(price)
