"""Statistical tests as distributed aggregations.

Only the summary row of each test carries a tail probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import calendar
from shopledger.functions.ratios import across
from shopledger.functions.tails import chi2_p_value, f_p_value
from shopledger.operators.products import by_price_segment, with_price_segment
from shopledger.operators.reports import spend_and_line_values
from shopledger.plans.distribution import long_form
from shopledger.plans.placement import RANGE, SLOT, place, running_sums

LEVEL = 0.05


def kruskal(
    df: DataFrame, value: str, group: str, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Kruskal-Wallis H with tie correction, per ``by``; null where fewer than two groups.

    Values are counted per (by, value, group); ties get their mean rank. ``ranges`` is the number
    of ranges that rank the counts, by default as many as their number asks for.
    """
    counts = (
        df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(*by, F.col(value).alias("value"), F.col(group).alias("sample"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = place(counts, [*by, "value"], by, ranges)
    ties = F.sum("n").over(Window.partitionBy(SLOT, *by, RANGE, "value")).cast("double")
    ranked = running_sums(placed, by, ["value"], ["n"]).withColumn("t", ties)
    n, t = F.col("n").cast("double"), F.col("t")
    mean_rank = F.col("n_upto") - t + (t + 1) / 2
    samples = ranked.groupBy(*by, "sample").agg(
        F.sum(n).alias("size"),
        F.sum(n * mean_rank).alias("rank_sum"),
        F.sum(n * (t * t - 1)).alias("tied"),
        F.max("n_all").cast("double").alias("all"),
    )
    size, all_ = F.col("size"), F.col("all")
    # Squared distances from the mean rank; equal to the usual form, without its cancellation.
    spread = F.sum(size * F.pow(F.col("rank_sum") / size - (all_ + 1) / 2, F.lit(2.0)))
    total = F.max("all")
    correction = 1 - F.try_divide(F.sum("tied"), F.pow(total, F.lit(3.0)) - total)
    return (
        samples.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.try_divide(spread * 12 / (total * (total + 1)), correction).alias("h"),
        )
        .withColumn("h_statistic", F.when(F.col("groups") > 1, F.col("h")))
        .withColumn("p_value", chi2_p_value("h_statistic", F.col("groups") - 1))
        .withColumn("significant", F.col("p_value") < LEVEL)
        .select(*by, "groups", "h_statistic", "p_value", "significant")
    )


def kruskal_customer_segments(cust: DataFrame, tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Customer spend, and line value, across the customer segments."""
    values = spend_and_line_values(cust, tx, lookup)
    return kruskal(values, "value", "customer_segment", ["measure"])


def kruskal_season_by_price_segment(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Line value across seasons, per price segment that sells in at least two."""
    season = calendar.season(F.col("invoice_date"))
    lines = with_price_segment(tx, lookup).withColumn("season", season)
    tests = kruskal(lines, "total_value", "season", ["price_segment"])
    return tests.where(F.col("groups") > 1)


def kruskal_price_segments(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Line value, and quantity, across the price segments, in one pass over the lines."""
    lines = with_price_segment(tx, lookup).withColumnsRenamed(
        {"total_value": "line_value", "quantity": "line_quantity"}
    )
    values = long_form(lines, ["line_value", "line_quantity"], ["price_segment"])
    return kruskal(values, "value", "price_segment", ["measure"])


def segment_season_correlation(tx: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Pearson r of a segment's season totals with the overall ones; null unless four seasons.

    With four points the two-sided p-value is 1 - |r|.
    """
    season = calendar.season(F.col("invoice_date")).alias("season")
    totals = by_price_segment(tx, lookup, [season], revenue=F.col("total_value"))
    overall = F.sum("revenue").over(Window.partitionBy("season"))
    totals = totals.withColumn("overall", overall.cast("double"))
    rho = F.corr(F.col("revenue").cast("double"), F.col("overall"))
    full = F.count(F.lit(1)) == len(calendar.SEASONS)
    return (
        totals.groupBy("price_segment")
        .agg(F.when(full, rho).alias("rho"))
        .withColumn("p_value", 1 - F.abs("rho"))
    )


def order_value_normality(tx: DataFrame) -> DataFrame:
    """D'Agostino-Pearson K squared of the order values; normal if p is above 0.05.

    Null below eight orders, for which the skewness score is not defined, and for equal values.
    """
    orders = tx.groupBy("invoice").agg(F.sum("total_value").cast("double").alias("value"))
    moments = orders.agg(
        F.count("value").cast("double").alias("n"),
        F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("excess"),
    )
    z1, z2 = _skew_score(F.col("n"), F.col("skew")), _kurtosis_score(F.col("n"), F.col("excess"))
    return (
        moments.withColumn("statistic", F.when(F.col("n") >= 8, z1 * z1 + z2 * z2))
        .withColumn("p_value", F.exp(-F.col("statistic") / 2))
        .withColumn("is_normal", F.col("p_value") > LEVEL)
        .select("statistic", "p_value", "is_normal")
    )


def _skew_score(n: Column, skew: Column) -> Column:
    """Normal score of the skewness (D'Agostino 1970)."""
    y = skew * F.sqrt(F.try_divide((n + 1) * (n + 3), 6 * (n - 2)))
    beta = F.try_divide(
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3), (n - 2) * (n + 5) * (n + 7) * (n + 9)
    )
    w2 = F.sqrt(2 * (beta - 1)) - 1
    return F.try_divide(F.asinh(F.try_divide(y, F.sqrt(F.try_divide(F.lit(2.0), w2 - 1)))), F.sqrt(F.log(w2) / 2))


def _kurtosis_score(n: Column, excess: Column) -> Column:
    """Normal score of the kurtosis (Anscombe and Glynn 1983)."""
    mean = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = F.try_divide(excess + 3 - mean, F.sqrt(variance))
    skew = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(F.try_divide(6 * (n + 3) * (n + 5), n * (n - 2) * (n - 3)))
    )
    over = lambda c, by: F.try_divide(F.lit(c), by)
    a = 6 + over(8.0, skew) * (over(2.0, skew) + F.sqrt(1 + over(4.0, skew * skew)))
    cube = F.cbrt(F.try_divide(1 - over(2.0, a), 1 + x * F.sqrt(over(2.0, a - 4))))
    return F.try_divide(1 - over(2.0, 9 * a) - cube, F.sqrt(over(2.0, 9 * a)))


def segment_anova(cust: DataFrame) -> DataFrame:
    """One-way F of customer spend across the customer segments."""
    value = F.col("total_spend").cast("double")
    groups = cust.groupBy("customer_segment").agg(
        F.count(value).cast("double").alias("n"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"),
    )
    grand = across(F.sum(F.col("n") * F.col("mean"))) / across(F.sum("n"))
    groups = groups.withColumn("between", F.col("n") * F.pow(F.col("mean") - grand, F.lit(2.0)))
    return (
        groups.agg(
            F.sum("between").alias("between"),
            F.sum(F.col("n") * F.col("var")).alias("within"),
            (F.count(F.lit(1)) - 1).cast("double").alias("df1"),
            (F.sum("n") - F.count(F.lit(1))).alias("df2"),
        )
        .withColumn(
            "f_statistic",
            F.try_divide(
                F.try_divide(F.col("between"), F.col("df1")),
                F.try_divide(F.col("within"), F.col("df2")),
            ),
        )
        .withColumn("p_value", f_p_value("f_statistic", "df1", "df2"))
        .withColumn("significant", F.col("p_value") < LEVEL)
        .select("f_statistic", "p_value", "significant")
    )
