"""Every registered query: its name, its result shape and how it is built from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.functions import calendar
from shopledger.operators import classifiers as ml
from shopledger.operators import cleaning, customers, dependence, evaluation, insights
from shopledger.operators import periods, products, reports, stats, uniques
from shopledger.plans.pinning import pin
from shopledger.plans.results import shaped
from shopledger.sources import testdata
from shopledger.sources.readers import apply_schema

# The last two complete years of the given orders.
Y0, Y1 = 1999, 2000
PERIOD = ("1996-03-01", "1997-02-28")


class Given:
    """Tables of one query run, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, *extra: str) -> DataFrame:
        return testdata.raw_lines(self.spark, self.folder, extra)

    def lines(self, *extra: str) -> DataFrame:
        return testdata.lines(self.spark, self.folder, extra)

    @cached_property
    def tx(self) -> DataFrame:
        return self.lines()

    @cached_property
    def events(self) -> DataFrame:
        return testdata.event_lines(self.spark, self.folder)

    @cached_property
    def parts(self) -> DataFrame:
        """The stored order lines and events, read as two parts; each lacks some columns."""
        return testdata.stored(self.spark, self.folder)

    def cust(self, *columns: str) -> DataFrame:
        """Scored and segmented customers, with the named features beside the scored ones."""
        return customers.customer_table(self.tx, columns or customers.SCORED)

    def cust_pinned(self, *columns: str) -> DataFrame:
        return pin(self.cust(*columns), "customer_table")

    def cust_with_lines(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Segmented customers, the lines, and the segment lookup, of one pinned table."""
        cust = self.cust_pinned()
        return cust, self.tx, cust.select("customer_id", "customer_segment")

    @cached_property
    def cust_lookup(self) -> DataFrame:
        return customers.segment_lookup(self.tx)

    @cached_property
    def price_lookup(self) -> DataFrame:
        return products.price_segment_lookup(self.tx)

    @cached_property
    def prices(self) -> DataFrame:
        return products.product_prices(self.tx)

    @cached_property
    def rfm(self) -> DataFrame:
        return customers.rfm_analysis(self.tx)

    def base(self, *columns: str) -> DataFrame:
        return customers.customer_base(self.tx, columns)

    @cached_property
    def rule_predictions(self) -> DataFrame:
        """VIP label against the plain rule "spend in the top quarter"."""
        return pin(
            self.cust().select(
                (F.col("customer_segment") == "VIP").cast("int").alias("label"),
                (F.col("m_score") == 4).cast("int").alias("prediction"),
            ),
            "rule",
        )

    @cached_property
    def vip_frames(self) -> tuple[DataFrame, DataFrame]:
        return ml.vip_frames(self.cust(*ml.VIP_FEATURES))

    @cached_property
    def retention_frames(self) -> tuple[DataFrame, DataFrame]:
        return self.retention(True)

    def retention(self, include_new: bool) -> tuple[DataFrame, DataFrame]:
        features = [*ml.RETENTION_FEATURES, "first_purchase", "last_purchase"]
        return ml.retention_frames(self.base(*features), Y1, include_new)


@dataclass(frozen=True)
class Query:
    shape: str
    build: Callable[[Given], DataFrame]

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return shaped(self.build(Given(spark, folder)), self.shape)


def _source_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("num_lines"),
        F.count("stock_code").alias("with_stock_code"),
        F.count("invoice_date").alias("with_invoice_date"),
        F.count("customer_id").alias("with_customer_id"),
        F.sum("quantity").alias("quantity"),
        F.sum("price").alias("price"),
    )


LINE = "invoice:s, stock_code:s, customer_id:s, quantity:i, price:4, invoice_date:t"
FEATURES = (
    "customer_id:s, num_orders:i, total_spend:4, avg_line_value:4, first_purchase:t,"
    "last_purchase:t, unique_items:i, total_items:i"
)
STATS = "count:i, total:4, mean:4, std:2, min:4, q1:4, median:4, q3:4, max:4"
BOX = "measure:s, q1:8, median:8, q3:8, low_whisker:8, high_whisker:8, outliers:i"
TEST = "groups:i, h_statistic:6, p_value:8, significant:b"


def _train_sides(given: Given) -> DataFrame:
    train, test = evaluation.train_test_split(given.base("num_orders"))
    sides = [d.select("customer_id", F.lit(s).alias("is_train")) for d, s in ((train, True), (test, False))]
    return sides[0].unionByName(sides[1])


def _scaled(given: Given) -> DataFrame:
    features = ml.VIP_FEATURES
    train, test = evaluation.train_test_split(given.base(*features))
    fitted = evaluation.scaling(train, features)
    both = [evaluation.standard_scale(d, fitted, features) for d in (train, test)]
    return both[0].unionByName(both[1])


def _vip_models(given: Given) -> DataFrame:
    train, test = given.vip_frames
    return ml.vip_reports(ml.fit_vip_classifiers(train), test)


def _vip_importances(given: Given) -> DataFrame:
    train, _ = given.vip_frames
    return ml.vip_importances(ml.fit_vip_classifiers(train), train)


def _retention(given: Given, fit: Callable, include_new: bool = True) -> DataFrame:
    train, test = given.retention(include_new)
    return evaluation.classification_report(fit(train).transform(test))


def _tree_rules(given: Given) -> DataFrame:
    train, _ = given.retention_frames
    return ml.tree_rules(ml.retention_tree(train), ml.RETENTION_FEATURES, train)


def _dependence(given: Given, fit: Callable) -> DataFrame:
    train, _ = given.retention_frames
    return dependence.partial_dependence(fit(train), train)


def _best_model(given: Given) -> DataFrame:
    train, test = given.retention_frames
    _, search = ml.grid_search(train, refit=True)
    return ml.best_model_report(search, test)


REPORT = "class:s, precision:6, recall:6, f1:6, support:i"
SPEND = "customer_id:s, total_spend:4"
SIDES = "before:4, after:4, growth_pct:1"
COMPARE = "metric:s, before:4, after:4, change_pct:1, change:4"

QUERIES: dict[str, Query] = {
    # Sources, cleaning
    "read_transactions": Query(
        "num_lines:i, with_stock_code:i, with_invoice_date:i, with_customer_id:i, quantity:i, price:4",
        lambda g: _source_totals(g.parts),
    ),
    "read_single": Query(
        "num_lines:i, with_stock_code:i, with_invoice_date:i, with_customer_id:i, quantity:i, price:4",
        lambda g: _source_totals(testdata.stored_lines(g.spark, g.folder)),
    ),
    "apply_schema": Query(
        "invoice:s, stock_code:s, customer_id:s, quantity:i, price:4, invoice_date:t",
        lambda g: apply_schema(g.raw()),
    ),
    "clean_transactions": Query(LINE, lambda g: cleaning.clean_transactions(g.raw())),
    "dataset_overview": Query(
        "total_revenue:4, unique_customers:i, total_transactions:i, avg_order_value:4",
        lambda g: cleaning.dataset_overview(g.tx),
    ),
    "filter_period": Query(
        LINE + ", total_value:4", lambda g: cleaning.filter_period(g.tx, *PERIOD)
    ),
    # Products, time
    "product_stats": Query(
        "stock_code:s, description:s, mean_price:4, total_quantity:i",
        lambda g: products.product_stats(g.lines("description")),
    ),
    "price_thresholds": Query(
        "q1:4, median:4, q3:4", lambda g: products.price_thresholds(g.prices)
    ),
    "price_segments": Query(
        "stock_code:s, mean_price:4, price_segment:s", lambda g: products.price_segments(g.prices)
    ),
    "with_price_segment": Query(
        LINE + ", price_segment:s", lambda g: products.with_price_segment(g.tx, g.price_lookup)
    ),
    "with_calendar": Query(
        "invoice:s, invoice_date:t, month:i, day_of_week:i, hour:i",
        lambda g: cleaning.with_calendar(
            g.events.select("invoice", "invoice_date").unionByName(g.raw().select("invoice", "invoice_date"))
        ),
    ),
    "with_season": Query(
        "invoice:s, stock_code:s, invoice_date:t, quantity:i, price:4, season:s",
        lambda g: cleaning.with_season(g.tx),
    ),
    "with_holiday_flag": Query(
        "invoice:s, stock_code:s, invoice_date:t, quantity:i, price:4, is_holiday_season:b",
        lambda g: cleaning.with_holiday_flag(g.tx),
    ),
    "with_year_month": Query(
        "invoice:s, stock_code:s, quantity:i, price:4, year:i, month:i, year_month:m",
        lambda g: cleaning.with_year_month(g.tx),
    ),
    # Customers
    "customer_features": Query(FEATURES, lambda g: customers.customer_features(g.tx)),
    "customer_tenure": Query(
        "customer_id:s, tenure_days:i",
        lambda g: customers.with_tenure(customers.customer_features(g.tx)),
    ),
    "purchase_rate": Query(
        "customer_id:s, num_orders:i, tenure_days:i, frequency:8",
        lambda g: g.base("num_orders", "tenure_days", "frequency"),
    ),
    "rfm_scores": Query(
        "customer_id:s, r_score:i, f_score:i, m_score:i",
        lambda g: customers.rfm_scores(g.base(*customers.SCORED)),
    ),
    "rfm_scores_days_since_last": Query(
        "customer_id:s, r_score:i, f_score:i, m_score:i, customer_segment:s",
        lambda g: customers.customer_table(g.tx, customers.SCORED, "days_since_last"),
    ),
    "customer_segments": Query(
        "customer_id:s, r_score:i, f_score:i, m_score:i, customer_segment:s", lambda g: g.cust()
    ),
    "customer_spend": Query(
        "customer_id:s, num_orders:i, line_spend:4", lambda g: customers.customer_spend(g.tx)
    ),
    "spend_band_segments": Query(
        SPEND + ", spend_band:s",
        lambda g: customers.spend_band_segments(customers.customer_features(g.tx)),
    ),
    "rfm_analysis": Query("customer_id:s, recency:i, frequency:i, monetary:4", lambda g: g.rfm),
    "rfm_quartiles": Query(
        ", ".join(f"{c}_{q}:4" for c in customers.RFM for q in ("q1", "median", "q3")),
        lambda g: customers.rfm_quartiles(g.rfm).select(
            *[
                F.col(f"{c}_quartiles")[i].alias(f"{c}_{q}")
                for c in customers.RFM
                for i, q in enumerate(("q1", "median", "q3"))
            ]
        ),
    ),
    "rfm_quartiles_approx": Query(
        ", ".join(f"{c}_{q}:b" for c in customers.RFM for q in ("q1", "median", "q3")),
        lambda g: customers.quartiles_within(g.rfm),
    ),
    "clv_analysis": Query(
        SPEND + ", avg_transaction:4, num_transactions:i, customer_lifetime_days:i, clv_score:4",
        lambda g: customers.clv_analysis(g.tx),
    ),
    "running_total_by_month": Query(
        LINE + ", total_value:4, running_total:4",
        lambda g: customers.running_total_by_month(g.tx),
    ),
    "running_total_by_year_month": Query(
        LINE + ", total_value:4, running_total:4",
        lambda g: customers.running_total_by_month(g.tx, by="year_month"),
    ),
    "running_total_by_customer": Query(
        LINE + ", total_value:4, running_total:4",
        lambda g: customers.running_total_by_customer(g.tx),
    ),
    "retention_labels": Query(
        "customer_id:s, is_retained:i, is_retained_old:i",
        lambda g: customers.retention_labels(
            customers.retention_labels(customers.customer_features(g.tx), Y1, False)
            .withColumnRenamed("is_retained", "is_retained_old"),
            Y1,
        ),
    ),
    "retention_label_counts": Query(
        "is_retained:i, customers:i",
        lambda g: customers.retention_label_counts(
            customers.retention_labels(customers.customer_features(g.tx), Y1)
        ),
    ),
    # KPIs, segment reports
    "kpis": Query(
        "total_revenue:4, avg_order_value:4, total_orders:i, total_customers:i, vip_percentage:4",
        lambda g: reports.kpis(g.tx, g.cust_lookup),
    ),
    "segment_distribution": Query(
        "customer_segment:s, customers:i, share:4", lambda g: reports.segment_distribution(g.cust())
    ),
    "spend_histogram": Query(
        "bin:i, low:4, high:4, customers:i",
        lambda g: reports.spend_histogram(g.base("total_spend")),
    ),
    "spend_histogram_by_segment": Query(
        "customer_segment:s, bin:i, low:4, high:4, customers:i",
        lambda g: reports.spend_histogram_by_segment(g.cust_pinned()),
    ),
    "clv_histogram": Query(
        "bin:i, low:4, high:4, customers:i",
        lambda g: reports.clv_histogram(
            pin(customers.clv_analysis(g.tx).select("customer_id", "clv_score"), "clv")
        ),
    ),
    "avg_order_value_by_segment": Query(
        "customer_segment:s, avg_order_value:4",
        lambda g: reports.avg_order_value_by_segment(g.cust("avg_line_value")),
    ),
    "describe_spend_by_segment": Query(
        "customer_segment:s, " + STATS, lambda g: reports.describe_spend_by_segment(g.cust())
    ),
    "describe_line_value_by_segment": Query(
        "customer_segment:s, " + STATS,
        lambda g: reports.describe_line_value_by_segment(g.tx, g.cust_lookup),
    ),
    "rfm_profile": Query(
        "customer_segment:s, r_score:6, f_score:6, m_score:6",
        lambda g: reports.rfm_profile(g.cust()),
    ),
    "rfm_summary": Query(
        "customer_segment:s, r_score:2, f_score:2, m_score:2, avg_score:2",
        lambda g: reports.rfm_summary(g.cust()),
    ),
    "box_stats_by_segment": Query(
        "customer_segment:s, " + BOX,
        lambda g: reports.box_stats_by_segment(
            *g.cust_with_lines()
        ),
    ),
    "rfm_box_stats": Query(BOX, lambda g: reports.rfm_box_stats(g.rfm)),
    "distribution_compare": Query(
        "customer_segment:s, measure:s, count:i, mean:4, q1:4, median:4, q3:4",
        lambda g: reports.distribution_compare(
            *g.cust_with_lines()
        ),
    ),
    "describe_features": Query(
        "feature:s, count:i, mean:6, std:2, min:6, q1:6, median:6, q3:6, max:6",
        lambda g: reports.describe_features(g.base(*reports.FEATURES)),
    ),
    # Product analytics
    "segment_season_stats": Query(
        "price_segment:s, season:s, revenue:4, avg_line_value:4, num_lines:i",
        lambda g: products.segment_season_stats(g.tx),
    ),
    "segment_season_pivot": Query(
        "price_segment:s, Winter:4, Spring:4, Summer:4, Fall:4",
        lambda g: products.segment_season_pivot(
            products.segment_season_stats(g.tx)
        ),
    ),
    "price_segment_share": Query(
        "price_segment:s, revenue:4, share:4",
        lambda g: products.price_segment_share(g.tx),
    ),
    "season_revenue": Query(
        "season:s, revenue:4, avg_line_value:4", lambda g: products.season_revenue(g.tx)
    ),
    "top_products": Query(
        "stock_code:s, description:s, price_segment:s, revenue:4, total_quantity:i",
        lambda g: products.top_products(g.lines("description")),
    ),
    "price_ranges": Query(
        "price_segment:s, low:4, high:4", lambda g: products.price_ranges(g.tx, g.prices)
    ),
    "price_stats_by_segment": Query(
        "price_segment:s, min_price:4, max_price:4, mean_price:4, median_price:4, std_price:4,"
        "num_products:i, product_share:4",
        lambda g: products.price_stats_by_segment(g.tx, g.price_lookup),
    ),
    "segment_sales_performance": Query(
        "price_segment:s, num_lines:i, quantity:i, revenue:4, quantity_share:4, revenue_share:4,"
        "avg_line_value:4",
        lambda g: products.segment_sales_performance(g.tx),
    ),
    "segment_performance_normalized": Query(
        "price_segment:s, revenue:4, quantity:i, customers:i, revenue_norm:6, quantity_norm:6,"
        "customers_norm:6",
        lambda g: products.segment_performance_normalized(g.tx, g.price_lookup),
    ),
    "lorenz_curve": Query(
        "stock_code:s, product_share:8, revenue_share:8",
        lambda g: products.lorenz_curve(products.ranked_products(g.tx)),
    ),
    "top_share_concentration": Query(
        "products:i, top_products:i, top_revenue_share:6",
        lambda g: products.top_share_concentration(products.ranked_products(g.tx)),
    ),
    "initial_segment": Query(
        "customer_id:s, initial_segment:s",
        lambda g: products.initial_segment(products.customer_purchases(g.tx, g.price_lookup)),
    ),
    "cross_sell_matrix": Query(
        "initial_segment:s, next_segment:s, customers:i, share:4",
        lambda g: products.cross_sell_matrix(products.customer_purchases(g.tx, g.price_lookup)),
    ),
    "cross_sell_wide": Query(
        "initial_segment:s, Budget:4, Regular:4, Premium:4, Luxury:4",
        lambda g: products.cross_sell_wide(
            products.cross_sell_matrix(
                products.customer_purchases(g.tx, g.price_lookup), base="customers"
            )
        ),
    ),
    "segment_affinity": Query(
        "customer_segment:s, price_segment:s, revenue:4, share:4",
        lambda g: products.segment_affinity(
            products.customer_purchases(g.tx, g.price_lookup), g.cust_lookup
        ),
    ),
    "segment_affinity_wide": Query(
        "customer_segment:s, Budget:4, Regular:4, Premium:4, Luxury:4",
        lambda g: products.segment_affinity_wide(
            products.segment_affinity(
                products.customer_purchases(g.tx, g.price_lookup), g.cust_lookup
            )
        ),
    ),
    # Statistical tests
    "kruskal_customer_segments": Query(
        "measure:s, " + TEST,
        lambda g: stats.kruskal_customer_segments(
            *g.cust_with_lines()
        ),
    ),
    "kruskal_season_by_price_segment": Query(
        "price_segment:s, " + TEST,
        lambda g: stats.kruskal_season_by_price_segment(g.tx, g.price_lookup),
    ),
    "kruskal_price_segments": Query(
        "measure:s, " + TEST, lambda g: stats.kruskal_price_segments(g.tx, g.price_lookup)
    ),
    "segment_season_correlation": Query(
        "price_segment:s, rho:6, p_value:6",
        lambda g: stats.segment_season_correlation(g.tx),
    ),
    "order_value_normality": Query(
        "statistic:4, p_value:8, is_normal:b", lambda g: stats.order_value_normality(g.tx)
    ),
    "segment_anova": Query(
        "f_statistic:6, p_value:8, significant:b", lambda g: stats.segment_anova(g.cust())
    ),
    # Periods, retention, cohorts
    "metrics_by_year": Query(
        "year:i, revenue:4, orders:i, customers:i, volume:i",
        lambda g: periods.metrics_by_year(g.tx, Y0, Y1),
    ),
    "unique_counts": Query(
        "span:s, measure:s, n:i",
        lambda g: uniques.unique_counts(
            pin(uniques.period_bitmaps(g.tx, ["customer_id", "invoice", "stock_code"], calendar.month_start(F.col("invoice_date"))), "bitmaps")
        ),
    ),
    "yoy_changes": Query(COMPARE, lambda g: periods.yoy_changes(g.tx, Y0, Y1)),
    "monthly_yoy": Query("month:i, " + SIDES, lambda g: periods.monthly_yoy(g.tx, Y0, Y1)),
    "price_segment_yoy": Query(
        "price_segment:s, " + SIDES,
        lambda g: periods.price_segment_yoy(g.tx, g.price_lookup, Y0, Y1),
    ),
    "seasonal_yoy": Query("season:s, " + SIDES, lambda g: periods.seasonal_yoy(g.tx, Y0, Y1)),
    "customer_yoy": Query(COMPARE, lambda g: periods.customer_yoy(g.tx, Y0, Y1)),
    "retention_rates": Query(
        "base_customers:i, next_customers:i, retained:i, new_customers:i, retention_rate:1,"
        "acquisition_rate:1",
        lambda g: periods.retention_rates(g.tx, Y0, Y1),
    ),
    "retained_value": Query(
        "retained_value_before:4, retained_value_after:4",
        lambda g: periods.retained_value(g.tx, Y0, Y1),
    ),
    "retention_summary": Query(
        "net_change_pct:4, value_per_retained_before:4, value_per_retained_after:4,"
        "value_change_pct:4, win_back_target:i, win_back_revenue:4, acquisition_target:i",
        lambda g: periods.retention_summary(g.tx, Y0, Y1),
    ),
    "cohort_activity": Query(
        "invoice_month:m, first_month:m, customers:i", lambda g: periods.cohort_activity(g.tx)
    ),
    "cohort_retention": Query(
        "cohort_month:m, months_since_first:i, customers:i, retention:4",
        lambda g: periods.cohort_retention(periods.cohort_activity(g.tx)),
    ),
    "cohort_retention_wide": Query(
        "cohort_month:m, months:i, retentions:s",
        lambda g: periods.cohort_lines(periods.cohort_retention(periods.cohort_activity(g.tx))),
    ),
    "cohort_matrix_literal": Query(
        "invoice_month:m, first_month:m, customers:i, share:4",
        lambda g: periods.cohort_matrix_literal(periods.cohort_activity(g.tx)),
    ),
    # Insights
    "vip_revenue_share": Query(
        "vip_share:4", lambda g: insights.vip_revenue_share(g.cust())
    ),
    "season_gap": Query(
        "best_season:s, worst_season:s, gap_pct:4", lambda g: insights.season_gap(g.tx)
    ),
    "dominant_price_segment": Query(
        "price_segment:s, share:4",
        lambda g: insights.dominant_price_segment(g.tx),
    ),
    "business_insights": Query(
        "title:s, finding:s, action:s, impact:s, priority:s",
        lambda g: insights.business_insights(g.tx, g.cust()),
    ),
    # Classifiers
    "train_test_split": Query("customer_id:s, is_train:b", _train_sides),
    "standard_scale": Query(
        "customer_id:s, " + ", ".join(f"{c}:6" for c in ml.VIP_FEATURES), _scaled
    ),
    "confusion_matrix": Query(
        "label:i, predicted_0:i, predicted_1:i",
        lambda g: evaluation.confusion_matrix(g.rule_predictions),
    ),
    "accuracy": Query("accuracy:8", lambda g: evaluation.accuracy(g.rule_predictions)),
    "classification_report": Query(
        REPORT, lambda g: evaluation.classification_report(g.rule_predictions)
    ),
    "vip_classifiers": Query("model:s, " + REPORT, _vip_models),
    "cross_validate": Query(
        "model:s, cv_mean:6, cv_std:6", lambda g: ml.vip_cross_validation(g.vip_frames[0])
    ),
    "feature_importance": Query("model:s, feature:s, importance:6", _vip_importances),
    "retention_tree": Query(REPORT, lambda g: _retention(g, ml.retention_tree)),
    "retention_importance": Query(
        "model:s, feature:s, importance:6", lambda g: ml.retention_importances(g.retention_frames[0])
    ),
    "retention_confusion": Query(
        "label:i, predicted_0:i, predicted_1:i",
        lambda g: evaluation.confusion_matrix(
            ml.retention_tree(g.retention_frames[0]).transform(g.retention_frames[1])
        ),
    ),
    "retention_tree_without_new": Query(REPORT, lambda g: _retention(g, ml.retention_tree, False)),
    "retention_tree_rules": Query("line:i, rule:s", _tree_rules),
    "retention_forest": Query(REPORT, lambda g: _retention(g, ml.retention_forest)),
    "partial_dependence": Query(
        "feature:s, x:6, y:6", lambda g: _dependence(g, ml.retention_tree)
    ),
    "partial_dependence_forest": Query(
        "feature:s, x:6, y:6", lambda g: _dependence(g, ml.retention_forest)
    ),
    "grid_search": Query(
        "numTrees:i, maxDepth:i, minSamplesSplit:i, minInstancesPerNode:i, score:6",
        lambda g: ml.grid_search(g.retention_frames[0])[0],
    ),
    "best_model_report": Query("section:s, name:s, measure:s, value:6", _best_model),
}
