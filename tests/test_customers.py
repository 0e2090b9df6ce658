"""Customer features, scores, segments, lifetime value, running totals, reports."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shopledger.functions.segments import spend_band
from shopledger.operators import customers, insights, reports


def test_features_and_tenure(make_lines):
    lines = make_lines(
        [
            ("1", "A", 1, "2020-01-01T23:00:00", 10, "x"),
            ("1", "B", 2, "2020-01-01T23:00:00", 5, "x"),
            ("2", "A", 1, "2020-01-02T01:00:00", 10, "x"),
            ("3", "A", 1, "2020-03-01T00:00:00", 10, "y"),
        ]
    )
    base = {r.customer_id: r for r in customers.customer_base(lines).collect()}
    x = base["x"]
    assert (x.num_orders, float(x.total_spend), x.unique_items, x.total_items) == (2, 30.0, 2, 4)
    assert x.avg_line_value == 10.0
    # 23:00 to 01:00 is no whole day; the rate divides by at least one day.
    assert x.tenure_days == 0 and x.frequency == 2.0
    assert base["y"].tenure_days == 0
    lifetime = dict(rows(customers.clv_analysis(lines), "customer_id", "customer_lifetime_days"))
    assert lifetime == {"x": 1, "y": 0}
    assert dict(rows(customers.clv_analysis(lines), "customer_id", "clv_score"))["y"] is None
    recency = dict(rows(customers.rfm_analysis(lines), "customer_id", "recency"))
    assert recency == {"x": 59, "y": 0}


def test_equal_customers_tie_in_every_score(make_lines):
    lines = make_lines([(c, "A", 1, "2020-01-01", 10, c) for c in "abcde"])
    table = customers.customer_table(lines).collect()
    assert {(r.r_score, r.f_score, r.m_score, r.customer_segment) for r in table} == {(4, 4, 4, "VIP")}


@pytest.mark.parametrize(
    "spend,band",
    [(0, None), (0.01, "At Risk"), (500, "At Risk"), (500.01, "Regular"), (1000, "Regular"),
     (5000, "Loyal"), (5000.01, "VIP"), (-1, None)],
)
def test_spend_bands_are_right_closed(spark, spend, band):
    df = spark.createDataFrame([(float(spend),)], "s double")
    assert df.select(spend_band(F.col("s"))).first()[0] == band


@pytest.fixture(scope="module")
def many(make_lines):
    """300 lines; customer c0 and one instant hold a large share."""
    picks = random.Random(11)
    data = []
    for i in range(300):
        who = "c0" if picks.random() < 0.4 else f"c{picks.randrange(1, 30)}"
        day = 1 if picks.random() < 0.3 else picks.randrange(1, 28)
        month = 1 if day == 1 else picks.randrange(1, 13)
        data.append((f"i{picks.randrange(120)}", f"p{picks.randrange(40)}", picks.randrange(1, 9),
                     f"{2019 + i % 2}-{month:02}-{day:02}", picks.randrange(100, 9000) / 100, who))
    return make_lines(data)


@pytest.mark.parametrize("make,key", [
    (customers.running_total_by_customer, "customer_id"),
    (customers.running_total_by_month, "month"),
])
def test_running_totals_match_brute_force(many, make, key):
    got = make(many).collect()
    assert len(got) == many.count()
    for row in got[::7]:
        before = [r.total_value for r in got if r[key] == row[key] and r.invoice_date <= row.invoice_date]
        assert row.running_total == sum(before)


def test_results_do_not_depend_on_partitioning(many):
    first = rows(customers.customer_table(many))
    again = rows(customers.customer_table(many.repartition(13)))
    assert first == again


def test_segments_partition_the_customers(many):
    cust = customers.customer_table(many)
    shares = reports.segment_distribution(cust).collect()
    assert sum(r.customers for r in shares) == many.select("customer_id").distinct().count()
    assert sum(r.share for r in shares) == pytest.approx(100)


def test_histogram_covers_all_rows(many):
    base = customers.customer_base(many, ["total_spend"])
    bins = sorted(reports.spend_histogram(base, 10).collect(), key=lambda r: r.bin)
    assert len(bins) == 10 and sum(r.customers for r in bins) == base.count()
    spend = [float(r.total_spend) for r in base.collect()]
    assert bins[0].low == pytest.approx(min(spend)) and bins[-1].high == pytest.approx(max(spend))


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    bins = {r.bin: r.customers for r in reports.histogram(df, "v", 4).collect()}
    assert bins == {0: 2, 1: 0, 2: 0, 3: 0}


def test_retention_labels(make_lines):
    lines = make_lines([("1", "A", 1, "2010-05-01", 1, "old"), ("2", "A", 1, "2011-05-01", 1, "old"),
                        ("3", "A", 1, "2011-06-01", 1, "new"), ("4", "A", 1, "2010-06-01", 1, "gone")])
    features = customers.customer_features(lines)
    every = dict(rows(customers.retention_labels(features, 2011), "customer_id", "is_retained"))
    assert every == {"old": 1, "new": 1, "gone": 0}
    strict = dict(rows(customers.retention_labels(features, 2011, False), "customer_id", "is_retained"))
    assert strict == {"old": 1, "new": 0, "gone": 0}


def test_approximate_quartiles_are_close(many):
    rfm = customers.rfm_analysis(many)
    exact, near = customers.rfm_quartiles(rfm).first(), customers.rfm_quartiles(rfm, exact=False).first()
    spread = [float(r.monetary) for r in rfm.collect()]
    for a, b in zip(exact.monetary_quartiles, near.monetary_quartiles):
        assert abs(a - b) <= (max(spread) - min(spread)) * 0.1


def test_insights_name_three_findings(many):
    cust = customers.customer_table(many)
    assert insights.business_insights(many, cust).count() == 3
    # The same share whether summed from the customers or from the lines.
    from_lines = insights.vip_revenue_share(cust, many).first().vip_share
    assert insights.vip_revenue_share(cust).first().vip_share == pytest.approx(from_lines)


def test_segment_reports_with_and_without_a_lookup(many):
    from shopledger.operators.products import price_segment_lookup, price_segment_share

    given = price_segment_share(many, price_segment_lookup(many))
    assert rows(price_segment_share(many)) == rows(given)
