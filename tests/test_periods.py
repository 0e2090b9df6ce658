"""Year comparison, retention and cohorts."""

import pytest
from conftest import rows

from shopledger.operators import periods

DATA = [
    ("1", "A", 1, "2010-01-15", 100, "stay"),
    ("2", "A", 1, "2011-01-20", 150, "stay"),
    ("3", "A", 2, "2010-03-01", 50, "gone"),
    ("4", "A", 1, "2011-05-05", 80, "new"),
    ("5", "A", 1, "2009-12-31", 70, "stay"),
]


@pytest.fixture(scope="module")
def tx(make_lines):
    return make_lines(DATA)


def test_metrics_and_changes(tx):
    got = {r.year: (float(r.revenue), r.orders, r.customers, r.volume)
           for r in periods.metrics_by_year(tx, 2010, 2011).collect()}
    assert got == {2010: (200.0, 2, 2, 3), 2011: (230.0, 2, 2, 2)}
    change = {r.metric: (r.change_pct, r.change) for r in periods.yoy_changes(tx, 2010, 2011).collect()}
    assert change["revenue"] == (15.0, 30.0) and change["volume"] == (-33.3, -1.0)


def test_month_in_one_year_only(tx):
    got = {r.month: (r.before, r.after, r.growth_pct) for r in periods.monthly_yoy(tx, 2010, 2011).collect()}
    assert got[1][2] == 50.0 and got[3][1] is None and got[3][2] is None and got[5][0] is None


def test_retention(tx):
    row = periods.retention_rates(tx, 2010, 2011).first()
    assert (row.base_customers, row.retained, row.new_customers) == (2, 1, 1)
    assert (row.retention_rate, row.acquisition_rate) == (50.0, 50.0)
    assert row.retained + row.new_customers == row.next_customers
    value = periods.retained_value(tx, 2010, 2011).first()
    assert (float(value.retained_value_before), float(value.retained_value_after)) == (100.0, 150.0)
    summary = periods.retention_summary(tx, 2010, 2011).first()
    assert summary.value_change_pct == pytest.approx(50) and summary.acquisition_target == 1


def test_first_year_without_customers(tx):
    row = periods.retention_rates(tx, 2001, 2010).first()
    assert (row.base_customers, row.retention_rate) == (0, None)
    assert periods.retention_summary(tx, 2001, 2010).first().net_change_pct is None


def test_cohorts_from_bitmaps_equal_brute_force(make_lines):
    import datetime as dt
    import random
    from collections import Counter, defaultdict

    rng = random.Random(2)
    data = [(str(i), "A", 1, f"{rng.choice([1969, 1997, 2003, 2010, 2031])}-{rng.randrange(1, 13):02}-0{rng.randrange(1, 10)}", 1, f"c{rng.randrange(40)}") for i in range(400)]
    months = defaultdict(set)
    for *_, date, _, c in data:
        months[c].add(date[:7])
    want = Counter((m, min(found)) for found in months.values() for m in found)
    activity = periods.cohort_activity(make_lines(data).repartition(5))
    got = {(r.invoice_month.strftime("%Y-%m"), r.first_month.strftime("%Y-%m")): r.customers for r in activity.collect()}
    assert got == want and all(isinstance(r.invoice_month, dt.date) for r in activity.take(1))
    plan = periods.cohort_activity(make_lines(data))._jdf.queryExecution().executedPlan().toString()
    # One exchange each of bitmaps, customers and cells.
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_unions_of_stored_bitmaps_equal_recounting(make_lines, spark):
    import random

    from pyspark.sql import functions as F

    from shopledger.operators import uniques
    from shopledger.plans.pinning import pin

    rng = random.Random(7)
    data = [(str(rng.randrange(90)), f"p{rng.randrange(30)}", 1, f"{rng.choice([2009, 2010])}-0{rng.randrange(1, 10)}-05", 1, f"c{rng.randrange(60)}") for _ in range(500)]
    lines = make_lines(data).repartition(6)
    stored = pin(uniques.period_bitmaps(lines, ["customer_id", "stock_code"], F.trunc("invoice_date", "month")), "stored")
    for low, high in (("2009-01", "2010-09"), ("2009-03", "2009-05"), ("2010-02", "2010-02"), ("2009-08", "2010-03")):
        some = stored.where(F.date_format("period", "yyyy-MM").between(low, high))
        got = {r.measure: r.n for r in uniques.united(some).collect()}
        inside = [d for d in data if low <= d[3][:7] <= high]
        assert got == {"customer_id": len({d[5] for d in inside}), "stock_code": len({d[1] for d in inside})}
    keys = uniques.numbered(spark.range(70_000).select(F.col("id").cast("string").alias("k")), "k")
    stats = keys.agg(F.count("k"), F.countDistinct("number"), F.min("number"), F.max("number")).first()
    assert stats[:3] == (70_000, 70_000, 0) and stats[3] < 80_000
    large = uniques.period_bitmaps(spark.range(70_000).select("id", (F.col("id") % 3).alias("p")), ["id"], F.col("p"))
    assert uniques.united(large.where("period < 2")).first()["n"] == 46_667 and large.where("block > 1").count() > 0


def test_cohorts(tx):
    activity = periods.cohort_activity(tx)
    retention = periods.cohort_retention(activity)
    assert all(r.retention == 100 for r in retention.collect() if r.months_since_first == 0)
    since = rows(retention.where("cohort_month = date'2009-12-01'"), "months_since_first", "retention")
    assert since == [(0, 100.0), (1, 100.0), (13, 100.0)]
    literal = periods.cohort_matrix_literal(activity).where("invoice_month = date'2010-03-01'").first()
    assert literal.customers == 1 and literal.share is None
    wide = {str(r.cohort_month): r for r in periods.cohort_wide(retention, 2).collect()}
    assert wide["2009-12-01"]["1"] == 100.0 and wide["2009-12-01"]["2"] is None
    line = periods.cohort_lines(retention).where("cohort_month = date'2009-12-01'").first()
    assert line.months == 14 and line.retentions == "100.0000,100.0000" + "," * 11 + ",100.0000"
