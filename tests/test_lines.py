"""Readers, cleaning, calendar, products."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shopledger.functions.calendar import SEASON_MONTHS
from shopledger.operators import cleaning, products
from shopledger.sources.readers import TRANSACTION_SCHEMA, apply_schema, normalize_keys, read_transactions


def test_read_all_parts_with_different_columns(spark, tmp_path):
    spark.sql("SELECT '1' AS Invoice, 'A' AS StockCode, 2 AS Quantity, 13085.0D AS `Customer ID`,"
              " 1.5D AS Price, timestamp_ntz'2010-01-02 03:04:05' AS InvoiceDate"
              ).write.parquet(str(tmp_path / "a"))
    spark.sql("SELECT '2' AS Invoice, 'B' AS StockCode, 'lamp' AS Description, 'UK' AS Country"
              ).write.parquet(str(tmp_path / "b"))
    df = read_transactions(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert df.schema.simpleString() == TRANSACTION_SCHEMA.simpleString()
    assert rows(df, "invoice", "customer_id", "country") == [("1", "13085", None), ("2", None, "UK")]


def test_read_single_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Invoice,StockCode,Quantity,InvoiceDate,Price,Customer ID\n"
                    "5,85123A,6,2009-12-01 07:45:00,2.55,13085.0\n")
    row = read_transactions(spark, str(path), "csv").first()
    assert (row.stock_code, row.quantity, str(row.price), row.customer_id) == ("85123A", 6, "2.5500", "13085")
    assert row.invoice_date == dt.datetime(2009, 12, 1, 7, 45)


def test_normalize_numeric_and_text_keys(spark):
    df = spark.sql("SELECT 7.0D AS customer_id, '22423.0' AS stock_code")
    assert normalize_keys(df).first() == ("7", "22423")


def test_different_keys_stay_different(spark):
    df = spark.sql("SELECT 85123.5D AS stock_code, 7.9D AS customer_id, 489434.0D AS invoice")
    assert normalize_keys(df).select("stock_code", "customer_id", "invoice").first() == ("85123.5", "7.9", "489434")


def test_whole_numbers_and_malformed_cells(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Invoice,Quantity,Price\n5,6.0,2.5\n6,many,1\n")
    got = rows(read_transactions(spark, str(path), "csv", malformed="null"), "invoice", "quantity")
    assert got == [("5", 6), ("6", None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_transactions(spark, str(path), "csv").collect()


def test_headers_are_an_argument(spark, tmp_path):
    spark.sql("SELECT 'X' AS item, 3 AS pieces").write.parquet(str(tmp_path / "a"))
    df = read_transactions(spark, str(tmp_path / "a"), columns={"item": "stock_code", "pieces": "quantity"})
    assert rows(df, "stock_code", "quantity") == [("X", 3)]


def test_lines_without_a_product_are_dropped(make_lines):
    lines = make_lines([("1", "A", 1, "2020-01-01", 1, "c"), ("2", None, 1, "2020-01-01", 1, "c")])
    assert rows(lines, "invoice") == [("1",)]


def test_clean_drops_returns_free_and_unknown(make_lines):
    lines = make_lines(
        [
            ("1", "A", 1, "2020-01-01", 1, "c"),
            ("2", "A", -1, "2020-01-01", 1, "c"),
            ("3", "A", 0, "2020-01-01", 1, "c"),
            ("4", "A", 1, "2020-01-01", 0, "c"),
            ("5", "A", 1, "2020-01-01", 1, None),
        ],
        clean=False,
    )
    assert rows(cleaning.clean_transactions(lines), "invoice") == [("1",)]


def test_total_value_is_exact(make_lines):
    value = make_lines([("1", "A", 3, "2020-01-01", "0.1", "c")]).first().total_value
    assert str(value) == "0.3000"


def test_overview_exact_and_by_sketch(make_lines):
    lines = make_lines([(f"i{i // 3}", "A", 1, "2020-01-01", 2, f"c{i // 6}") for i in range(60)])
    row = cleaning.dataset_overview(lines).first()
    assert (row.total_revenue, row.unique_customers, row.total_transactions) == (120, 10, 20)
    assert row.avg_order_value == 6.0
    near = cleaning.dataset_overview(lines, exact=False).first()
    assert abs(near.total_transactions - 20) <= 2


def test_seasons_and_holidays(make_lines):
    lines = make_lines([(str(m), "A", 1, f"2021-{m:02}-10", 1, "c") for m in range(1, 13)])
    got = {int(i): s for i, s in rows(cleaning.with_season(lines), "invoice", "season")}
    assert got == {m: s for s, months in SEASON_MONTHS.items() for m in months}
    days = make_lines([(d, "A", 1, f"2021-{d}", 1, "c") for d in ("11-24", "11-25", "12-01", "10-30")])
    flags = dict(rows(cleaning.with_holiday_flag(days), "invoice", "is_holiday_season"))
    assert flags == {"11-24": False, "11-25": True, "12-01": True, "10-30": False}


def test_calendar_monday_is_zero(make_lines):
    row = cleaning.with_calendar(make_lines([("1", "A", 1, "2024-01-01T23:05:00", 1, "c")])).first()
    assert (row.month, row.day_of_week, row.hour) == (1, 0, 23)


def test_period_is_closed_and_pushed_down(spark, make_lines, tmp_path):
    lines = make_lines([(d, "A", 1, d, 1, "c") for d in ("2020-01-01", "2020-01-02", "2020-01-03", "2020-01-04")])
    kept = cleaning.filter_period(lines, "2020-01-02", "2020-01-03")
    assert rows(kept, "invoice") == [("2020-01-02",), ("2020-01-03",)]
    lines.write.parquet(str(tmp_path / "p"))
    stored = cleaning.filter_period(spark.read.parquet(str(tmp_path / "p")), "2020-01-02", "2020-01-03")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(invoice_date), GreaterThanOrEqual" in plan


def test_first_description_skips_null_and_takes_the_earliest(spark, make_lines):
    lines = make_lines([("1", "A", 1, "2020-01-03", 2, "c"), ("2", "A", 3, "2020-01-02", 4, "c"),
                        ("3", "A", 1, "2020-01-01", 6, "c")])
    text = F.when(F.col("invoice") == "3", None).otherwise(F.concat(F.lit("text "), "invoice"))
    row = products.product_stats(lines.withColumn("description", text)).first()
    assert (row.description, row.mean_price, row.total_quantity) == ("text 2", 4.0, 5)


@pytest.fixture(scope="module")
def shop(make_lines):
    """Four products, one per price segment; customer x starts with B, y with D."""
    data = [
        ("1", "B", 1, "2020-01-01T10:00:00", 20, "x"),
        ("1", "C", 1, "2020-01-01T10:00:00", 30, "x"),
        ("2", "A", 2, "2020-04-01T10:00:00", 10, "x"),
        ("3", "D", 1, "2020-07-01T10:00:00", 40, "y"),
        ("4", "D", 1, "2020-10-01T10:00:00", 40, "y"),
    ]
    return make_lines(data)


@pytest.fixture(scope="module")
def lookup(shop):
    return products.price_segment_lookup(shop)


def test_price_segments_by_quartile(lookup):
    assert dict(rows(lookup, "stock_code", "price_segment")) == {
        "A": "Budget", "B": "Regular", "C": "Premium", "D": "Luxury"}


def test_equal_prices_are_all_budget(make_lines):
    lines = make_lines([(str(i), s, 1, "2020-01-01", 5, "c") for i, s in enumerate("ABC")])
    names = products.price_segments(products.product_prices(lines))
    assert {r.price_segment for r in names.collect()} == {"Budget"}


def test_initial_segment_ties_go_by_product(shop, lookup):
    bought = products.customer_purchases(shop, lookup)
    assert rows(products.initial_segment(bought)) == [("x", "Regular"), ("y", "Luxury")]


def test_cross_sell_rows_sum_to_100(shop, lookup):
    matrix = products.cross_sell_matrix(products.customer_purchases(shop, lookup))
    got = {(r.initial_segment, r.next_segment): (r.customers, r.share) for r in matrix.collect()}
    assert got[("Regular", "Budget")][0] == 1 and got[("Luxury", "Budget")][0] == 0
    assert sum(s for (i, _), (_, s) in got.items() if i == "Regular") == pytest.approx(100)
    wide = {r.initial_segment: r for r in products.cross_sell_wide(matrix).collect()}
    assert wide["Luxury"].Luxury == 100 and wide["Luxury"].Budget == 0


def test_season_pivot_fills_missing_seasons(shop, lookup):
    stats = products.segment_season_stats(shop, lookup)
    wide = {r.price_segment: r for r in products.segment_season_pivot(stats).collect()}
    assert (wide["Luxury"].Summer, wide["Luxury"].Winter) == (40, 0)
    bare = {r.price_segment: r for r in products.segment_season_pivot(stats, None).collect()}
    assert bare["Luxury"].Winter is None


def test_price_ranges_end_at_the_highest_line(shop):
    ranges = products.price_ranges(shop, products.product_prices(shop)).collect()
    assert [r.price_segment for r in ranges] == ["Budget", "Regular", "Premium", "Luxury"]
    assert ranges[0].low == 0 and ranges[3].high == 40
    assert all(a.high == b.low for a, b in zip(ranges, ranges[1:]))


def test_lorenz_is_convex_and_ends_at_one(make_lines):
    lines = make_lines([(str(i), f"p{i:03}", 1, "2020-01-01", 1 + i % 17, "c") for i in range(200)])
    curve = products.lorenz_curve(products.ranked_products(lines))
    points = sorted((r.product_share, r.revenue_share) for r in curve.collect())
    assert points[-1] == (1.0, 1.0)
    steps = [b[1] - a[1] for a, b in zip(points, points[1:])]
    assert all(b >= a - 1e-12 for a, b in zip(steps, steps[1:]))
    row = products.top_share_concentration(products.ranked_products(lines)).first()
    total, top = sum(1 + i % 17 for i in range(200)), sorted((1 + i % 17 for i in range(200)), reverse=True)[:10]
    assert (row.products, row.top_products) == (200, 10)
    assert row.top_revenue_share == pytest.approx(100 * sum(top) / total)


def test_top_share_is_at_least_one_product(shop):
    row = products.top_share_concentration(products.ranked_products(shop)).first()
    assert row.top_products == 1 and row.top_revenue_share == pytest.approx(100 * 80 / 150)
