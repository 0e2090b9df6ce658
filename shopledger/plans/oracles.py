"""DuckDB SQL that computes each registered query from the same tables."""

from __future__ import annotations

import re

from shopledger.plans.catalogue import PERIOD, QUERIES, Y0, Y1
from shopledger.plans.results import shaped_sql

# Common tables, in order of dependence.
TABLES = {
    "raw": """
SELECT CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stock_code,
       p_name AS description, CAST(l_quantity AS INT) AS quantity, o_orderdate AS invoice_date,
       CAST(l_extendedprice AS DECIMAL(18, 2)) AS price, CAST(o_custkey AS VARCHAR) AS customer_id,
       n_name AS country
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "tx": """
SELECT *, quantity * price AS total_value, month(invoice_date) AS month,
       year(invoice_date) AS year, CAST(date_trunc('month', invoice_date) AS DATE) AS year_month,
       CASE WHEN month(invoice_date) IN (12, 1, 2) THEN 'Winter'
            WHEN month(invoice_date) IN (3, 4, 5) THEN 'Spring'
            WHEN month(invoice_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season
FROM raw WHERE quantity > 0 AND price > 0 AND customer_id IS NOT NULL""",
    "prices": """
SELECT stock_code, CAST(sum(price) AS DOUBLE) / count(*) AS mean_price FROM tx GROUP BY 1""",
    "price_cut": """
SELECT quantile_cont(mean_price, 0.25) AS q1, quantile_cont(mean_price, 0.5) AS median,
       quantile_cont(mean_price, 0.75) AS q3 FROM prices""",
    "seg": """
SELECT stock_code, mean_price, CASE WHEN mean_price <= q1 THEN 'Budget'
       WHEN mean_price <= median THEN 'Regular' WHEN mean_price <= q3 THEN 'Premium'
       ELSE 'Luxury' END AS price_segment FROM prices, price_cut""",
    "txs": "SELECT tx.*, price_segment FROM tx LEFT JOIN seg USING (stock_code)",
    "feat": """
SELECT customer_id, count(DISTINCT invoice) AS num_orders, sum(total_value) AS total_spend,
       CAST(sum(total_value) AS DOUBLE) / count(*) AS avg_line_value,
       min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase,
       count(DISTINCT stock_code) AS unique_items, sum(quantity) AS total_items
FROM tx GROUP BY 1""",
    "base": """
SELECT *, CAST(total_spend AS DOUBLE) AS spend, num_orders / greatest(tenure_days, 1) AS frequency
FROM (SELECT *, datesub('day', first_purchase, last_purchase) AS tenure_days,
      datediff('day', last_purchase, (SELECT max(last_purchase) FROM feat)) AS days_since_last
      FROM feat)""",
    "cust_cut": """
SELECT quantile_cont(CAST(tenure_days AS DOUBLE), [0.25, 0.5, 0.75]) AS r,
       quantile_cont(CAST(days_since_last AS DOUBLE), [0.25, 0.5, 0.75]) AS d,
       quantile_cont(frequency, [0.25, 0.5, 0.75]) AS f,
       quantile_cont(spend, [0.25, 0.5, 0.75]) AS m FROM base""",
    "scored": """
SELECT base.*, CASE WHEN tenure_days <= r[1] THEN 4 WHEN tenure_days <= r[2] THEN 3
                    WHEN tenure_days <= r[3] THEN 2 ELSE 1 END AS r_score,
       CASE WHEN days_since_last <= d[1] THEN 4 WHEN days_since_last <= d[2] THEN 3
            WHEN days_since_last <= d[3] THEN 2 ELSE 1 END AS d_score,
       CASE WHEN frequency >= f[3] THEN 4 WHEN frequency >= f[2] THEN 3
            WHEN frequency >= f[1] THEN 2 ELSE 1 END AS f_score,
       CASE WHEN spend >= m[3] THEN 4 WHEN spend >= m[2] THEN 3
            WHEN spend >= m[1] THEN 2 ELSE 1 END AS m_score
FROM base, cust_cut""",
    "cust": """
SELECT *, CASE WHEN r_score + f_score + m_score >= 11 THEN 'VIP'
               WHEN r_score + f_score + m_score >= 8 THEN 'Loyal'
               WHEN r_score + f_score + m_score >= 5 THEN 'Regular'
               ELSE 'At Risk' END AS customer_segment FROM scored""",
    "txc": "SELECT tx.*, customer_segment FROM tx JOIN cust USING (customer_id)",
    "newest": "SELECT max(invoice_date) AS last_day FROM tx",
    "rfm": """
SELECT customer_id, datediff('day', max(invoice_date), any_value(last_day)) AS recency,
       count(DISTINCT invoice) AS frequency, sum(total_value) AS monetary
FROM tx, newest GROUP BY 1""",
    "clv": """
SELECT *, CAST(total_spend AS DOUBLE) / nullif(customer_lifetime_days, 0) AS clv_score
FROM (SELECT customer_id, sum(total_value) AS total_spend, count(*) AS num_transactions,
             CAST(sum(total_value) AS DOUBLE) / count(*) AS avg_transaction,
             datediff('day', min(invoice_date), max(invoice_date)) AS customer_lifetime_days
      FROM tx GROUP BY 1)""",
    "price_seg_rev": """
SELECT price_segment, sum(total_value) AS revenue,
       100 * CAST(sum(total_value) AS DOUBLE) / sum(sum(total_value)) OVER () AS share
FROM txs GROUP BY 1""",
    "season_rev": """
SELECT season, sum(total_value) AS revenue, CAST(sum(total_value) AS DOUBLE) / count(*)
       AS avg_line_value FROM tx GROUP BY 1""",
    "seg_season": """
SELECT price_segment, season, sum(total_value) AS revenue, count(*) AS num_lines,
       CAST(sum(total_value) AS DOUBLE) / count(*) AS avg_line_value FROM txs GROUP BY 1, 2""",
    "sales": "SELECT stock_code, sum(total_value) AS revenue FROM tx GROUP BY 1",
    "starts": """
SELECT customer_id, price_segment AS initial_segment FROM txs QUALIFY row_number() OVER (
       PARTITION BY customer_id ORDER BY invoice_date, stock_code) = 1""",
    "bought": """
SELECT DISTINCT customer_id, initial_segment, price_segment AS next_segment
FROM txs JOIN starts USING (customer_id)""",
    "names": "SELECT unnest(['Budget', 'Regular', 'Premium', 'Luxury']) AS next_segment",
    "cross_sell": """
SELECT i.initial_segment, n.next_segment, count(b.customer_id) AS customers
FROM (SELECT DISTINCT initial_segment FROM starts) i CROSS JOIN names n
LEFT JOIN bought b ON b.initial_segment = i.initial_segment AND b.next_segment = n.next_segment
GROUP BY 1, 2""",
    "affinity": """
SELECT customer_segment, price_segment, sum(total_value) AS revenue,
       100 * CAST(sum(total_value) AS DOUBLE)
       / sum(sum(total_value)) OVER (PARTITION BY customer_segment) AS share
FROM txs JOIN cust USING (customer_id) GROUP BY 1, 2""",
    "moments": """
SELECT n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM (
  SELECT CAST(count(*) AS DOUBLE) AS n, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3,
         avg(pow(v - m, 4)) AS m4
  FROM (SELECT v, avg(v) OVER () AS m
        FROM (SELECT CAST(sum(total_value) AS DOUBLE) AS v FROM tx GROUP BY invoice)))""",
    "z_skew": """
SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1 FROM (
  SELECT g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
         sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
              / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2 FROM moments)""",
    "z_kurt": """
SELECT ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))))
       / sqrt(2 / (9 * a)) AS z2
FROM (SELECT x, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM (
  SELECT (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3)
         / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
         6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
         * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM moments))""",
    "anova": """
SELECT (sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f,
       CAST(count(*) - 1 AS DOUBLE) AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2
FROM (SELECT count(*) AS n, avg(spend) AS m, var_pop(spend) AS v,
             (SELECT avg(spend) FROM cust) AS grand FROM cust GROUP BY customer_segment)""",
    "years": f"SELECT * FROM tx WHERE year IN ({Y0}, {Y1})",
    "by_year": """
SELECT year, sum(total_value) AS revenue, count(DISTINCT invoice) AS orders,
       count(DISTINCT customer_id) AS customers, sum(quantity) AS volume FROM years GROUP BY 1""",
    "cust_year": """
SELECT year, customer_id, CAST(sum(total_value) AS DOUBLE) AS spend,
       CAST(sum(total_value) AS DOUBLE) / count(*) AS line, count(DISTINCT invoice) AS orders
FROM years GROUP BY 1, 2""",
    "cust_year_mean": """
SELECT year, avg(spend) AS total_spend, avg(line) AS avg_line_value, avg(orders) AS num_orders
FROM cust_year GROUP BY 1""",
    "first_year": f"SELECT DISTINCT customer_id FROM tx WHERE year = {Y0}",
    "second_year": f"SELECT DISTINCT customer_id FROM tx WHERE year = {Y1}",
    "kept": "SELECT * FROM first_year INTERSECT SELECT * FROM second_year",
    "gained": "SELECT * FROM second_year EXCEPT SELECT * FROM first_year",
    "sizes": """
SELECT (SELECT count(*) FROM first_year) AS base_customers,
       (SELECT count(*) FROM second_year) AS next_customers,
       (SELECT count(*) FROM kept) AS retained, (SELECT count(*) FROM gained) AS new_customers""",
    "kept_value": f"""
SELECT sum(total_value) FILTER (year = {Y0}) AS retained_value_before,
       sum(total_value) FILTER (year = {Y1}) AS retained_value_after
FROM years WHERE customer_id IN (FROM kept)""",
    "firsts": "SELECT customer_id, min(year_month) AS first_month FROM tx GROUP BY 1",
    "activity": """
SELECT year_month AS invoice_month, first_month, count(DISTINCT customer_id) AS customers
FROM tx JOIN firsts USING (customer_id) GROUP BY 1, 2""",
    "cohorts": """
SELECT first_month AS cohort_month, datediff('month', first_month, invoice_month)
       AS months_since_first, a.customers, 100 * a.customers / s.customers AS retention
FROM activity a JOIN (SELECT first_month, customers FROM activity
                      WHERE invoice_month = first_month) s USING (first_month)""",
    "rule": """
SELECT CAST(customer_segment = 'VIP' AS INT) AS label, CAST(m_score = 4 AS INT) AS prediction
FROM cust""",
    "class_scores": """
SELECT class, support, CAST(hits AS DOUBLE) / support AS recall,
       CAST(hits AS DOUBLE) / predicted AS precision,
       2 * CAST(hits AS DOUBLE) / (support + predicted) AS f1, hits
FROM (SELECT c AS class, count_if(label = c) AS support, count_if(prediction = c) AS predicted,
             count_if(label = c AND prediction = c) AS hits
      FROM rule, (SELECT unnest([0, 1]) AS c) GROUP BY 1)""",
    "split": """
SELECT *, CAST('0x' || substr(md5(customer_id || ':42'), 1, 8) AS BIGINT) % 1000 < 800 AS is_train
FROM base""",
}


def _quartiles(value: str) -> str:
    return (
        f"quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,"
        f" quantile_cont({value}, 0.75) AS q3"
    )


def _describe(value: str, exact: str) -> str:
    return (
        f"count(*) AS count, sum({exact}) AS total, CAST(sum({exact}) AS DOUBLE) / count(*) AS mean,"
        f" stddev_samp({value}) AS std, min({value}) AS min, {_quartiles(value)},"
        f" max({value}) AS max"
    )


LINE_DOUBLE = "CAST(total_value AS DOUBLE)"
SPEND_STATS = (
    "SELECT customer_segment, " + _describe("spend", "total_spend") + " FROM cust GROUP BY 1"
)
LINE_STATS = (
    "SELECT customer_segment, " + _describe(LINE_DOUBLE, "total_value") + " FROM txc GROUP BY 1"
)


def _box(rows: str, by: str = "") -> str:
    """Box statistics of (by, measure, v)."""
    keys = f"{by}measure"
    return f"""
SELECT {keys}, q1, median, q3, min(v) FILTER (inside) AS low_whisker,
       max(v) FILTER (inside) AS high_whisker, count(*) FILTER (NOT inside) AS outliers
FROM (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM ({rows}) JOIN (SELECT {keys}, {_quartiles('v')} FROM ({rows}) GROUP BY ALL)
      USING ({keys})) GROUP BY {keys}, q1, median, q3"""


def _measures(table: str, columns: list[str], by: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {by}'{c}' AS measure, CAST({c} AS DOUBLE) AS v FROM {table}" for c in columns
    )


def _kruskal(rows: str, by: str = "") -> str:
    """H, p and verdict of (by, v, g); p by the series of the incomplete gamma function."""
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    group = "GROUP BY ALL"
    p = """CASE WHEN h > 1400 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 3000),
        lambda i: exp(-h / 2 + (k / 2 + i) * ln(h / 2) - lgamma(k / 2 + i + 1)))) END"""
    return f"""
SELECT {key}groups, h AS h_statistic, p AS p_value, p < 0.05 AS significant FROM (
 SELECT *, {p} AS p FROM (
  SELECT {key}count(*) AS groups, CAST(count(*) - 1 AS DOUBLE) AS k,
         (12 / (any_value(n) * (any_value(n) + 1)) * sum(pow(rank_sum, 2) / size)
          - 3 * (any_value(n) + 1)) / (1 - sum(tied) / (pow(any_value(n), 3) - any_value(n))) AS h
  FROM (SELECT {key}g, sum(r) AS rank_sum, count(*) AS size, sum(t * t - 1) AS tied,
               any_value(n) AS n
        FROM (SELECT {key}g, CAST(count(*) OVER ({part}) AS DOUBLE) AS n,
                     CAST(count(*) OVER (PARTITION BY {key}v) AS DOUBLE) AS t,
                     rank() OVER ({part} ORDER BY v)
                     + (count(*) OVER (PARTITION BY {key}v) - 1) / 2.0 AS r
              FROM ({rows})) {group}) {group}))"""


def _histogram(rows: str, bins: int = 50) -> str:
    """Bins of (v); ``low`` and ``high`` of each bin."""
    return f"""
SELECT b.bin, lo + b.bin * w AS low, lo + b.bin * w + w AS high, count(v) AS customers
FROM (SELECT unnest(range(0, {bins})) AS bin) b
CROSS JOIN (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM ({rows}))
LEFT JOIN ({rows}) r ON least(floor((r.v - lo) / w), {bins - 1}) = b.bin GROUP BY ALL"""


def _compare(table: str, metrics: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST(max({m}) FILTER (year = {Y0}) AS DOUBLE) AS before,"
        f" CAST(max({m}) FILTER (year = {Y1}) AS DOUBLE) AS after FROM {table}"
        for m in metrics
    )
    return (
        "SELECT *, (after / before - 1) * 100 AS change_pct, after - before AS change"
        f" FROM ({rows})"
    )


def _sides(key: str, table: str = "years") -> str:
    return f"""
SELECT *, (CAST(after AS DOUBLE) / CAST(before AS DOUBLE) - 1) * 100 AS growth_pct FROM (
  SELECT {key}, sum(total_value) FILTER (year = {Y0}) AS before,
         sum(total_value) FILTER (year = {Y1}) AS after FROM {table} GROUP BY 1)"""


def _running(part: str) -> str:
    return (
        f"SELECT *, sum(total_value) OVER (PARTITION BY {part} ORDER BY invoice_date)"
        " AS running_total FROM tx"
    )


def _wide(key: str, column: str, value: str, names: list[str], table: str) -> str:
    cells = ", ".join(
        f"coalesce(sum({value}) FILTER ({column} = '{n}'), 0) AS {n}" for n in names
    )
    return f"SELECT {key}, {cells} FROM {table} GROUP BY 1"


PRICE_NAMES = ["Budget", "Regular", "Premium", "Luxury"]
SCALED = ["total_spend", "num_orders", "tenure_days", "frequency", "avg_line_value"]

EVENTS = """
SELECT CAST(event_id AS VARCHAR) AS invoice, ts AS invoice_date, month(ts) AS month,
       isodow(ts) - 1 AS day_of_week, hour(ts) AS hour, 1 AS quantity,
       CAST(value AS DECIMAL(18, 4)) AS price
FROM events UNION ALL
SELECT invoice, invoice_date, month(invoice_date), isodow(invoice_date) - 1, hour(invoice_date), quantity, price
FROM raw"""

STORED_LINES = """
SELECT l_partkey AS stock_code, CAST(NULL AS TIMESTAMP) AS invoice_date, CAST(NULL AS BIGINT) AS customer_id,
       CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(18, 4)) AS price FROM lineitem"""

SQL = {
    "read_transactions": f"""
SELECT count(*) AS num_lines, count(stock_code) AS with_stock_code,
       count(invoice_date) AS with_invoice_date, count(customer_id) AS with_customer_id,
       sum(quantity) AS quantity, sum(price) AS price FROM ({STORED_LINES}
      UNION ALL SELECT NULL, ts, user_id, NULL, CAST(value AS DECIMAL(18, 4)) FROM events)""",
    "read_single": f"""
SELECT count(*) AS num_lines, count(stock_code) AS with_stock_code,
       count(invoice_date) AS with_invoice_date, count(customer_id) AS with_customer_id,
       sum(quantity) AS quantity, sum(price) AS price FROM ({STORED_LINES})""",
    "apply_schema": "SELECT * FROM raw",
    "clean_transactions": "SELECT * FROM tx",
    "dataset_overview": """
SELECT sum(total_value) AS total_revenue, count(DISTINCT customer_id) AS unique_customers,
       count(DISTINCT invoice) AS total_transactions,
       CAST(sum(total_value) AS DOUBLE) / count(DISTINCT invoice) AS avg_order_value FROM tx""",
    "filter_period": f"""
SELECT * FROM tx WHERE invoice_date BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}'""",
    "product_stats": """
SELECT stock_code, arg_min(description, (invoice_date, description)) AS description,
       CAST(sum(price) AS DOUBLE) / count(*) AS mean_price, sum(quantity) AS total_quantity
FROM tx GROUP BY 1""",
    "price_thresholds": "SELECT * FROM price_cut",
    "price_segments": "SELECT * FROM seg",
    "with_price_segment": "SELECT * FROM txs",
    "with_calendar": EVENTS,
    "with_season": "SELECT * FROM tx",
    "with_holiday_flag": """
SELECT *, month = 12 OR (month = 11 AND day(invoice_date) >= 25) AS is_holiday_season FROM tx""",
    "with_year_month": "SELECT * FROM tx",
    "customer_features": "SELECT * FROM feat",
    "customer_tenure": "SELECT * FROM base",
    "purchase_rate": "SELECT * FROM base",
    "rfm_scores": "SELECT * FROM scored",
    "rfm_scores_days_since_last": """
SELECT customer_id, d_score AS r_score, f_score, m_score,
       CASE WHEN d_score + f_score + m_score >= 11 THEN 'VIP'
            WHEN d_score + f_score + m_score >= 8 THEN 'Loyal'
            WHEN d_score + f_score + m_score >= 5 THEN 'Regular'
            ELSE 'At Risk' END AS customer_segment FROM scored""",
    "customer_segments": "SELECT * FROM cust",
    "customer_spend": "SELECT *, total_spend AS line_spend FROM feat",
    "spend_band_segments": """
SELECT customer_id, total_spend, CASE WHEN total_spend > 0 AND total_spend <= 500 THEN 'At Risk'
       WHEN total_spend > 500 AND total_spend <= 1000 THEN 'Regular'
       WHEN total_spend > 1000 AND total_spend <= 5000 THEN 'Loyal'
       WHEN total_spend > 5000 THEN 'VIP' END AS spend_band FROM feat""",
    "rfm_analysis": "SELECT * FROM rfm",
    "rfm_quartiles_approx": "SELECT "
    + ", ".join(f"true AS {c}_{q}" for c in ("recency", "frequency", "monetary") for q in ("q1", "median", "q3"))
    + " FROM (SELECT count(*) FROM rfm)",
    "rfm_quartiles": "SELECT "
    + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c}_{q}"
        for c in ("recency", "frequency", "monetary")
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    )
    + " FROM rfm",
    "clv_analysis": "SELECT * FROM clv",
    "running_total_by_month": _running("month"),
    "running_total_by_year_month": _running("year_month"),
    "running_total_by_customer": _running("customer_id"),
    "retention_labels": f"""
SELECT customer_id, CAST(year(last_purchase) = {Y1} AS INT) AS is_retained,
       CAST(year(last_purchase) = {Y1} AND year(first_purchase) < {Y1} AS INT) AS is_retained_old
FROM feat""",
    "retention_label_counts": f"""
SELECT CAST(year(last_purchase) = {Y1} AS INT) AS is_retained, count(*) AS customers
FROM feat GROUP BY 1""",
    "kpis": """
SELECT sum(total_value) AS total_revenue, count(DISTINCT invoice) AS total_orders,
       CAST(sum(total_value) AS DOUBLE) / count(DISTINCT invoice) AS avg_order_value,
       (SELECT count(*) FROM cust) AS total_customers,
       (SELECT 100 * avg(CAST(customer_segment = 'VIP' AS INT)) FROM cust) AS vip_percentage
FROM tx""",
    "segment_distribution": """
SELECT customer_segment, count(*) AS customers, 100 * count(*) / sum(count(*)) OVER () AS share
FROM cust GROUP BY 1""",
    "spend_histogram": _histogram("SELECT spend AS v FROM base"),
    "spend_histogram_by_segment": """
SELECT customer_segment, bin, lo + bin * w AS low, lo + bin * w + w AS high, count(*) AS customers
FROM (SELECT customer_segment, lo, w, least(floor((spend - lo) / w), 49) AS bin
      FROM cust, (SELECT min(spend) AS lo, (max(spend) - min(spend)) / 50 AS w FROM cust))
GROUP BY customer_segment, bin, lo, w""",
    "clv_histogram": _histogram("SELECT clv_score AS v FROM clv WHERE clv_score IS NOT NULL"),
    "avg_order_value_by_segment": """
SELECT customer_segment, avg(avg_line_value) AS avg_order_value FROM cust GROUP BY 1""",
    "describe_spend_by_segment": SPEND_STATS,
    "describe_line_value_by_segment": LINE_STATS,
    "rfm_profile": """
SELECT customer_segment, avg(r_score) AS r_score, avg(f_score) AS f_score, avg(m_score) AS m_score
FROM cust GROUP BY 1""",
    "rfm_summary": """
SELECT customer_segment, avg(r_score) AS r_score, avg(f_score) AS f_score, avg(m_score) AS m_score,
       (avg(r_score) + avg(f_score) + avg(m_score)) / 3 AS avg_score FROM cust GROUP BY 1""",
    "box_stats_by_segment": _box(
        _measures("cust", ["tenure_days", "frequency", "total_spend"], "customer_segment, ")
        + " UNION ALL "
        + _measures("txc", ["total_value"], "customer_segment, "),
        "customer_segment, ",
    ),
    "rfm_box_stats": _box(_measures("rfm", ["recency", "frequency", "monetary"])),
    "distribution_compare": f"SELECT *, 'lifetime_value' AS measure FROM ({SPEND_STATS}) "
    f"UNION ALL SELECT *, 'line_value' AS measure FROM ({LINE_STATS})",
    "describe_features": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, "
        + _describe(f"CAST({c} AS DOUBLE)", c)
        + " FROM base"
        for c in ("tenure_days", "frequency", "total_spend", "avg_line_value")
    ),
    "segment_season_stats": "SELECT * FROM seg_season",
    "segment_season_pivot": _wide(
        "price_segment", "season", "revenue", ["Winter", "Spring", "Summer", "Fall"], "seg_season"
    ),
    "price_segment_share": "SELECT * FROM price_seg_rev",
    "season_revenue": "SELECT * FROM season_rev",
    "top_products": """
SELECT stock_code, arg_min(description, (invoice_date, description)) AS description,
       any_value(price_segment) AS price_segment, sum(total_value) AS revenue,
       sum(quantity) AS total_quantity
FROM txs GROUP BY 1 ORDER BY revenue DESC, stock_code LIMIT 10""",
    "price_ranges": """
SELECT unnest(['Budget', 'Regular', 'Premium', 'Luxury']) AS price_segment,
       unnest([0.0, q1, median, q3]) AS low,
       unnest([q1, median, q3, (SELECT CAST(max(price) AS DOUBLE) FROM tx)]) AS high
FROM price_cut""",
    "price_stats_by_segment": """
SELECT *, 100 * num_products / sum(num_products) OVER () AS product_share FROM (
  SELECT price_segment, min(price) AS min_price, max(price) AS max_price,
         CAST(sum(price) AS DOUBLE) / count(*) AS mean_price,
         quantile_cont(CAST(price AS DOUBLE), 0.5) AS median_price,
         stddev_samp(CAST(price AS DOUBLE)) AS std_price,
         count(DISTINCT stock_code) AS num_products FROM txs GROUP BY 1)""",
    "segment_sales_performance": """
SELECT price_segment, count(*) AS num_lines, sum(quantity) AS quantity,
       sum(total_value) AS revenue,
       100 * CAST(sum(quantity) AS DOUBLE) / sum(sum(quantity)) OVER () AS quantity_share,
       100 * CAST(sum(total_value) AS DOUBLE) / sum(sum(total_value)) OVER () AS revenue_share,
       CAST(sum(total_value) AS DOUBLE) / count(*) AS avg_line_value FROM txs GROUP BY 1""",
    "segment_performance_normalized": """
SELECT *, CAST(revenue AS DOUBLE) / max(revenue) OVER () AS revenue_norm,
       CAST(quantity AS DOUBLE) / max(quantity) OVER () AS quantity_norm,
       CAST(customers AS DOUBLE) / max(customers) OVER () AS customers_norm
FROM (SELECT price_segment, sum(total_value) AS revenue, sum(quantity) AS quantity,
             count(DISTINCT customer_id) AS customers FROM txs GROUP BY 1)""",
    "lorenz_curve": """
SELECT stock_code, row_number() OVER (ORDER BY revenue, stock_code) / count(*) OVER ()
       AS product_share, CAST(sum(revenue) OVER (ORDER BY revenue, stock_code) AS DOUBLE)
       / CAST(sum(revenue) OVER () AS DOUBLE) AS revenue_share FROM sales""",
    "top_share_concentration": """
SELECT any_value(n) AS products, any_value(k) AS top_products,
       100 * CAST(sum(revenue) FILTER (place <= k) AS DOUBLE) / sum(revenue) AS top_revenue_share
FROM (SELECT revenue, row_number() OVER (ORDER BY revenue DESC) AS place, count(*) OVER () AS n,
             greatest(1, floor(count(*) OVER () * CAST(0.05 AS DOUBLE))) AS k FROM sales)""",
    "initial_segment": "SELECT * FROM starts",
    "cross_sell_matrix": """
SELECT *, 100 * customers / sum(customers) OVER (PARTITION BY initial_segment) AS share
FROM cross_sell""",
    "cross_sell_wide": _wide(
        "initial_segment", "next_segment", "share", PRICE_NAMES, """
(SELECT *, 100 * customers / n AS share FROM cross_sell JOIN
 (SELECT initial_segment, count(*) AS n FROM starts GROUP BY 1) USING (initial_segment))"""
    ),
    "segment_affinity": "SELECT * FROM affinity",
    "segment_affinity_wide": _wide(
        "customer_segment", "price_segment", "share", PRICE_NAMES, "affinity"
    ),
    "kruskal_customer_segments": "SELECT 'lifetime_value' AS measure, * FROM ("
    + _kruskal("SELECT spend AS v, customer_segment AS g FROM cust")
    + ") UNION ALL SELECT 'line_value' AS measure, * FROM ("
    + _kruskal("SELECT total_value AS v, customer_segment AS g FROM txc")
    + ")",
    "kruskal_season_by_price_segment": _kruskal(
        "SELECT price_segment, total_value AS v, season AS g FROM txs", "price_segment"
    ),
    "kruskal_price_segments": "SELECT 'line_value' AS measure, * FROM ("
    + _kruskal("SELECT total_value AS v, price_segment AS g FROM txs")
    + ") UNION ALL SELECT 'line_quantity' AS measure, * FROM ("
    + _kruskal("SELECT quantity AS v, price_segment AS g FROM txs")
    + ")",
    "segment_season_correlation": """
SELECT price_segment, CASE WHEN count(*) = 4 THEN corr(revenue, overall) END AS rho,
       CASE WHEN count(*) = 4 THEN 1 - abs(corr(revenue, overall)) END AS p_value
FROM (SELECT price_segment, CAST(revenue AS DOUBLE) AS revenue,
             CAST(sum(revenue) OVER (PARTITION BY season) AS DOUBLE) AS overall FROM seg_season)
GROUP BY 1""",
    "order_value_normality": """
SELECT z1 * z1 + z2 * z2 AS statistic, exp(-(z1 * z1 + z2 * z2) / 2) AS p_value,
       exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal FROM z_skew, z_kurt""",
    "segment_anova": """
SELECT f AS f_statistic, p AS p_value, p < 0.05 AS significant FROM (
  SELECT f, list_sum(list_transform(range(0, 20000), lambda i: exp(a * ln(z) + b * ln(1 - z)
         + lgamma(a + b + i) - lgamma(b) - lgamma(a + 1 + i) + i * ln(z)))) AS p
  FROM (SELECT f, d2 / 2 AS a, d1 / 2 AS b, d2 / (d2 + d1 * f) AS z FROM anova))""",
    "metrics_by_year": "SELECT * FROM by_year",
    "unique_counts": """
SELECT span, measure, count(DISTINCT key) AS n FROM (
    SELECT measure, key, unnest([strftime(invoice_date, '%Y-%m'), strftime(invoice_date, '%Y'), 'all']) AS span FROM (
        SELECT invoice_date, unnest(['customer_id', 'invoice', 'stock_code']) AS measure,
               unnest([customer_id, invoice, stock_code]) AS key FROM tx))
GROUP BY span, measure""",
    "yoy_changes": _compare("by_year", ["revenue", "orders", "customers", "volume"]),
    "monthly_yoy": _sides("month"),
    "price_segment_yoy": _sides("price_segment", f"(FROM txs WHERE year IN ({Y0}, {Y1}))"),
    "seasonal_yoy": _sides("season"),
    "customer_yoy": _compare("cust_year_mean", ["total_spend", "avg_line_value", "num_orders"]),
    "retention_rates": """
SELECT *, 100 * retained / base_customers AS retention_rate,
       100 * new_customers / base_customers AS acquisition_rate FROM sizes""",
    "retained_value": "SELECT * FROM kept_value",
    "retention_summary": """
SELECT (next_customers / base_customers - 1) * 100 AS net_change_pct,
       before AS value_per_retained_before, after AS value_per_retained_after,
       (after / before - 1) * 100 AS value_change_pct,
       floor(base_customers * CAST(0.1 AS DOUBLE)) AS win_back_target,
       before * base_customers * 0.1 AS win_back_revenue,
       floor(base_customers * (1 - round(100 * retained / base_customers, 1) / 100))
       AS acquisition_target
FROM (SELECT *, CAST(retained_value_before AS DOUBLE) / retained AS before,
             CAST(retained_value_after AS DOUBLE) / retained AS after FROM sizes, kept_value)""",
    "cohort_activity": "SELECT * FROM activity",
    "cohort_retention": "SELECT * FROM cohorts",
    "cohort_retention_wide": """
SELECT cohort_month, max(months_since_first) + 1 AS months,
       string_agg(coalesce(printf('%.4f', round_even(retention * 10000.0, 0) / 10000.0), ''), ',' ORDER BY m) AS retentions
FROM (SELECT c.cohort_month, m, retention, max(months_since_first) OVER (PARTITION BY c.cohort_month) AS months_since_first
      FROM (SELECT cohort_month, unnest(range(max(months_since_first) + 1)) AS m FROM cohorts GROUP BY 1) c
      LEFT JOIN cohorts r ON r.cohort_month = c.cohort_month AND r.months_since_first = m) GROUP BY 1""",
    "cohort_matrix_literal": """
SELECT a.*, 100 * a.customers / o.customers AS share FROM activity a LEFT JOIN (
  SELECT invoice_month, customers FROM activity
  WHERE first_month = (SELECT min(first_month) FROM activity)) o USING (invoice_month)""",
    "vip_revenue_share": """
SELECT 100 * CAST(sum(total_value) FILTER (customer_segment = 'VIP') AS DOUBLE) / sum(total_value)
       AS vip_share FROM txc""",
    "season_gap": """
SELECT arg_max(season, revenue) AS best_season, arg_min(season, revenue) AS worst_season,
       (CAST(max(revenue) AS DOUBLE) / CAST(min(revenue) AS DOUBLE) - 1) * 100 AS gap_pct
FROM season_rev""",
    "dominant_price_segment": """
SELECT arg_max(price_segment, revenue) AS price_segment, max(share) AS share FROM price_seg_rev""",
    "business_insights": """
SELECT 'VIP customers' AS title, printf('VIP customers bring %.1f%% of revenue', 100 *
       CAST(sum(total_value) FILTER (customer_segment = 'VIP') AS DOUBLE) / sum(total_value))
       AS finding, 'Run a personal VIP programme' AS action, '+15% VIP retention' AS impact,
       'High' AS priority FROM txc
UNION ALL SELECT 'Seasons', printf('Revenue differs by %.1f%% between %s and %s',
       (CAST(max(revenue) AS DOUBLE) / CAST(min(revenue) AS DOUBLE) - 1) * 100,
       arg_max(season, revenue), arg_min(season, revenue)),
       printf('Adjust the inventory for %s', arg_min(season, revenue)),
       '+20% revenue in the low season', 'Medium' FROM season_rev
UNION ALL SELECT 'Leading price segment', printf('The %s segment brings %.1f%% of revenue',
       arg_max(price_segment, revenue), max(share)),
       printf('Extend the %s range', arg_max(price_segment, revenue)), '+15% total revenue', 'High'
       FROM price_seg_rev""",
    "train_test_split": "SELECT * FROM split",
    "standard_scale": "SELECT customer_id, "
    + ", ".join(
        f"(CAST({c} AS DOUBLE) - {c}_mean) / {c}_std AS {c}" for c in SCALED
    )
    + " FROM split, (SELECT "
    + ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS {c}_mean, stddev_pop(CAST({c} AS DOUBLE)) AS {c}_std"
        for c in SCALED
    )
    + " FROM split WHERE is_train)",
    "confusion_matrix": """
SELECT label, count_if(prediction = 0) AS predicted_0, count_if(prediction = 1) AS predicted_1
FROM rule GROUP BY 1""",
    "accuracy": "SELECT avg(CAST(label = prediction AS INT)) AS accuracy FROM rule",
    "classification_report": """
SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM class_scores
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM class_scores
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
       sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
       FROM class_scores
UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
       sum(hits) / sum(support), sum(support) FROM class_scores""",
}


def _needed(sql: str) -> dict[str, str]:
    """The common tables that ``sql`` names, directly or through one another."""
    wanted: set[str] = set()
    text = sql
    for name in reversed(TABLES):
        if re.search(rf"\b{name}\b", text):
            wanted.add(name)
            text += TABLES[name]
    return {name: body for name, body in TABLES.items() if name in wanted}


def oracles() -> dict[str, str]:
    return {
        name: shaped_sql(sql, _needed(sql), QUERIES[name].shape) for name, sql in SQL.items()
    }
