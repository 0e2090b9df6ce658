"""Tests and tail probabilities against published and brute-force values."""

import math
import random

import pytest

from shopledger.functions.tails import chi2_tail, f_tail
from shopledger.operators import stats


@pytest.mark.parametrize(
    "x,df,p",
    # 5 % and 1 % critical values of printed chi-squared tables
    [(3.841, 1, 0.05), (5.991, 2, 0.05), (7.815, 3, 0.05), (9.488, 4, 0.05), (11.345, 3, 0.01)],
)
def test_chi2_tail(x, df, p):
    assert chi2_tail(x, df) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize(
    "x,d1,d2,p",
    # printed F tables
    [(4.965, 1, 10, 0.05), (3.098, 3, 20, 0.05), (2.866, 4, 20, 0.05), (4.938, 3, 20, 0.01)],
)
def test_f_tail(x, d1, d2, p):
    assert f_tail(x, d1, d2) == pytest.approx(p, rel=2e-3)


def test_f_tail_of_many_degrees_is_the_chi_squared_limit():
    for df2 in (1e7, 1e9, 1e11):
        assert f_tail(2.605, 3, df2) == pytest.approx(chi2_tail(3 * 2.605, 3), rel=10 / df2 + 1e-6)


@pytest.mark.parametrize("orders", range(1, 10))
def test_normality_of_few_orders(make_lines, orders):
    lines = make_lines([(str(i), "A", 1 + i * i, "2020-01-01", 1, "c") for i in range(orders)])
    row = stats.order_value_normality(lines).first()
    assert (row.p_value is None) == (orders < 8)


def test_tails_far_out_and_at_zero():
    assert chi2_tail(0, 3) == 1.0 and f_tail(0, 2, 9) == 1.0
    assert 0 <= chi2_tail(5000, 3) < 1e-300 and 0 <= f_tail(1e6, 3, 1000) < 1e-300


def brute_kruskal(groups):
    pooled = sorted(v for g in groups for v in g)
    n = len(pooled)
    rank = {v: pooled.index(v) + 1 + (pooled.count(v) - 1) / 2 for v in set(pooled)}
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in g) ** 2 / len(g) for g in groups) - 3 * (n + 1)
    ties = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    return h / (1 - ties / (n**3 - n))


def test_kruskal_with_ties(spark):
    picks = random.Random(2)
    groups = {g: [picks.randrange(1, 30) + shift for _ in range(n)]
              for g, n, shift in (("a", 60, 0), ("b", 25, 4), ("c", 90, 2))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v int")
    row = stats.kruskal(df, "v", "g").first()
    assert row.h_statistic == pytest.approx(brute_kruskal(list(groups.values())))
    assert row.p_value == pytest.approx(math.exp(-row.h_statistic / 2))


def test_kruskal_without_a_comparison(spark):
    one = spark.createDataFrame([("a", 1), ("a", 2)], "g string, v int")
    row = stats.kruskal(one, "v", "g").first()
    assert (row.groups, row.h_statistic, row.p_value) == (1, None, None)
    same = spark.createDataFrame([("a", 1), ("b", 1)], "g string, v int")
    assert stats.kruskal(same, "v", "g").first().h_statistic is None


def test_anova_by_hand(spark):
    data = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs],
                               "customer_segment string, total_spend double")
    row = stats.segment_anova(df).first()
    assert row.f_statistic == pytest.approx(9.3, abs=0.05)
    assert row.p_value == pytest.approx(0.0024, abs=2e-4) and row.significant


def test_normality_accepts_normal_and_rejects_skewed(make_lines):
    picks = random.Random(4)

    def order_values(draw):
        return make_lines([(str(i), "A", 1, "2020-01-01", round(draw(), 2), "c") for i in range(800)])

    normal = stats.order_value_normality(order_values(lambda: picks.gauss(500, 40))).first()
    skewed = stats.order_value_normality(order_values(lambda: 1 + picks.expovariate(0.01))).first()
    assert normal.is_normal and not skewed.is_normal
