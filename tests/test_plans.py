"""Running sums, exact quantiles and pinned tables against brute force."""

import random
import statistics
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shopledger.plans.distribution import Distribution, exact_sum, long_form, one_row_quantiles
from shopledger.plans.pinning import pin, pinned_scope, shared_folder
from shopledger.operators.stats import kruskal
from shopledger.plans.placement import RANGE, SLOT, place, ranges_for, running_sums
from shopledger.plans.results import shaped, shaped_sql


def linear(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_pin_keeps_rows_and_schema(spark):
    df = spark.range(10).select("id", F.lit(None).cast("decimal(18,4)").alias("d"))
    copy = pin(df, "t")
    assert copy.schema.simpleString() == df.schema.simpleString()
    assert copy.count() == 10


def test_drop_pinned_removes_the_copies(tmp_path):
    # In a process of its own, so that the copies other tests still read stay.
    code = (
        "import os, sys; sys.path.insert(0, sys.argv[2])\n"
        "from pyspark.sql import SparkSession\n"
        "from shopledger.plans.pinning import drop_pinned, pin\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
        ".config('spark.checkpoint.dir', sys.argv[1]).getOrCreate()\n"
        "copies = lambda: [n for n in os.listdir(sys.argv[1]) if 'mine' in n]\n"
        "pin(s.range(3), 'mine'); assert copies()\n"
        "assert drop_pinned(s) == 1 and not copies()\n"
    )
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", code, str(tmp_path), root], check=True, timeout=120)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_sums_cross_ranges(spark, groups):
    # Group "a" holds most rows, so it must span several ranges; values repeat (ties).
    picks = random.Random(3)
    data = [("a" if picks.random() < 0.8 else "b", picks.randrange(400), 1 + i % 5) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, x int")
    placed = place(df, [*groups, "v"], groups, ranges=4)
    assert placed.select(RANGE).distinct().count() > 1
    got = running_sums(placed, groups, ["v"], ["x"]).select("g", "v", "x_upto", "x_all").collect()
    assert len(got) == len(data)
    for row in got[::37]:
        same = [d for d in data if not groups or d[0] == row.g]
        assert row.x_upto == sum(x for _, v, x in same if v <= row.v)
        assert row.x_all == sum(x for _, _, x in same)


def test_running_sums_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "g string, v int, x int")
    got = running_sums(place(df, ["g", "v"], ["g"], ranges=3), ["g"], ["v"], ["x"])
    assert sorted((r.g or "", r.x_upto) for r in got.collect()) == [("", 2), ("", 5), ("a", 5)]


def test_ranges_follow_the_rows(spark):
    assert [ranges_for(n, 8) for n in (0, 9_999, 25_000, 10**6, 10**7, 10**9)] == [1, 1, 3, 8, 10, 1000]
    df = spark.range(45_000).select((F.col("id") * 7919 % 45_000).alias("v"), F.lit(1).alias("x"))
    counts = [r["count"] for r in place(df, ["v"]).groupBy(RANGE).count().collect()]
    assert len(counts) == 4 and max(counts) < 2 * min(counts)  # four cores
    assert place(df.where("v < 20000"), ["v"]).select(RANGE).distinct().count() == 2
    got = running_sums(place(df, ["v"], ranges=7), [], ["v"], ["x"])
    assert got.where("x_upto <> v + 1").count() == 0


def test_no_task_sorts_much_more_than_the_rows_of_a_range(spark, monkeypatch):
    # One group, so a range is one slot; with ranges of all 10,000 rows, two of them met in one bucket.
    monkeypatch.setattr("shopledger.plans.placement.RANGE_ROWS", 10_000)
    df = spark.range(40_000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 40_000).alias("v"))
    placed = place(df, ["g", "v"], ["g"])
    ranges = placed.agg(F.max(RANGE)).first()[0] + 1
    per_bucket = [r["count"] for r in placed.groupBy(F.pmod(F.hash(SLOT), F.lit(ranges))).count().collect()]
    assert sum(per_bucket) == 40_000 and max(per_bucket) < 12_500


def test_placed_rows_are_read_in_place(spark):
    # Nulls, a group with most rows, and ties; broadcasts off, so joins must use the buckets.
    df = spark.createDataFrame([(None if i % 7 == 0 else "ab"[i % 11 == 0], float(i % 50), "xyz"[i % 3]) for i in range(2000)], "g string, v double, s string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = running_sums(place(df.withColumn("n", F.lit(1)), ["g", "v"], ["g"], ranges=5), ["g"], ["v"], ["n"])
        sums.collect()
        plan = sums._jdf.queryExecution().executedPlan().toString()
        test = kruskal(df, "v", "s", ["g"], ranges=5)
        found = {r.g: r.h_statistic for r in test.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    final = plan.split("== Initial Plan ==")[0]
    # What moves are the sums per (group, range), to the windows and to the join; never the rows.
    moved = [line for line in final.splitlines() if "Exchange " in line]
    assert len(moved) == 2 and "hashpartitioning(g#" in moved[1] and "hashpartitioning(_side__slot" in moved[0], final
    assert final.count("Bucketed: true") == 2 and "Bucketed: false" not in final
    whole = {r.g: r.h_statistic for r in kruskal(df, "v", "s", ["g"], ranges=1).collect()}
    assert found == pytest.approx(whole) and len(found) == 3


def test_quantiles_match_brute_force(spark):
    picks = random.Random(5)
    data = [(g, round(picks.gauss(50, 20), picks.choice([0, 2]))) for g in "abc" for _ in range(701)]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    for row in Distribution(long_form(df, ["v"], ["g"]), ["g"]).quantiles(wanted).collect():
        values = [v for g, v in data if g == row.g]
        for name, p in wanted.items():
            assert row[name] == pytest.approx(linear(values, p), abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 5, 120, 999, 1001, 24_999, 60_000])
def test_quantiles_of_groups_of_any_size(spark, n):
    picks = random.Random(n)
    values = [float(picks.choice([picks.randrange(10**6), picks.randrange(5)])) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    row = one_row_quantiles(df, ["v"]).first()
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert row[f"v_{name}"] == pytest.approx(linear(values, p), abs=1e-6)


def test_quantiles_of_one_value_and_null_groups(spark):
    df = spark.createDataFrame([(None, 3.0)] * 2000 + [("a", 1.0)], "g string, v double")
    got = {r.g: (r.q1, r.median, r.q3) for r in Distribution(long_form(df, ["v"], ["g"]), ["g"]).quantiles().collect()}
    assert got == {None: (3.0, 3.0, 3.0), "a": (1.0, 1.0, 1.0)}


def test_results_are_rounded_without_a_greatest_value(spark):
    import duckdb

    text = "81000000000000000.1234, 100000000000, 922337203685478.5, 2.5, -0.00005, 1.00005, 0.12345"
    values = [float(v) for v in text.split(",")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (4, 8):
        got = sorted(r.x for r in shaped(df, f"x:{digits}").collect())
        sql = shaped_sql(f"SELECT unnest([{text}]::DOUBLE[]) AS x", {}, f"x:{digits}")
        assert got == sorted(r[0] for r in duckdb.sql(sql).fetchall())
        assert got[-1] == 81000000000000000.0 and 1e11 in got


def test_pinned_scope_deletes_what_it_pinned(spark):
    with pinned_scope(spark):
        path = pin(spark.range(3), "scoped").inputFiles()[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).exists()


def test_descriptions_pin_a_row_per_group_and_join_on_keys(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 997).cast("double").alias("v"))
    before = set(Path(shared_folder(spark)).iterdir())
    out = Distribution(long_form(df, ["v"], ["g"]), ["g"]).describe()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    made = set(Path(shared_folder(spark)).iterdir()) - before
    assert [spark.read.parquet(str(p)).count() for p in made] == [2] and out.count() == 2


def test_rows_of_a_group_are_not_dealt_into_one_task(spark, monkeypatch):
    plans = []
    seen = lambda df, label: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or pin(df, label)
    monkeypatch.setattr("shopledger.plans.distribution.pin", seen)
    df = spark.range(6000).selectExpr("if(id % 3 = 0, 'a', 'b') AS g", "id % 1009 AS x")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(threshold)
    spark.conf.set(threshold, 50_000)  # less than the estimate of the groups from the rows
    try:
        found = rows(Distribution(long_form(df, ["x"], ["g"]), ["g"]).describe(), "g", "count")
    finally:
        spark.conf.set(threshold, usual)
    assert found == [("a", 2000), ("b", 4000)]
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


@pytest.mark.parametrize("shift", [-0.3, 0.3])
@pytest.mark.parametrize("alpha", [1.0, 0.4])
def test_wrong_brackets_are_found_and_counted_anew(spark, monkeypatch, shift, alpha):
    # Brackets of group "a" (and of the null group) are those of other ranks; "b" keeps its own.
    picks = random.Random(11)
    data = [(g, float(picks.randrange(50) if g == "b" else picks.randrange(10**6))) for g in ("a", "b", None) for _ in range(4000)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    dist = lambda: Distribution(long_form(df, ["v"], ["g"]), ["g"])
    want = {r.g: tuple(r) for r in dist().quantiles(alpha=alpha).collect()}
    honest = Distribution._bracketed

    def wrong(self, probabilities, *more):
        shifted = {n: min(1.0, max(0.0, p + shift)) for n, p in probabilities.items()}
        a = honest(self, shifted, *more).where("NOT g <=> 'b'")
        return a.unionByName(honest(self, probabilities, *more).where("g <=> 'b'"))

    monkeypatch.setattr(Distribution, "_bracketed", wrong)
    monkeypatch.setattr("shopledger.plans.placement.RANGE_ROWS", 500)
    assert {r.g: tuple(r) for r in dist().quantiles(alpha=alpha).collect()} == want
    assert want[None][2:] and len(want) == 3
    if alpha == 1.0:
        for g, row in want.items():
            assert row[-3:] == pytest.approx([linear([v for h, v in data if h == g], p) for p in (0.25, 0.5, 0.75)])
        got = {r.g: r for r in dist().describe().collect()}
        assert all((got[g].q1, got[g].median, got[g].q3) == want[g][-3:] and got[g]["count"] == 4000 for g in want)


def test_describe(spark):
    df = spark.createDataFrame([("a", 2.0)] * 3 + [("a", 5.0), ("b", 7.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in Distribution(long_form(df, ["v"], ["g"]), ["g"]).describe().collect()}
    assert got["a"]["count"] == 4 and got["a"].total == 11.0 and got["a"].mean == 2.75
    assert got["a"]["std"] == pytest.approx(statistics.stdev([2, 2, 2, 5]))
    assert got["b"]["count"] == 1 and got["b"]["std"] is None and got["b"].median == 7.0


def test_exact_sums_of_doubles(spark):
    import math

    rng = random.Random(1)
    kinds = {
        "tiny": [i * 1e-9 for i in range(1000)],
        "huge": [3e20, 1.5, -2e20, 3e-7] * 50,
        "mixed": [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 25) for _ in range(3000)],
        "beyond": [1e300, 2.0, -1e80],
        "money": [rng.randrange(10**9) / 100 for _ in range(2000)],
        "none": [None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in kinds.items() for v in vs], "g string, v double")
    sums = lambda d: {r.g: r.total for r in d.groupBy("g").agg(exact_sum(F.col("v")).alias("total")).collect()}
    got = sums(df)
    for g, values in kinds.items():
        if g == "none":
            assert got[g] is None
        else:
            assert abs(got[g] - math.fsum(values)) <= 1e-14 * math.fsum(map(abs, values)), g
    assert got == sums(df.repartition(7)) == sums(df.orderBy("v"))
    mean = Distribution(long_form(df.where("g = 'tiny'"), ["v"])).describe().first()["mean"]
    assert mean == pytest.approx(4.995e-07, rel=1e-12)


def test_box_whiskers_and_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    row = Distribution(long_form(df, ["v"])).box().first()
    assert (row.low_whisker, row.high_whisker, row.outliers) == (1.0, 5.0, 1)


def test_unbiased_plotting_positions(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    row = one_row_quantiles(df, ["v"], {"low": 0.05, "high": 0.95}, alpha=0.4).first()
    # n p + 0.4 + 0.2 p, 1-based, clipped to the data
    assert row.v_low == pytest.approx(1.0) and row.v_high == pytest.approx(10.0)
    row = one_row_quantiles(df, ["v"], {"m": 0.3}, alpha=0.4).first()
    assert row.v_m == pytest.approx(3.46)
