"""Splits, scores and models on a small made-up customer table."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shopledger.operators import classifiers as ml
from shopledger.operators import evaluation, forests, trees
from shopledger.operators.dependence import few_values, feature_grids, partial_dependence, split_points


@pytest.fixture(scope="module")
def cust(spark):
    picks = random.Random(9)
    data = []
    for i in range(400):
        spend, tenure = picks.uniform(10, 1000), picks.randrange(0, 900)
        data.append((f"c{i}", spend, picks.randrange(1, 30), tenure, picks.random(), spend / 7,
                     "VIP" if spend > 700 else "Regular",
                     f"2010-0{1 + i % 9}-01", "2011-03-01" if tenure > 400 else "2010-12-01"))
    return spark.createDataFrame(
        data,
        "customer_id string, total_spend double, num_orders int, tenure_days int, frequency double,"
        " avg_line_value double, customer_segment string, first_purchase string, last_purchase string",
    )


def test_split_is_stable_and_about_80_percent(cust):
    train, test = evaluation.train_test_split(cust)
    again, _ = evaluation.train_test_split(cust.repartition(7))
    assert rows(train, "customer_id") == rows(again, "customer_id")
    assert train.count() + test.count() == 400 and 290 <= train.count() <= 350


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    scaled = evaluation.standard_scale(df, evaluation.scaling(df, ["a", "b"]), ["a", "b"])
    assert rows(scaled) == [(-1.0, 0.0), (1.0, 0.0)]


def test_report_textbook_values(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 9
    df = spark.createDataFrame(pairs, "label int, prediction int")
    report = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert report["1"].precision == pytest.approx(6 / 9) and report["1"].recall == pytest.approx(6 / 8)
    assert report["accuracy"].f1 == pytest.approx(0.75) == evaluation.accuracy(df).first()[0]
    assert report["macro avg"].recall == pytest.approx((6 / 8 + 9 / 12) / 2)
    assert report["weighted avg"].support == 20
    assert rows(evaluation.confusion_matrix(df)) == [(0, 9, 3), (1, 2, 6)]


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    report = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1) == (0.0, 0.0, 0.0)


def test_vip_models(cust):
    train, test = ml.vip_frames(cust)
    models = ml.fit_vip_classifiers(train)
    report = ml.vip_reports(models, test).where("class = 'accuracy'").collect()
    assert {r.model for r in report} == set(models) and all(r.f1 > 0.9 for r in report)
    weights = ml.vip_importances(models, train).where("model = 'decision_tree'").collect()
    assert sum(r.importance for r in weights) == pytest.approx(1)


def test_cross_validation_folds(cust):
    train, _ = ml.vip_frames(cust)
    folds = evaluation.with_folds(train, 5).groupBy("fold").count().collect()
    assert {r.fold for r in folds} == set(range(5))
    from pyspark.ml.classification import DecisionTreeClassifier

    (scores,) = ml.cross_validate(DecisionTreeClassifier(maxDepth=2), train, ml.VIP_FEATURES, 3)
    assert len(scores) == 3 and all(0.9 < s <= 1 for s in scores)


def test_fit_rows_are_bounded_and_stable(cust):
    some = rows(ml.fit_rows(cust, 50), "customer_id")
    assert len(some) == 50 and some == rows(ml.fit_rows(cust.repartition(5), 50), "customer_id")
    assert ml.fit_rows(cust).count() == 400


@pytest.mark.parametrize("most", [0, 1, 7, 50, 399, 400, 1000])
def test_fit_rows_keep_partitions_and_the_least_hashes(cust, most):
    spread = cust.repartition(5)
    found = ml.fit_rows(spread, most)
    want = cust.orderBy(F.xxhash64("customer_id"), "customer_id").limit(most)
    assert rows(found, "customer_id") == rows(want, "customer_id")
    parts = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert found.rdd.getNumPartitions() > 1 and (most < 50 or parts > 1)
    assert "Exchange SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_bounded_fits_are_scored_on_every_row(cust, monkeypatch):
    train, _ = ml.vip_frames(cust)
    held, fitted = [], []
    evaluate, fit = ml.MulticlassClassificationEvaluator.evaluate, ml.Pipeline.fit
    monkeypatch.setattr(
        ml.MulticlassClassificationEvaluator, "evaluate",
        lambda self, df, *a: held.extend(r[0] for r in df.select("customer_id").collect()) or evaluate(self, df, *a),
    )
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, df, *a: fitted.append(df.count()) or fit(self, df, *a))
    everyone = [c for (c,) in rows(train, "customer_id")]
    assert len(ml.vip_cross_validation(train, 2, most=60).collect()) == 3
    assert sorted(held) == sorted(3 * everyone) and fitted == [60] * 6
    held.clear(), fitted.clear()
    counted = ml.right_counts
    monkeypatch.setattr(
        ml, "right_counts", lambda df, *a: held.extend(r[0] for r in df.select("customer_id").collect()) or counted(df, *a)
    )
    grid = {"numTrees": (3,), "maxDepth": (2,), "minInstancesPerNode": (1, 4)}
    ml.grid_search(train, grid, k=2, most=60, refit=True)
    assert sorted(held) == sorted(2 * everyone) and fitted == [60] * 5


@pytest.fixture(scope="module")
def retention(cust):
    dated = cust.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("first_purchase", "last_purchase")})
    return ml.retention_frames(dated, 2011)


def test_retention_tree_and_rules(retention):
    train, test = retention
    model = ml.retention_tree(train)
    scores = evaluation.classification_report(model.transform(test)).where("class = 'accuracy'")
    assert scores.first().f1 > 0.95
    rules = "\n".join(r.rule for r in ml.tree_rules(model, ml.RETENTION_FEATURES, train).collect())
    assert "tenure_days <= " in rules and "feature " not in rules


def test_partial_dependence_equals_brute_force(retention):
    train, _ = retention
    model = ml.retention_tree(train)
    curve = sorted(partial_dependence(model, train, ["tenure_days"], points=20).collect(), key=lambda r: r.x)
    assert len(curve) == 20 and [r.x for r in curve] == pytest.approx(feature_grids(train, ["tenure_days"], 20)["tenure_days"])
    assert split_points(model, 0, train)
    from pyspark.ml.functions import vector_to_array

    for point in curve[::6]:
        moved = model.transform(train.withColumn("tenure_days", F.lit(point.x)))
        assert moved.agg(F.avg(vector_to_array("probability")[1])).first()[0] == pytest.approx(point.y)


def test_partial_dependence_of_a_forest_equals_brute_force(retention):
    train, _ = retention
    model = ml.retention_forest(train)
    from pyspark.ml.functions import vector_to_array

    curve = sorted(partial_dependence(model, train, ["frequency"], points=7).collect(), key=lambda r: r.x)
    for point in curve[::3]:
        moved = model.transform(train.withColumn("frequency", F.lit(point.x)))
        assert moved.agg(F.avg(vector_to_array("probability")[1])).first()[0] == pytest.approx(point.y)
    # Grid values that equal thresholds belong to the stretch below.
    cut = split_points(model, 0, train)[2]
    some = train.withColumn("tenure_days", F.when(F.col("tenure_days") % 2 == 0, cut).otherwise(F.col("tenure_days") + 0.5))
    curve = partial_dependence(model, some.repartition(3), ["tenure_days"], points=20_000)
    (y,) = [r.y for r in curve.collect() if r.x == cut]
    moved = model.transform(some.withColumn("tenure_days", F.lit(cut)))
    assert moved.agg(F.avg(vector_to_array("probability")[1])).first()[0] == pytest.approx(y)


def test_grid_of_few_values_is_the_values(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,)], "v double")
    assert feature_grids(df, ["v"], 10) == {"v": [1.0, 3.0]} == feature_grids(df.repartition(3), ["v"], 3)
    assert len(feature_grids(df, ["v"], 2)["v"]) == 2 and few_values(df, ["v"], 2) == {}
    assert few_values(df.where("v IS NULL"), ["v"], 2) == {"v": []}


def test_grid_search_and_winner(retention):
    train, test = retention
    grid = {"numTrees": (3, 5), "maxDepth": (2,), "minInstancesPerNode": (1, 4)}
    scores, best = ml.grid_search(train, grid, k=2, refit=True)
    found = scores.collect()
    assert len(found) == 4 and found[0].score == max(r.score for r in found)
    sections = {r.section for r in ml.best_model_report(best, test).collect()}
    assert sections == {"report", "importance"}
    winner = ml.classifier_of(best)
    assert winner.getNumTrees == found[0].numTrees
    assert winner.getOrDefault("minInstancesPerNode") == found[0].minInstancesPerNode
    assert ml.grid_search(train, grid, k=2)[1] is None
    split = grid | {"minSamplesSplit": (2, 60)}
    scores, best = ml.grid_search(train, split, k=2, refit=True)
    assert scores.count() == 8 and scores.columns == [*split, "score"]
    assert (best.trees.rows[best.trees.feature >= 0] >= scores.first().minSamplesSplit).all()


def walked(nodes, row, trees, depth, least):
    """Class shares by a walk over the node table that stops where the setting says."""
    total = [0.0, 0.0]
    for t in range(trees):
        at, level = nodes[t, 0], 0
        while at.feature >= 0 and at.rows >= least and level < depth:
            at = nodes[t, at.left if row[at.feature] <= at.threshold else at.right]
            level += 1
        total = [a + c / sum(at.counts) for a, c in zip(total, at.counts)]
    return total


@pytest.fixture(scope="module")
def forest(retention, spark):
    """A forest with impure leaves, its node table and arrays."""
    from pyspark.ml.classification import RandomForestClassifier

    noisy = F.when(F.crc32(F.col("customer_id").cast("binary")) % 4 == 0, 1 - F.col("label")).otherwise(F.col("label"))
    train = retention[0].withColumn("label", noisy)
    model = ml.pipeline(RandomForestClassifier(numTrees=6, maxDepth=7, seed=3), ml.RETENTION_FEATURES).fit(train)
    table = {(r.tree, r.node): r for r in trees.node_table(ml.classifier_of(model), spark).collect()}
    return train, model, table, trees.Trees.of(ml.classifier_of(model), spark)


def test_prunings_equal_walks_over_the_unpruned_nodes(forest):
    train, model, table, arrays = forest
    data = train.select(*ml.RETENTION_FEATURES, "label").collect()
    settings = ((2, 6), (1, 4, 7), (2, 5, 10, 40))
    right = trees.right_counts(train.repartition(3), arrays, ml.RETENTION_FEATURES, *settings)
    assert len(right) == 24
    for (n, depth, least), (hits, of) in right.items():
        guesses = [walked(table, r, n, depth, least) for r in data]
        assert of == len(data) and hits == sum(int(b > a) == r.label for (a, b), r in zip(guesses, data))
    unpruned = model.transform(train).where("prediction = label").count()
    assert right[6, 7, 2] == (unpruned, len(data)) and len({hits for hits, _ in right.values()}) > 4


def test_a_pruned_forest_has_no_small_parents(forest, retention):
    train, model, table, arrays = forest
    assert arrays.importances(4) == pytest.approx(ml.classifier_of(model).featureImportances.toArray())
    for least in (2, 10, 40, 10_000):
        cut = arrays.pruned(least, depth=5, trees=4)
        inner = cut.feature >= 0
        assert (cut.rows[inner] >= least).all() and cut.depths().max() <= 5 and (cut.depths() >= 0).all()
        best = trees.PrunedForest(model, cut, ml.RETENTION_FEATURES)
        for r in best.transform(train).limit(60).collect():
            a, b = walked(table, [r[f] for f in ml.RETENTION_FEATURES], 4, 5, least)
            assert r.prediction == float(b > a)
    assert {r.section for r in ml.best_model_report(best, retention[1]).collect()} == {"report", "importance"}


def test_a_forest_fitted_in_parts_is_a_whole_forest(forest):
    train = forest[0]
    whole, model = ml.forest_in_parts(train, 6, 7)
    assert ml.classifier_of(model).getNumTrees == 6 and len(whole.roots) == 6
    cut, first = ml.forest_in_parts(train, 6, 7, nodes=150)
    assert ml.classifier_of(first).getNumTrees == 1 and len(cut.roots) == 6  # no fit grew all trees
    assert len({tuple(cut.threshold[r : r + n]) for r, n in zip(cut.roots, cut.sizes)}) == 6  # no tree is drawn twice
    assert cut.sizes.sum() == len(cut.left) == (cut.depths() >= 0).sum() and cut.depths().max() <= 7
    assert len({cut.feature[r] for r in cut.roots}) > 1  # features are drawn per split, also in a part of one tree
    x = train.select(*ml.RETENTION_FEATURES).toPandas().to_numpy(float)
    same = (cut.probabilities(x).argmax(axis=1) == whole.probabilities(x).argmax(axis=1)).mean()
    assert same > 0.8
    joined = trees.Trees.joined([whole.pruned(trees=2), whole.pruned(depth=3)])
    votes = 2 * whole.pruned(trees=2).probabilities(x) + 6 * whole.pruned(depth=3).probabilities(x)
    assert joined.probabilities(x) * 8 == pytest.approx(votes)


def test_grid_search_grows_few_nodes_at_a_time(retention, monkeypatch):
    grown = []
    monkeypatch.setattr(ml, "FIT_NODES", 120)
    inside = ml.Trees.of
    monkeypatch.setattr(ml.Trees, "of", lambda model, spark: grown.append(model.getNumTrees) or inside(model, spark))
    ml.grid_search(retention[0], {"numTrees": (2, 5), "maxDepth": (4,)}, k=2, refit=True)
    assert max(grown) < 5 and sum(grown) in (12, 15)


def test_the_whole_grid_has_81_settings():
    import math

    assert math.prod(len(v) for v in ml.FOREST_GRID.values()) == 81


def test_retention_importances_and_confusion(retention):
    train, test = retention
    weights = ml.retention_importances(train).collect()
    for model in ("decision_tree", "random_forest"):
        assert sum(r.importance for r in weights if r.model == model) == pytest.approx(1)
    table = evaluation.confusion_matrix(ml.retention_tree(train).transform(test)).collect()
    assert sum(r.predicted_0 + r.predicted_1 for r in table) == test.count()


class Undrawn:
    """Every row once, all features in their order."""

    poisson = staticmethod(lambda n: n)
    random = staticmethod(lambda shape: np.tile(np.arange(shape[1]), (shape[0], 1)))


@pytest.fixture(scope="module")
def vectors(forest):
    return ml.pipeline(ml.DecisionTreeClassifier(), ml.RETENTION_FEATURES).getStages()[0].transform(forest[0])


def thresholds_one_by_one(values, most):
    """Spark ML's rule on all values: a split where the rows below come nearest to the next multiple."""
    counts = sorted(Counter(values).items())
    bins = min(most, len(values))
    if len(counts) <= bins:
        return [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    found, below, target = [], counts[0][1], Fraction(len(values), bins)
    for (a, _), (b, n) in zip(counts, counts[1:]):
        if abs(below - target) < abs(below + n - target):
            found.append((a + b) / 2)
            target += Fraction(len(values), bins)
        below += n
    return found


@pytest.mark.parametrize("bins", [2, 5, 32, 1000])
def test_thresholds_come_from_all_rows(spark, bins):
    picks = random.Random(4)
    data = [(picks.random(), float(int(picks.expovariate(0.2))), 0.0 if i % 3 else picks.random(), 7.0) for i in range(700)]
    df = spark.createDataFrame([(list(r),) for r in data], "x array<double>").repartition(3)
    found = forests.thresholds(df, 4, bins)
    for cuts, values in zip(found, zip(*data)):
        assert cuts.tolist() == pytest.approx(thresholds_one_by_one(values, bins))
    assert not len(found[3]) and all(len(cuts) < bins for cuts in found)


@pytest.mark.parametrize("depth, least", [(1, 1), (5, 1), (9, 4), (30, 1)])
def test_a_grown_tree_is_that_of_spark(forest, vectors, depth, least, spark):
    cells = forests.Cells.of(vectors, "features", "label", 32)
    assert cells.n.sum() == forest[0].count()
    own = forests.grown(cells, Undrawn, depth, least, 4)
    tree = ml.DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least).fit(vectors)
    given = trees.Trees.of(tree, spark)
    below = lambda t, i: () if t.feature[i] < 0 else (t.feature[i], round(t.threshold[i], 9))
    pairs = [(own.roots[0], given.roots[0])]
    for a, b in pairs:  # grows
        assert below(own, a) == below(given, b) and own.counts[a].tolist() == given.counts[b].tolist()
        assert own.rows[a] == given.rows[b] and (own.gain[a] == pytest.approx(given.gain[b]) or own.feature[a] < 0)
        if own.feature[a] >= 0:
            pairs += [(own.left[a], given.left[b]), (own.right[a], given.right[b])]
    assert len(pairs) == len(own.left) == len(given.left)
    assert own.importances(4) == pytest.approx(tree.featureImportances.toArray())


def test_a_forest_does_not_depend_on_its_parts_or_partitions(forest):
    train = forest[0]
    whole, model = ml.forest_in_parts(train, 5, 9)
    for other, _ in (ml.forest_in_parts(train.repartition(7), 5, 9, nodes=100), ml.forest_in_parts(train, 5, 9, cells=ml.classifier_of(model).cells)):
        for name in ("roots", "left", "right", "feature", "threshold", "rows", "gain", "counts"):
            assert (getattr(other, name) == getattr(whole, name)).all()
    guesses = model.transform(train).select("prediction", *ml.RETENTION_FEATURES).toPandas()
    assert (guesses.prediction == whole.probabilities(guesses[[*ml.RETENTION_FEATURES]].to_numpy(float)).argmax(axis=1)).all()


def test_the_draws_of_a_forest(forest):
    train = forest[0]
    n = train.count()
    whole, _ = ml.forest_in_parts(train, 60, 3)
    drawn = whole.rows[whole.roots]
    assert len(set(drawn)) > 20 and abs(drawn.mean() - n) < 4 * (n / 60) ** 0.5 and drawn.std() == pytest.approx(n**0.5, rel=0.4)
    for least in (1, 40):
        some, _ = ml.forest_in_parts(train, 6, 9, minInstancesPerNode=least)
        assert (some.rows >= least).all() and (least == 1 or some.rows.min() < 3 * least)


def test_a_deeper_forest_takes_no_more_jobs(forest, spark):
    jobs = []
    for depth in (2, 12):
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        ml.forest_in_parts(forest[0], 4, depth)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth {depth}")))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs[1] <= jobs[0] + 1


def test_a_forest_needs_rows_and_whole_labels(forest):
    train = forest[0]
    with pytest.raises(ValueError, match="rows"):
        ml.forest_in_parts(train.where("false"), 2, 2)
    for label in (0.5, -1.0, None):
        with pytest.raises(ValueError, match="labels"):
            ml.forest_in_parts(train.withColumn("label", F.lit(label).cast("double")), 2, 2)
    alike, _ = ml.forest_in_parts(train.withColumn("label", F.lit(0.0)), 2, 2)
    assert len(alike.left) == 2 and (alike.probabilities(np.zeros((3, 4))) == 1).all()


def test_rows_with_null_or_nan_walk_like_the_greatest(forest):
    train, _, _, arrays = forest
    odd = train.withColumn("frequency", F.when(F.col("tenure_days") % 2 == 0, None).when(F.col("tenure_days") % 3 == 0, float("nan")).otherwise(F.col("frequency")))
    great = odd.withColumn("frequency", F.when(F.isnan(F.coalesce("frequency", F.lit(float("nan")))), 1e300).otherwise(F.col("frequency")))
    found, same = (trees.right_counts(d, arrays, ml.RETENTION_FEATURES, (6,), (3, 7), (2,)) for d in (odd, great))
    assert found == same
    unlabelled = trees.right_counts(train.withColumn("label", F.lit(None).cast("double")), arrays, ml.RETENTION_FEATURES, (6,), (7,), (2,))
    assert unlabelled == {(6, 7, 2): (0, train.count())}


def test_the_grid_and_its_winner_are_fitted_on_all_rows(spark, monkeypatch):
    many = 2 * ml.MAX_FIT_ROWS + 20_000
    ids = spark.range(0, many, 1, 4).withColumn("h", F.xxhash64("id"))
    values = {c: (F.abs("h") % m).cast("double") for c, m in zip(ml.RETENTION_FEATURES, (97, 89, 83, 101))}
    train = ids.select(F.col("id").cast("string").alias("customer_id"), *[v.alias(c) for c, v in values.items()], (F.abs("h") % 2).cast("double").alias("label"))
    fitted, fit = [], ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, df, *a: fitted.append(df.count()) or fit(self, df, *a))
    _, best = ml.grid_search(train, {"numTrees": (2,), "maxDepth": (2,)}, k=2, refit=True)
    assert min(fitted[:2]) > ml.MAX_FIT_ROWS and sum(fitted[:2]) == many == fitted[2] and len(fitted) == 3
    assert best.trees.rows[best.trees.roots] == pytest.approx([many] * 2, rel=0.01)
