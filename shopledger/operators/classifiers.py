"""Spark ML classifiers for customer value and retention.

The VIP label is computed from the very features that predict it, and the retention label from
the last purchase: high scores here are no evidence of predictive power.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from shopledger.operators.customers import retention_labels
from shopledger.operators.evaluation import (
    SEED,
    classification_report,
    scaling,
    standard_scale,
    train_test_split,
    with_folds,
)
from shopledger.operators.forests import Cells, CountedForest
from shopledger.operators.trees import PrunedForest, Trees, right_counts
from shopledger.plans.pinning import pin

VIP_FEATURES = ("total_spend", "num_orders", "tenure_days", "frequency", "avg_line_value")
RETENTION_FEATURES = ("tenure_days", "frequency", "total_spend", "avg_line_value")

# The hyperparameter grid of the retention forest.
FOREST_GRID = {
    "numTrees": (50, 100, 200),
    "maxDepth": (5, 10, 15),
    "minSamplesSplit": (2, 5, 10),
    "minInstancesPerNode": (1, 2, 4),
}

#: Defaults of the parameters that bound a fitted model, which lives on the driver: the deepest
#: tree Spark ML grows (in place of unbounded depth), the thresholds tried per feature, and the
#: labelled rows used to fit, chosen by a stable hash of the customer. Scoring covers all rows. The
#: forests of the grid, and the best one, are fitted on all rows.
MAX_DEPTH, MAX_BINS, MAX_FIT_ROWS = 30, 256, 200_000


#: Folds of the grid worked on at a time, and the nodes that the fits of all these may send to the
#: driver's JVM before they are taken over as arrays: some 60 bytes a node.
FITS, FIT_NODES = 3, 2_000_000

#: Bits of the hash that one scan counts by.
HASH_BITS = 16


def fit_rows(train: DataFrame, most: int | None = MAX_FIT_ROWS) -> DataFrame:
    """At most ``most`` rows of ``train``, those of the least hash of their customer; without it, all.

    Counts by hash bucket (a bounded number) show in which bucket the last row lies; the rows of
    that bucket give its hash. The rows are then filtered where they are: nothing is moved or
    sorted, and every partition keeps its share. Rows that repeat a customer stay together.
    """
    if most is None:
        return train
    hashed = F.xxhash64("customer_id")
    bucket = F.shiftright(hashed, 64 - HASH_BITS)
    counts = sorted(train.groupBy(bucket.alias("b")).count().collect())
    if sum(r["count"] for r in counts) <= most:
        return train
    below = 0
    for b, n in counts:
        if below + n >= most:
            break
        below += n
    inside = train.where(bucket == b).select(hashed.alias("h"), "customer_id").orderBy("h", "customer_id")
    last = inside.limit(most - below).agg(F.max(F.struct("h", "customer_id")).alias("last")).first()["last"]
    if last is None:  # no row is wanted
        return train.where(F.lit(False))
    return train.where((hashed < last["h"]) | ((hashed == last["h"]) & (F.col("customer_id") <= last["customer_id"])))


def vip_frames(cust: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scaled train and test frames with ``label`` 1 for VIP; the scale is fitted on train."""
    label = (F.col("customer_segment") == "VIP").cast("double")
    rows = pin(cust.select("customer_id", *VIP_FEATURES, label.alias("label")), "vip")
    train, test = train_test_split(rows)
    fitted = scaling(train, VIP_FEATURES)
    return tuple(pin(standard_scale(d, fitted, VIP_FEATURES), "scaled") for d in (train, test))


def retention_frames(
    cust: DataFrame, year: int, include_new: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames with ``label`` 1 for retained customers."""
    labelled = retention_labels(cust, year, include_new)
    features = [F.col(c).cast("double").alias(c) for c in RETENTION_FEATURES]
    rows = pin(
        labelled.select("customer_id", *features, F.col("is_retained").cast("double").alias("label")),
        "retention",
    )
    return train_test_split(rows)


def pipeline(classifier: Estimator, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), classifier])


def classifier_of(model: PipelineModel) -> Model:
    return model.stages[-1]


def vip_estimators(
    train_rows: int, max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS
) -> dict[str, Estimator]:
    """Logistic regression with unit inverse penalty, a full tree, and 100 full trees."""
    return {
        "logistic_regression": LogisticRegression(
            regParam=1.0 / train_rows, elasticNetParam=0.0, standardization=False
        ),
        "decision_tree": DecisionTreeClassifier(maxDepth=max_depth, maxBins=max_bins, seed=SEED),
        "random_forest": RandomForestClassifier(
            numTrees=100, maxDepth=max_depth, maxBins=max_bins, seed=SEED
        ),
    }


def cross_validate(
    estimator: Estimator,
    train: DataFrame,
    features: Sequence[str],
    k: int,
    grid: Sequence[dict] = ({},),
    parallelism: int | None = None,
    most: int = MAX_FIT_ROWS,
) -> list[list[float]]:
    """Accuracy of every grid point (outer) on each of the k folds; nothing else is fitted.

    The folds hold every row of ``train``, and each held-out fold is scored whole; at most
    ``most`` of the other rows fit an estimator. ``parallelism`` is the number of settings fitted
    at a time, by default one for every two cores of the session.
    """
    spark = train.sparkSession
    parallelism = parallelism or max(1, spark.sparkContext.defaultParallelism // 2)
    folds = with_folds(train, k)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    estimator, points = pipeline(estimator, features), list(grid)
    scores = [[0.0] * k for _ in points]
    for fold in range(k):
        fit = pin(fit_rows(folds.where(F.col("fold") != fold), most), "fold")
        held = pin(folds.where(F.col("fold") == fold), "fold")

        def score(i: int, fit: DataFrame = fit, held: DataFrame = held) -> tuple[int, float]:
            return i, accuracy.evaluate(estimator.fit(fit, points[i]).transform(held))

        with ThreadPool(min(parallelism, len(points))) as pool:
            for i, value in pool.imap_unordered(inheritable_thread_target(spark)(score), range(len(points))):
                scores[i][fold] = value
    return scores


def fit_vip_classifiers(train: DataFrame, most: int = MAX_FIT_ROWS) -> dict[str, PipelineModel]:
    train = pin(fit_rows(train, most), "fit")
    models = vip_estimators(train.count())
    return {name: pipeline(m, VIP_FEATURES).fit(train) for name, m in models.items()}


def vip_cross_validation(train: DataFrame, k: int = 5, most: int = MAX_FIT_ROWS) -> DataFrame:
    """Mean and (population) standard deviation of the fold accuracies of each model."""
    rows = []
    for name, estimator in vip_estimators(min(train.count(), most)).items():
        scores = cross_validate(estimator, train, VIP_FEATURES, k, most=most)[0]
        rows.append((name, fmean(scores), pstdev(scores)))
    return train.sparkSession.createDataFrame(rows, "model string, cv_mean double, cv_std double")


def _per_model(frames: dict[str, DataFrame]) -> DataFrame:
    named = [df.withColumn("model", F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, named)


def vip_reports(models: dict[str, PipelineModel], test: DataFrame) -> DataFrame:
    """Classification report of each model on the test rows."""
    return _per_model({n: classification_report(m.transform(test)) for n, m in models.items()})


def vip_importances(models: dict[str, PipelineModel], like: DataFrame) -> DataFrame:
    """Importances (trees) and coefficients (regression) of each model."""
    return _per_model({n: feature_importance(m, VIP_FEATURES, like) for n, m in models.items()})


def feature_importance(
    model: PipelineModel | PrunedForest, features: Sequence[str], like: DataFrame
) -> DataFrame:
    """Importance of each feature (trees) or its signed coefficient, highest first."""
    fitted = classifier_of(model)
    if isinstance(model, PrunedForest):
        weights = model.trees.importances(len(features))
    else:
        weights = (fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients).toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    frame = like.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


def retention_tree(train: DataFrame, most: int = MAX_FIT_ROWS) -> PipelineModel:
    tree = DecisionTreeClassifier(maxDepth=3, seed=SEED)
    return pipeline(tree, RETENTION_FEATURES).fit(fit_rows(train, most))


def retention_forest(train: DataFrame, most: int = MAX_FIT_ROWS) -> PipelineModel:
    forest = RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED)
    return pipeline(forest, RETENTION_FEATURES).fit(fit_rows(train, most))


def retention_importances(train: DataFrame) -> DataFrame:
    """Importances of the retention tree and forest."""
    models = {"decision_tree": retention_tree(train), "random_forest": retention_forest(train)}
    return _per_model({n: feature_importance(m, RETENTION_FEATURES, train) for n, m in models.items()})


def tree_rules(model: PipelineModel, features: Sequence[str], like: DataFrame) -> DataFrame:
    """The fitted tree as text, one row per line, with feature names."""
    text = classifier_of(model).toDebugString
    for i, name in reversed(list(enumerate(features))):
        text = text.replace(f"feature {i} ", f"{name} ")
    rows = list(enumerate(text.strip().splitlines()))
    return like.sparkSession.createDataFrame(rows, "line int, rule string")


def forest_in_parts(
    fit: DataFrame, num_trees: int, max_depth: int, nodes: int = FIT_NODES, cells: Cells | None = None, **others
) -> tuple[Trees, PipelineModel]:
    """The trees of a forest that is fitted in parts of about ``nodes`` nodes, and the first part.

    A tree depends on its number, so parts make up the same forest as one fit. The first part is so
    small that its trees cannot exceed the nodes, whatever they look like; the mean size of the trees
    found last sets how many the next part has, at least one. ``cells`` may be those of an earlier
    fit of the same rows.
    """
    # Features are drawn for a split only where there is more than one tree, as Spark does.
    drawn = {"featuresTried": "sqrt" if num_trees > 1 else "all"} | others
    size = max(1, min(2 ** (max_depth + 1), 2 * fit.count()))
    parts: list[Trees] = []
    first, done = None, 0
    while done < num_trees:
        count = min(num_trees - done, max(1, int(nodes // size)))
        forest = CountedForest(cells, numTrees=count, maxDepth=max_depth, seed=SEED, firstTree=done, **drawn)
        model = pipeline(forest, RETENTION_FEATURES).fit(fit)
        cells = classifier_of(model).cells
        parts.append(Trees.of(classifier_of(model), fit.sparkSession))
        size = parts[-1].sizes.mean()
        first, done = first or model, done + count
    return Trees.joined(parts), first


#: Parameters that prune a forest: its trees, depth, and the rows a node needs to be split.
PRUNING = {"numTrees": 20, "maxDepth": 5, "minSamplesSplit": 2}


def grid_search(
    train: DataFrame,
    grid: dict[str, Sequence] = FOREST_GRID,
    k: int = 3,
    parallelism: int | None = None,
    most: int | None = None,
    refit: bool = False,
) -> tuple[DataFrame, PrunedForest | None]:
    """k-fold accuracy of every forest of ``grid``, best first.

    Per fold and setting of the parameters that change the splits, one forest is fitted with the
    most trees and the greatest depth; its prunings give the accuracies of all other settings on
    the whole held-out fold. With ``refit`` also the best forest, fitted with its own number of
    trees and depth and pruned to its least rows of a split; of equal scores the first setting of
    the grid wins. Forests are fitted on all rows, or on ``most`` if given. ``parallelism`` is the
    number of folds worked on at a time, by default ``FITS``: the short steps of one leave most of
    a cluster to others. Their fits send about ``FIT_NODES`` nodes to the driver at a time.
    """
    spark = train.sparkSession
    parallelism = min(parallelism or FITS, k)
    pruning = {name: list(grid.get(name, (usual,))) for name, usual in PRUNING.items()}
    grown = {name: list(values) for name, values in grid.items() if name not in PRUNING}
    fits = [dict(zip(grown, values)) for values in product(*grown.values())]
    folds = with_folds(train, k)
    sides = [
        (pin(fit_rows(folds.where(F.col("fold") != fold), most), "fold"), pin(folds.where(F.col("fold") == fold), "fold"))
        for fold in range(k)
    ]

    def score(fold: int) -> list[tuple[int, int, dict]]:
        (fit, held), cells, found = sides[fold], None, []
        for i, setting in enumerate(fits):
            largest = max(pruning["numTrees"]), max(pruning["maxDepth"])
            trees, first = forest_in_parts(fit, *largest, FIT_NODES // parallelism, cells, **setting)
            cells = classifier_of(first).cells
            found.append((fold, i, right_counts(held, trees, RETENTION_FEATURES, *pruning.values())))
            del trees, first  # the driver holds one forest of a fold at a time
        return found

    with ThreadPool(parallelism) as pool:
        scored = pool.imap_unordered(inheritable_thread_target(spark)(score), range(k))
        found = {(fold, i): right for of_fold in scored for fold, i, right in of_fold}
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    rows = []
    for point in points:
        i = fits.index({name: point[name] for name in grown})
        cell = tuple(point.get(name, usual) for name, usual in PRUNING.items())
        hits = [found[fold, i].get(cell, (0, 0)) for fold in range(k)]
        rows.append((*point.values(), fmean(right / n if n else 0.0 for right, n in hits)))
    best = None
    if refit:
        winner = dict(points[max(range(len(rows)), key=lambda r: rows[r][-1])])
        least = winner.pop("minSamplesSplit", PRUNING["minSamplesSplit"])
        usual = {name: winner.pop(name, PRUNING[name]) for name in ("numTrees", "maxDepth")}
        trees, first = forest_in_parts(pin(fit_rows(train, most), "fit"), *usual.values(), FIT_NODES, **winner)
        best = PrunedForest(first, trees.pruned(least), RETENTION_FEATURES)
    columns = ", ".join(f"{name} int" for name in grid)
    table = spark.createDataFrame(rows, f"{columns}, score double")
    return table.orderBy(F.desc("score"), *grid), best


def best_model_report(best: PipelineModel | PrunedForest, test: DataFrame) -> DataFrame:
    """Report, accuracy and importances of the winner in long form."""
    report = classification_report(best.transform(test))
    scores = report.unpivot(
        "class", ["precision", "recall", "f1"], "measure", "value"
    ).select(F.lit("report").alias("section"), F.col("class").alias("name"), "measure", "value")
    weights = feature_importance(best, RETENTION_FEATURES, test).select(
        F.lit("importance").alias("section"),
        F.col("feature").alias("name"),
        F.lit("importance").alias("measure"),
        F.col("importance").alias("value"),
    )
    return scores.unionByName(weights)
