"""Splits, folds and scores of classifiers.

Predictions carry integer-valued ``label`` and ``prediction`` columns. Every score comes from
the counts by (label, prediction).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.plans.rows import with_row

SEED = 42


def hash_bucket(buckets: int, *keys: str | Column, seed: int = SEED) -> Column:
    """A bucket from 0 to ``buckets - 1`` that depends only on the keys and the seed."""
    text = F.concat_ws(":", *keys, F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return (number % buckets).cast("int")


def train_test_split(
    df: DataFrame, key: str = "customer_id", share: float = 0.8, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Rows of each key always fall on the same side, however the data is partitioned."""
    bucket = hash_bucket(1000, key, seed=seed)
    limit = round(share * 1000)
    return df.where(bucket < limit), df.where(bucket >= limit)


def with_folds(df: DataFrame, k: int, key: str = "customer_id", seed: int = SEED) -> DataFrame:
    """``fold`` from 0 to k-1, hashed within each label."""
    bucket = hash_bucket(k, F.lit("fold"), F.col("label").cast("int").cast("string"), key, seed=seed)
    return df.withColumn("fold", bucket)


def scaling(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each feature, in one row."""
    return train.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in features],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std") for c in features],
    )


def standard_scale(df: DataFrame, fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """z-scores by the statistics of :func:`scaling`; a constant feature is only centred."""
    row = F.col("_fit")
    scaled = {
        c: (F.col(c).cast("double") - row[f"{c}_mean"])
        / F.when(row[f"{c}_std"] == 0, 1.0).otherwise(row[f"{c}_std"])
        for c in features
    }
    return with_row(df, fitted, "_fit").withColumns(scaled).drop("_fit")


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """Rows by (label, prediction)."""
    return predictions.groupBy(
        F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per label, one column ``predicted_<c>`` per class."""
    counts = [
        F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(f"predicted_{c}")
        for c in classes
    ]
    return confusion_counts(predictions).groupBy("label").agg(*counts)


def accuracy(predictions: DataFrame) -> DataFrame:
    """Share of rows whose prediction is right."""
    right = (F.col("label") == F.col("prediction")).cast("double")
    return predictions.agg(F.avg(right).alias("accuracy"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class, then accuracy, macro and weighted means.

    A score without a defined value is 0.
    """
    right = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    as_label = F.struct(
        F.col("label").alias("class"),
        F.col("n").alias("support"),
        none.alias("predicted"),
        right.cast("bigint").alias("hits"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("class"),
        none.alias("support"),
        F.col("n").alias("predicted"),
        none.alias("hits"),
    )
    sides = confusion_counts(predictions).select(
        F.explode(F.array(as_label, as_prediction)).alias("s")
    )
    per_class = (
        sides.select("s.*")
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )

    def score(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    precision = score(F.col("hits"), F.col("predicted"))
    recall = score(F.col("hits"), F.col("support"))
    per_class = per_class.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", score(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    scores = ["precision", "recall", "f1"]
    hit_share = score(F.sum("hits"), F.sum("support"))
    rows = {
        "accuracy": [hit_share, hit_share, hit_share],
        "macro avg": [F.avg(c) for c in scores],
        "weighted avg": [score(F.sum(F.col(c) * F.col("support")), F.sum("support")) for c in scores],
    }
    structs = [
        F.struct(
            F.lit(name).alias("class"),
            *[v.alias(c) for v, c in zip(values, scores)],
            F.sum("support").alias("support"),
        )
        for name, values in rows.items()
    ]
    summary = per_class.agg(F.array(*structs).alias("rows")).select(F.explode("rows").alias("r"))
    classes = per_class.select(F.col("class").cast("string").alias("class"), *scores, "support")
    return classes.unionByName(summary.select("r.*"))
