"""Partial dependence of a classifier on single features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.operators.classifiers import RETENTION_FEATURES, classifier_of
from shopledger.operators.trees import PrunedForest, Trees
from shopledger.plans.distribution import one_row_quantiles
from shopledger.plans.shipping import ship

#: Combinations of stretches that walk the trees at a time in a task.
ROWS = 1 << 16


def few_values(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, list[float]]:
    """The distinct values of each column, if there are fewer than ``most``.

    A task sends at most ``most`` values of a column, which is enough to know that there are too
    many; so nothing grows with the data.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set[float]] = [set() for _ in columns]
        for batch in batches:
            for values, column in zip(seen, batch.columns):
                if len(values) < most:
                    values.update(column.drop_null().unique().to_pylist())
        pairs = [(c, v) for c, values in zip(columns, seen) for v in sorted(values)[:most]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.float64())], names=["c", "v"]
        )

    picked = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    kept = picked.mapInArrow(found, "c string, v double").distinct()
    counts = {r.c: r.n for r in kept.groupBy("c").agg(F.count("v").alias("n")).collect()}
    few = [c for c in columns if counts.get(c, 0) < most]
    values = kept.where(F.col("c").isin(few)).orderBy("v").collect() if few else []
    return {c: [r.v for r in values if r.c == c] for c in few}


def feature_grids(
    df: DataFrame, columns: Sequence[str], points: int = 100
) -> dict[str, list[float]]:
    """Grid of each column: the distinct values if fewer than ``points``, else ``points`` equal
    steps between the 5 % and 95 % quantiles. At most ``points`` numbers per column reach the
    driver."""
    few = few_values(df, columns, points)
    wide = [c for c in columns if c not in few]
    ends = one_row_quantiles(df, wide, {"low": 0.05, "high": 0.95}, alpha=0.4).first() if wide else {}
    spread = lambda low, high: [low + (high - low) * i / (points - 1) for i in range(points)]
    return {c: few[c] if c in few else spread(ends[f"{c}_low"], ends[f"{c}_high"]) for c in columns}


def trees_of(model: PipelineModel | PrunedForest, df: DataFrame) -> Trees:
    return model.trees if isinstance(model, PrunedForest) else Trees.of(classifier_of(model), df.sparkSession)


def split_points(model: PipelineModel, feature: int, df: DataFrame) -> list[float]:
    """Thresholds at which the trees of the model split a feature."""
    return trees_of(model, df).splits(feature).tolist()


def stretches(df: DataFrame, trees: Trees, features: Sequence[str]) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows counted by where each feature lies among the thresholds, and a value of each stretch.

    A value equal to a threshold belongs to the stretch below it. Stretches are looked up by
    binary search on negated values, whose intervals are open at the other end.
    """
    cuts = [trees.splits(i) for i in range(len(features))]
    usual = [np.append(c, c[-1] + abs(c[-1]) + 1.0) if len(c) else np.zeros(1) for c in cuts]
    rows = df.select(*[(-F.col(f).cast("double")).alias(f"v{i}") for i, f in enumerate(features)])
    split = [i for i, c in enumerate(cuts) if len(c)]
    if split:
        rows = Bucketizer(
            inputCols=[f"v{i}" for i in split], outputCols=[f"b{i}" for i in split],
            splitsArray=[[-np.inf, *(-cuts[i][::-1]).tolist(), np.inf] for i in split],
        ).transform(rows)
    place = lambda i: (F.lit(len(cuts[i])) - F.col(f"b{i}") if len(cuts[i]) else F.lit(0)).cast("int").alias(f"s{i}")
    places = [place(i) for i in range(len(features))]
    counts = rows.select(*places).groupBy(*[f"s{i}" for i in range(len(features))]).agg(F.count(F.lit(1)).alias("n"))
    return counts, usual


def partial_dependence(
    model: PipelineModel | PrunedForest,
    df: DataFrame,
    columns: Sequence[str] = ("tenure_days", "frequency", "total_spend"),
    features: Sequence[str] = RETENTION_FEATURES,
    points: int = 100,
) -> DataFrame:
    """Mean predicted probability over all rows with one column set to each of its grid values.

    Trees predict the same for all values between two neighbouring thresholds. So rows are first
    counted per combination of stretches, of which a model with ``maxBins`` bins has a bounded
    number. Each combination walks every tree once per column, going both ways where the column
    is split; a leaf then holds, for the grid values that lead to it, the weight of all rows that
    meet it. Tasks send one sum per grid value. ``points`` is the greatest number of grid values.
    """
    spark = df.sparkSession
    ship(spark)
    trees = trees_of(model, df)
    counts, usual = stretches(df, trees, features)
    grids = feature_grids(df, columns, points)
    shared = spark.sparkContext.broadcast(trees)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, share = shared.value, shared.value.shares[:, 1]
        held = {c: np.zeros(len(trees.left)) for c in columns}
        rows = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                *places, n = (c.to_numpy(zero_copy_only=False) for c in batch.slice(start, ROWS).columns)
                x = np.column_stack([values[p] for values, p in zip(usual, places)])
                rows += int(n.sum())
                for c in columns:
                    held[c] += trees.open_weights(x, n.astype(float), features.index(c))
        for c in columns if rows else ():
            grid = np.array(grids[c])
            (leaves,) = np.nonzero(held[c])
            low, high = (np.searchsorted(grid, ends[leaves], "right") for ends in trees.intervals(features.index(c)))
            met = np.zeros(len(grid) + 1)
            np.add.at(met, low, (held[c] * share)[leaves])
            np.add.at(met, high, -(held[c] * share)[leaves])
            sums = np.cumsum(met)[:-1] / len(trees.roots)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(grid)), pa.array(grid), pa.array(sums), pa.array([rows] * len(grid), pa.int64())],
                names=["feature", "x", "total", "n"],
            )

    parts = counts.mapInArrow(walk, "feature string, x double, total double, n bigint")
    mean = (F.sum("total") / F.sum("n")).alias("y")
    return parts.groupBy("feature", "x").agg(mean).select("feature", "x", "y")
