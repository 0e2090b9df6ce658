"""Node tables of fitted trees and forests: exact pruning, predictions of many prunings at once.

A forest grown without a minimum split size holds every forest with one: a node of fewer rows
becomes a leaf, and its own class counts are the prediction. The same goes for a smaller depth
and for fewer trees. So one fit serves every setting of these three parameters.

A model lives on the driver and is sent to the workers, as Spark ML does itself; its size is
bounded by the number of trees, their depth, and the rows that fit it. Spark's own objects take
about ten times the memory of these arrays, so a large forest is fitted in parts, joined as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.plans.pinning import shared_path
from shopledger.plans.shipping import ship

#: Rows that walk the trees at a time in a task.
ROWS = 4096


def node_table(model: Model, spark: SparkSession) -> DataFrame:
    """One row per node: tree, node, left, right, feature, threshold, rows, gain, counts by class.

    A leaf has feature -1. ``rows`` counts the rows that fitted the node, drawn twice or more as
    often as drawn.
    """
    path = shared_path(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    return saved.select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
        F.col("rawCount").alias("rows"), "gain", F.col("impurityStats").alias("counts"),
    )


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees, one array per column; children are positions in the arrays."""

    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, model: Model, spark: SparkSession) -> Trees:
        """Of a model fitted by Spark, or of one that holds its nodes."""
        nodes = getattr(model, "nodes", None)
        return nodes if isinstance(nodes, cls) else cls.of_nodes(node_table(model, spark).toArrow())

    @classmethod
    def of_nodes(cls, table: pa.Table) -> Trees:
        """Of a table like that of :func:`node_table`."""
        table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
        col = lambda name: table[name].to_numpy()
        sizes = np.unique(col("tree"), return_counts=True)[1]
        roots = np.cumsum(sizes) - sizes
        shift = np.repeat(roots, sizes)  # nodes of a tree are numbered from 0 without gaps
        child = lambda name: np.where(col("feature") < 0, -1, col(name) + shift).astype(np.int32)
        counts = table["counts"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        return cls(
            roots, child("left"), child("right"), col("feature").astype(np.int16), col("threshold").astype(float),
            col("rows"), col("gain").astype(float), counts,
        )

    @classmethod
    def joined(cls, parts: Sequence[Trees]) -> Trees:
        """One forest of the trees of all parts, in their order."""
        if len(parts) == 1:
            return parts[0]
        sizes = [len(p.left) for p in parts]
        shift = np.cumsum(sizes) - sizes
        child = lambda name: [np.where(p.feature < 0, -1, getattr(p, name) + s).astype(np.int32) for p, s in zip(parts, shift)]
        columns = {name: [getattr(p, name) for p in parts] for name in ("feature", "threshold", "rows", "gain", "counts")}
        columns |= {"roots": [p.roots + s for p, s in zip(parts, shift)], "left": child("left"), "right": child("right")}
        return cls(**{name: np.concatenate(arrays) for name, arrays in columns.items()})

    @property
    def sizes(self) -> np.ndarray:
        """Nodes of each tree."""
        return np.diff(np.append(self.roots, len(self.left)))

    @property
    def shares(self) -> np.ndarray:
        """Share of each class among the rows of each node."""
        return self.counts / np.maximum(self.counts.sum(axis=1, keepdims=True), 1e-300)

    def depths(self) -> np.ndarray:
        depth = np.full(len(self.left), -1)
        level, nodes = 0, self.roots
        while len(nodes):
            depth[nodes] = level
            inner = nodes[self.feature[nodes] >= 0]
            level, nodes = level + 1, np.concatenate([self.left[inner], self.right[inner]])
        return depth

    def pruned(self, least_rows: int = 0, depth: int | None = None, trees: int | None = None) -> Trees:
        """The first ``trees`` trees; nodes of fewer than ``least_rows`` rows, or at ``depth``, are leaves."""
        leaf = (self.feature < 0) | (self.rows < least_rows)
        if depth is not None:
            leaf |= self.depths() >= depth
        cut = replace(self, roots=self.roots[:trees], feature=np.where(leaf, -1, self.feature))
        kept = cut.depths() >= 0
        place = np.cumsum(kept) - 1
        moved = lambda child: np.where(leaf, -1, place[child])[kept]
        return Trees(
            place[cut.roots], moved(self.left), moved(self.right), cut.feature[kept], self.threshold[kept],
            self.rows[kept], self.gain[kept], self.counts[kept],
        )

    def merged(self) -> Trees:
        """Splits between two leaves of one class taken back, from below up."""
        guess, feature, depth = self.counts.argmax(axis=1), self.feature.copy(), self.depths()
        for level in range(depth.max() - 1, -1, -1):
            (nodes,) = np.nonzero((depth == level) & (feature >= 0))
            left, right = self.left[nodes], self.right[nodes]
            feature[nodes[(feature[left] < 0) & (feature[right] < 0) & (guess[left] == guess[right])]] = -1
        return replace(self, feature=feature).pruned()

    def step(self, nodes: np.ndarray, x: np.ndarray, least_rows: int = 0) -> np.ndarray:
        """Where the rows of ``x`` at these nodes go; they stay at leaves and small nodes."""
        feature = self.feature[nodes]
        goes = (feature >= 0) & (self.rows[nodes] >= least_rows)
        value = x[np.arange(len(x)), np.maximum(feature, 0)]
        child = np.where(value <= self.threshold[nodes], self.left[nodes], self.right[nodes])
        return np.where(goes, child, nodes)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the class shares at the leaf of each row."""
        shares = self.shares
        total = np.zeros((len(x), shares.shape[1]))
        for root in self.roots:
            nodes, before = np.full(len(x), root), None
            while before is None or (nodes != before).any():
                nodes, before = self.step(nodes, x), nodes
            total += shares[nodes]
        return total / len(self.roots)

    def predictions(
        self, x: np.ndarray, trees: Sequence[int], depths: Sequence[int], least_rows: Sequence[int]
    ) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(trees, depth, least rows, predicted classes) of every pruning, in one walk of the rows.

        Each tree is walked once per minimum; the depths are stops on the way, and the first
        trees of a forest are a smaller one.
        """
        shares = self.shares
        total = np.zeros((len(depths), len(least_rows), len(x), shares.shape[1]))
        for done, root in enumerate(self.roots[: max(trees)], 1):
            for j, least in enumerate(least_rows):
                nodes = np.full(len(x), root)
                for level in range(max(depths) + 1):
                    for i in (i for i, d in enumerate(depths) if d == level):
                        total[i, j] += shares[nodes]
                    nodes = self.step(nodes, x, least)
            if done in trees:
                for i, depth in enumerate(depths):
                    for j, least in enumerate(least_rows):
                        yield done, depth, least, total[i, j].argmax(axis=1)

    def splits(self, feature: int) -> np.ndarray:
        """Thresholds at which the trees split a feature, ascending."""
        return np.unique(self.threshold[self.feature == feature])

    def intervals(self, feature: int) -> tuple[np.ndarray, np.ndarray]:
        """For every node the values of a feature, above the first and up to the second, that reach it."""
        low, high = np.full(len(self.left), -np.inf), np.full(len(self.left), np.inf)
        nodes = self.roots
        while len(nodes):
            inner = nodes[self.feature[nodes] >= 0]
            for side in (self.left, self.right):
                low[side[inner]], high[side[inner]] = low[inner], high[inner]
            cut = inner[self.feature[inner] == feature]
            high[self.left[cut]] = np.minimum(high[cut], self.threshold[cut])
            low[self.right[cut]] = np.maximum(low[cut], self.threshold[cut])
            nodes = np.concatenate([self.left[inner], self.right[inner]])
        return low, high

    def open_weights(self, x: np.ndarray, weight: np.ndarray, freed: int) -> np.ndarray:
        """Weight of the rows at every leaf when splits on the freed feature let rows go both ways."""
        columns, total = np.asfortranarray(x), np.zeros(len(self.left))
        for root in self.roots:
            waiting = [(root, np.arange(len(x)))]
            while waiting:
                node, rows = waiting.pop()
                feature = self.feature[node]
                if feature < 0:
                    total[node] += weight[rows].sum()
                elif feature == freed:
                    waiting += [(self.left[node], rows), (self.right[node], rows)]
                else:
                    low = columns[rows, feature] <= self.threshold[node]
                    some = [(self.left[node], rows[low]), (self.right[node], rows[~low])]
                    waiting += [s for s in some if len(s[1])]
        return total

    def importances(self, features: int) -> np.ndarray:
        """Gain of the splits on each feature, weighted by their rows; trees count alike."""
        total = np.zeros(features)
        ends = np.append(self.roots[1:], len(self.left))
        for begin, end in zip(self.roots, ends):
            inner = np.arange(begin, end)[self.feature[begin:end] >= 0]
            weight = self.counts[inner].sum(axis=1)
            one = np.bincount(self.feature[inner], self.gain[inner] * weight, features)
            total += one / one.sum() if one.sum() else 0
        return total / total.sum() if total.sum() else total


@dataclass(frozen=True)
class PrunedForest:
    """A fitted pipeline whose last stage is a forest, with prunings of that forest.

    Of a forest fitted in parts, the pipeline is that of the first one; ``trees`` are those of all.
    """

    fitted: PipelineModel
    trees: Trees
    features: tuple[str, ...]

    @property
    def stages(self) -> list:
        return self.fitted.stages

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` and ``prediction``."""
        return predicted(df, self.trees, [F.col(c).cast("double") for c in self.features])


def predicted(df: DataFrame, trees: Trees, features: Sequence[Column]) -> DataFrame:
    """``df`` and ``prediction``, the class of the greatest mean share."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def guess(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        parts = [shared.value.probabilities(x[i : i + ROWS]).argmax(axis=1) for i in range(0, len(x), ROWS)]
        return pd.Series(np.concatenate(parts).astype(float))

    return df.withColumn("prediction", F.pandas_udf("double")(guess)(*features))


def counted(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Rows (``n``) by the bins of their features between ascending cuts, and by ``label``.

    A value equal to a cut lies below it; null and NaN lie in the last bin, where trees send them.
    """
    ship(df.sparkSession)
    names = [*features, "label"]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *values, label = batch.columns
            places = [np.searchsorted(c, v.to_numpy(zero_copy_only=False)) for c, v in zip(cuts, values)]
            yield pa.RecordBatch.from_arrays([*[pa.array(p, pa.int32()) for p in places], label], names=names)

    picked = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col("label").cast("double").alias("label"))
    placed = picked.mapInArrow(bins, ", ".join(f"{c} int" for c in features) + ", label double")
    return placed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def right_counts(
    df: DataFrame, trees: Trees, features: Sequence[str], counts: Sequence[int], depths: Sequence[int], least_rows: Sequence[int]
) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(right, all) rows of ``df`` by (trees, depth, least rows). Tasks send one row per setting.

    Rows between the same thresholds of the trees go the same way, so they are counted first and
    walk the trees as one.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees)
    cuts = [trees.splits(i) for i in range(len(features))]
    usual = [np.append(c, np.inf) for c in cuts]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right: dict[tuple[int, int, int], int] = {}
        rows = 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                *places, label, n = (c.to_numpy(zero_copy_only=False) for c in batch.slice(i, ROWS).columns)
                x = np.column_stack([values[p] for values, p in zip(usual, places)])
                rows += int(n.sum())
                for count, depth, least, guess in shared.value.predictions(x, counts, depths, least_rows):
                    right[count, depth, least] = right.get((count, depth, least), 0) + int(n[guess == label].sum())
        if rows:
            columns = [*zip(*right), right.values(), [rows] * len(right)]
            names = ["trees", "depth", "least", "hits", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    cells = counted(df, features, cuts).repartition(4 * spark.sparkContext.defaultParallelism)
    parts = cells.mapInArrow(score, "trees bigint, depth bigint, least bigint, hits bigint, n bigint")
    sums = parts.groupBy("trees", "depth", "least").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    found = {(r.trees, r.depth, r.least): (r.hits, r.n) for r in sums.collect()}
    shared.destroy()
    return found
