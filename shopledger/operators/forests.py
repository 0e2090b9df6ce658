"""Random forests grown from counts: all rows count, and a tree is the work of one task.

Trees split at a bounded number of thresholds per feature, so all they need to know of the rows is
how many lie in each cell, that is in each combination of bins and label: at most bins to the power
of the features, times the classes, however many the rows. Thresholds are exact, from the running
counts of all values. The cells are sent to the workers, where every tree is grown from its own
draws; a sum of Poisson draws, one per row of a cell, is one Poisson draw of their number.

Splits are chosen as Spark ML chooses them: a random part of the features per node, the greatest
fall of the Gini impurity, no side of fewer than ``minInstancesPerNode`` drawn rows. So are the
thresholds (of all rows, where Spark takes them from some 10,000), and splits between leaves of one
class are taken back. A tree depends on the rows, the seed and its number, not on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.operators.trees import Trees, counted, predicted
from shopledger.plans.placement import place, running_sums
from shopledger.plans.shipping import ship

#: Impurities up to this one count as none, as in Spark.
NONE = 2.0**-52

NODES = "tree int, node int, left int, right int, feature int, threshold double, rows int, gain double, counts array<int>"


def thresholds(rows: DataFrame, features: int, max_bins: int) -> list[np.ndarray]:
    """Thresholds of each feature of ``rows`` (a column ``x`` of arrays), at most ``max_bins - 1``.

    They lie halfway between neighbouring values: between all of them if these are few, else where
    the rows below come nearest to each multiple of an equal share of the rows, each place once.
    Ranks are exact, by running counts over ranges of values; only the values around the
    thresholds reach the driver.
    """
    values = rows.select(F.posexplode("x").alias("feature", "value")).groupBy("feature", "value")
    counts = values.agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("bigint").alias("i"))
    ranked = running_sums(place(counts, ["feature", "value"], ["feature"]), ["feature"], ["value"], ["n", "i"])
    bins = F.least(F.lit(max_bins), F.col("n_all"))
    # Multiples of the share that lie nearer to the rows below this value than to those up to it.
    passed = F.floor(((2 * F.col("n_upto") - F.col("n")) * bins - 1) / (2 * F.col("n_all")))
    firsts = ranked.withColumn("passed", F.greatest(passed, F.lit(0))).groupBy("feature", "passed")
    firsts = firsts.agg(F.min("i_upto").alias("at"), F.first("i_all").alias("of"), F.first(bins).alias("bins")).collect()
    wanted = []
    for f in range(features):
        found = sorted((r.passed, r["at"]) for r in firsts if r.feature == f)
        of, bins = next(((r["of"], r.bins) for r in firsts if r.feature == f), (0, 1))
        last = 1  # places are the numbers, from 1, of the values above the thresholds
        for k in range(1, of if of <= bins else bins):
            last = last + 1 if of <= bins else max(last + 1, min((at for passed, at in found if passed >= k), default=of + 1))
            if last <= of:
                wanted.append((f, last))
    near = sorted({(f, i) for f, at in wanted for i in (at - 1, at)})
    if not near:
        return [np.empty(0)] * features
    keys = [F.struct(F.lit(f).alias("feature"), F.lit(i).cast("bigint").alias("i")) for f, i in near]
    here = ranked.where(F.struct("feature", F.col("i_upto").alias("i")).isin(keys))
    value = {(r.feature, r.i_upto): r.value for r in here.select("feature", "i_upto", "value").collect()}
    return [np.array([(value[f, at - 1] + value[f, at]) / 2 for g, at in wanted if g == f]) for f in range(features)]


@dataclass(frozen=True)
class Cells:
    """Rows counted by the bins of their features and by label; a bin ends at its threshold."""

    cuts: list[np.ndarray]
    max_bins: int
    bins: np.ndarray
    label: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, features: str, label: str, max_bins: int) -> Cells:
        rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"))
        first = rows.first()
        if first is None:
            raise ValueError("a forest needs rows to fit")
        size = len(first.x)
        cuts = thresholds(rows, size, max_bins)
        names = [f"x{i}" for i in range(size)]
        cells = counted(rows.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(names)], "label"), names, cuts)
        # The order of the cells decides who gets which draw.
        found = cells.toArrow().sort_by([(c, "ascending") for c in (*names, "label")])
        label = found["label"].to_numpy()
        if not (label >= 0).all() or (label != np.floor(label)).any():
            raise ValueError("labels must be whole numbers from 0")
        bins = np.column_stack([found[c].to_numpy() for c in names])
        small = np.uint8 if max_bins <= 256 else np.int32
        return cls(cuts, max_bins, bins.astype(small), label.astype(int), found["n"].to_numpy())


def gini(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Gini impurity of counts by class (last axis); 0 where there are no rows.

    Squares are taken off one by one, as Spark does, so equal splits are told apart alike.
    """
    left, of = np.ones(rows.shape), np.maximum(rows, 1)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / of
        left -= share * share
    return np.where(rows > 0, left, 0.0)


def grown(cells: Cells, rng: np.random.Generator, max_depth: int, least: int, drawn: int) -> Trees:
    """One tree, level by level; ``drawn`` features are tried per node, sides have ``least`` rows or more."""
    features, width, classes = len(cells.cuts), 1 + max(map(len, cells.cuts)), 1 + int(cells.label.max())
    weight = rng.poisson(cells.n)
    (kept,) = np.nonzero(weight)
    bins, label, weight = cells.bins[kept], cells.label[kept], weight[kept]
    at = np.zeros(len(kept), int)  # the node of each cell, by its place in the level
    levels, size, done = [], 1, 0
    while size:
        counts = np.bincount(at * classes + label, weight, size * classes).reshape(size, classes)
        rows = counts.sum(axis=1)
        impurity = gini(counts, rows)
        feature, cut, gain = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        (tried,) = np.nonzero((impurity > NONE) & (len(levels) < max_depth) & (width > 1))
        slot = np.full(size, -1)
        slot[tried] = np.arange(len(tried))
        stay = slot[at] >= 0
        bins, label, weight, at = bins[stay], label[stay], weight[stay], at[stay]
        picked = rng.random((len(tried), features)).argsort(axis=1)[:, :drawn]
        for f in picked.T if len(tried) else ():
            in_slot = slot[at]
            column = bins[np.arange(len(at)), f[in_slot]]
            shape = (len(tried), width, classes)
            met = np.bincount((in_slot * width + column) * classes + label, weight, math.prod(shape)).reshape(shape)
            left = met.cumsum(axis=1)[:, :-1]
            right = counts[tried, None] - left
            n_left, n_right = left.sum(axis=2), right.sum(axis=2)
            of = rows[tried, None]
            fall = impurity[tried, None] - n_left / of * gini(left, n_left) - n_right / of * gini(right, n_right)
            fall[(n_left < max(least, 1)) | (n_right < max(least, 1))] = 0.0
            best = fall.argmax(axis=1)
            value = fall[np.arange(len(tried)), best]
            better = value > gain[tried]
            node = tried[better]
            feature[node], cut[node], gain[node] = f[better], best[better], value[better]
        (split,) = np.nonzero(feature >= 0)
        slot = np.full(size, -1)
        slot[split] = np.arange(len(split))
        stay = slot[at] >= 0
        bins, label, weight, at = bins[stay], label[stay], weight[stay], at[stay]
        child = np.where(slot >= 0, done + size + 2 * slot, -1)
        limit = np.array([cells.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature, cut)])
        levels.append((child, np.where(child >= 0, child + 1, -1), feature, limit, rows.astype(int), gain, counts))
        above = bins[np.arange(len(at)), feature[at]] > cut[at]
        at = 2 * slot[at] + above
        done, size = done + size, 2 * len(split)
    return Trees(np.zeros(1, int), *[np.concatenate(column) for column in zip(*levels)]).merged()


class _ForestParams(HasFeaturesCol, HasLabelCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees of the forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "splits on the longest way down", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, at most", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "drawn rows on either side of a split, at least", TypeConverters.toInt)
    featuresTried = Param(Params._dummy(), "featuresTried", "features tried per node: sqrt (of their number) or all", TypeConverters.toString)
    firstTree = Param(Params._dummy(), "firstTree", "number of the first tree, where this is a part of a forest", TypeConverters.toInt)


class CountedForest(Estimator, _ForestParams):
    """A classifier like Spark's forest, whose trees are grown from the :class:`Cells` of the rows.

    ``cells`` may be those of an earlier fit of the same rows, which are then not counted again.
    """

    def __init__(self, cells: Cells | None = None, **params):
        super().__init__()
        self._setDefault(
            numTrees=20, maxDepth=5, maxBins=32, minInstancesPerNode=1, featuresTried="sqrt", firstTree=0, seed=0
        )
        self._set(**params)
        self.cells = cells

    def _fit(self, dataset: DataFrame) -> CountedForestModel:
        spark = dataset.sparkSession
        ship(spark)
        usual = {name: self.getOrDefault(name) for name in ("seed", "firstTree", "maxDepth", "minInstancesPerNode", "numTrees")}
        seed, first, depth, least, count = usual.values()
        cells = self.cells
        if cells is None or cells.max_bins != self.getOrDefault("maxBins"):
            cells = Cells.of(dataset, self.getFeaturesCol(), self.getLabelCol(), self.getOrDefault("maxBins"))
        features = len(cells.cuts)
        tried = features if self.getOrDefault("featuresTried") == "all" else math.ceil(math.sqrt(features))
        shared = spark.sparkContext.broadcast(cells)

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number in (i for batch in batches for i in batch.column(0).to_pylist()):
                yield _node_rows(number, grown(shared.value, np.random.default_rng([seed, number]), depth, least, tried))

        tasks = min(count, 4 * spark.sparkContext.defaultParallelism)
        nodes = spark.range(first, first + count, 1, tasks).mapInArrow(grow, NODES).toArrow()
        shared.destroy()
        return self._copyValues(CountedForestModel(Trees.of_nodes(nodes), cells))


def _node_rows(number: int, tree: Trees) -> pa.RecordBatch:
    size, classes = tree.counts.shape
    whole = lambda column: pa.array(column, pa.int32())
    counts = pa.ListArray.from_arrays(whole(np.arange(size + 1) * classes), whole(tree.counts.ravel().astype(np.int32)))
    columns = [
        whole(np.full(size, number)), whole(np.arange(size)), whole(tree.left), whole(tree.right), whole(tree.feature),
        pa.array(tree.threshold, pa.float64()), whole(tree.rows), pa.array(tree.gain, pa.float64()), counts,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "node", "left", "right", "feature", "threshold", "rows", "gain", "counts"])


class CountedForestModel(Model, _ForestParams):
    """The trees as arrays (``nodes``), and the cells they were grown from."""

    def __init__(self, nodes: Trees, cells: Cells):
        super().__init__()
        self.nodes, self.cells = nodes, cells

    @property
    def getNumTrees(self) -> int:
        return len(self.nodes.roots)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(self.getFeaturesCol())
        return predicted(dataset, self.nodes, [F.get(x, F.lit(i)) for i in range(len(self.cells.cuts))])
