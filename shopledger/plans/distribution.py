"""Exact order statistics of grouped values, spread over the cluster.

A first pass takes a sketch of every group, which brackets each wanted rank: the sketch's rank
error is bounded, so the value of that rank lies in the bracket. A second pass counts the rows
below each bracket, and counts by value those inside; the wanted value follows from running
counts. Nothing near the size of the data is shuffled, sorted or written, and no group is ever
held in one task, which the built-in exact ``percentile`` would do: inside a bracket lie at
most ``8 / ACCURACY`` of a large group's rows, besides ties, which count as one.

The brackets are written for the second pass, one row per group, which keeps the rows where they
are. The found values are pinned, one row per group, and checked: a group with a rank outside its
bracket is counted anew by value, spread over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.plans.pinning import held, pin
from shopledger.plans.placement import place, running_sums

#: Rank error of the sketches as a share of the rows: 1 / ACCURACY.
ACCURACY = 50_000
#: Half widths of the brackets as shares of the rows. A group takes the narrowest one that is two
#: rows or more on either side; the last holds all rows of a group of less than a thousand.
MARGINS = (4 / ACCURACY, 100 / ACCURACY, 1.0)

#: Exponents of the bins of an exact sum: 60 bits each, so magnitudes from 2^-140 to 2^220.
BINS = (160, 100, 40, -20, -80, -140)

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def exact_sum(value: Column) -> Column:
    """Sum of doubles that is the same in any order of addition.

    A value is cut at fixed exponents into whole multiples of powers of two, which are added
    exactly; the six sums are joined at the end. What lies below 2^-140 is lost, and the sum is
    right to about 1e-15 of the sum of absolute values. Values of 2^220 or more, infinite ones and
    NaN are added as doubles.
    """
    inside = F.abs(value) < 2.0**220
    rest = F.abs(value)
    total = F.coalesce(F.sum(F.when(~inside | F.isnan(value), value)), F.lit(0.0))
    for e in BINS:
        part = F.floor(rest * 2.0**-e)
        signed = F.when(inside, part * F.when(value < 0, -1).otherwise(1))
        total = total + F.coalesce(F.sum(signed.cast("decimal(28,0)")).cast("double"), F.lit(0.0)) * 2.0**e
        rest = rest - part.cast("double") * 2.0**e
    return F.when(F.count(value) > 0, total)


def long_form(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row (by, measure, value) per measure of each row; nulls are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
            for m in measures
        ]
    )
    long = df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.measure", "p.value")
    return long.where(F.col("value").isNotNull())


class Distribution:
    """Values of each (``by``, measure) of a frame from :func:`long_form`.

    Results come back long: one row per (``by``, measure).
    """

    def __init__(self, long: DataFrame, by: Sequence[str] = ()):
        self.long, self.keys = long, [*by, "measure"]

    def _bracketed(self, probabilities: dict[str, float], *more: Column) -> DataFrame:
        """Rows per group, the ends of the bracket of each probability, and further aggregates."""
        wanted = list(probabilities.values())
        ends = [min(1.0, max(0.0, p + s * m)) for m in MARGINS for s in (-1, 1) for p in wanted]
        sketch = F.percentile_approx("value", ends, ACCURACY).alias("ends")
        return self.long.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_all"), sketch, *more)

    def _same(self, left: str, right: str) -> Column:
        pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in self.keys]
        return reduce(Column.__and__, pairs)

    def quantiles(
        self, probabilities: dict[str, float] | None = None, alpha: float = 1.0
    ) -> DataFrame:
        """Quantiles by interpolation between the two nearest ranks.

        ``alpha`` sets the plotting positions: 1 is plain linear interpolation, 0.4 the nearly
        unbiased positions (alphap = betap = 0.4) of the Cunnane rule.
        """
        probabilities = probabilities or QUARTILES
        return self._quantiles(self._bracketed(probabilities), probabilities, alpha)

    def _quantiles(
        self, groups: DataFrame, probabilities: dict[str, float], alpha: float = 1.0, keep: Sequence[str] = ()
    ) -> DataFrame:
        positions = [_position(p, alpha) for p in probabilities.values()]
        # With a written copy the planner sees how few groups there are, and broadcasts them: a join
        # dealt by group would put all rows of a group into one task.
        with held(groups, "brackets") as brackets:
            found = pin(self._ranked(brackets, dict(zip(probabilities, positions)), keep), "quantiles")
        return self._checked(found, dict(zip(probabilities, positions)))

    def _ranked(self, groups: DataFrame, positions: dict[str, str], keep: Sequence[str]) -> DataFrame:
        """The values at the positions, from the rows' places against the brackets of ``groups``."""
        count = len(positions)
        rows = self.long.alias("l").join(groups.select(*self.keys, "n_all", "ends").alias("g"), self._same("l", "g"))
        value = F.col("l.value")
        fits = [F.when(F.col("n_all") * m >= 2, F.lit(2 * count * k)) for k, m in enumerate(MARGINS[:-1])]
        first = F.coalesce(*fits, F.lit(2 * count * (len(MARGINS) - 1)))
        # Where a row stands to each bracket: below it (no value), inside, or above (nothing).
        places = [
            F.when(value < F.get("ends", first + i), F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v")))
            .when(value <= F.get("ends", first + count + i), F.struct(F.lit(i).alias("i"), value.alias("v")))
            for i in range(count)
        ]
        found = F.filter(F.array(*places), lambda p: p.isNotNull())
        parts = (
            rows.select(*[F.col(f"l.{k}") for k in self.keys], "n_all", F.inline(found))
            .groupBy(*self.keys, "n_all", "i", "v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        upward = Window.partitionBy(*self.keys, "i").orderBy(F.col("v").asc_nulls_first())
        ranked = parts.withColumn("n_upto", F.sum("n").over(upward))
        ranked = ranked.groupBy(*self.keys, "n_all").agg(
            *[_interpolated(at, i).alias(name) for i, (name, at) in enumerate(positions.items())]
        )
        if keep:
            joined = groups.alias("g").join(ranked.alias("r"), self._same("g", "r"))
            ranked = joined.select(*[f"g.{k}" for k in self.keys], *[f"g.{k}" for k in keep], *[f"r.{q}" for q in positions])
        else:
            ranked = ranked.drop("n_all")
        return ranked

    def _checked(self, found: DataFrame, positions: dict[str, str]) -> DataFrame:
        """``found``, with groups that lack a value counted anew.

        A value is missing where its rank lies outside the bracket. Such a group's rows are counted
        by value, and running counts over ranges of values find all its ranks.
        """
        lacking = reduce(Column.__or__, [F.col(name).isNull() for name in positions])
        missed = found.where(lacking)
        if missed.isEmpty():
            return found
        rows = self.long.alias("l").join(missed.alias("m"), self._same("l", "m"), "left_semi")
        counts = rows.groupBy(*self.keys, "value").agg(F.count(F.lit(1)).alias("n"))
        counts = running_sums(place(counts, [*self.keys, "value"], self.keys), self.keys, ["value"], ["n"])
        counts = counts.select(*self.keys, "n_all", F.lit(0).alias("i"), F.col("value").alias("v"), "n", "n_upto")
        again = counts.groupBy(*self.keys, "n_all").agg(*[_interpolated(at, 0).alias(name) for name, at in positions.items()])
        again = pin(again.drop("n_all"), "quantiles")
        mended = missed.drop(*positions).alias("m").join(again.alias("a"), self._same("m", "a"))
        return found.where(~lacking).unionByName(mended.select("m.*", *[f"a.{q}" for q in positions]))

    def describe(self) -> DataFrame:
        """count, total, mean, std (n-1), min, q1, median, q3, max.

        The total is that of :func:`exact_sum`, which does not depend on the order of addition.
        """
        total = exact_sum(F.col("value"))
        more = [
            F.count(F.lit(1)).alias("count"), total.alias("total"),
            (total / F.count(F.lit(1))).alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"),
        ]
        groups = self._bracketed(QUARTILES, *more)
        return self._quantiles(groups, QUARTILES, keep=["count", "total", "mean", "std", "min", "max"])

    def box(self) -> DataFrame:
        """Quartiles, whiskers at the extreme values inside 1.5 IQR, and outlier count."""
        fences = self.quantiles().withColumns(
            {
                "low_fence": F.expr("q1 - 1.5 * (q3 - q1)"),
                "high_fence": F.expr("q3 + 1.5 * (q3 - q1)"),
            }
        )
        inside = "value BETWEEN low_fence AND high_fence"
        joined = self.long.alias("l").join(fences.alias("f"), self._same("l", "f"))
        return (
            joined.select("l.*", *[f"f.{c}" for c in (*QUARTILES, "low_fence", "high_fence")])
            .groupBy(*self.keys, *QUARTILES)
            .agg(
                F.expr(f"min(value) FILTER (WHERE {inside}) AS low_whisker"),
                F.expr(f"max(value) FILTER (WHERE {inside}) AS high_whisker"),
                F.expr(f"count_if(NOT ({inside})) AS outliers"),
            )
        )


def _position(p: float, alpha: float) -> str:
    """0-based rank of a quantile, as SQL over ``n_all``."""
    if alpha == 1.0:
        return f"((n_all - 1) * {p}D)"
    shift = alpha + p * (1 - 2 * alpha) - 1
    return f"least(greatest(n_all * {p}D + {shift}D, 0D), double(n_all - 1))"


def _interpolated(position: str, i: int) -> Column:
    low, high = _value_at(f"floor({position})", i), _value_at(f"ceil({position})", i)
    return F.expr(f"{low} + ({high} - {low}) * ({position} - floor({position}))")


def _value_at(rank: str, i: int) -> str:
    """Value at a 0-based rank: the row of bracket i whose run of equal values covers it."""
    return f"max(v) FILTER (WHERE i = {i} AND n_upto - n <= {rank} AND {rank} < n_upto)"


def one_row_quantiles(
    df: DataFrame,
    measures: Sequence[str],
    probabilities: dict[str, float] | None = None,
    alpha: float = 1.0,
) -> DataFrame:
    """Ungrouped quantiles as one row with columns ``<measure>_<name>``."""
    probabilities = probabilities or QUARTILES
    rows = Distribution(long_form(df, measures)).quantiles(probabilities, alpha)
    return rows.agg(
        *[
            F.expr(f"max({q}) FILTER (WHERE measure = '{m}') AS {m}_{q}")
            for m in measures
            for q in probabilities
        ]
    )
