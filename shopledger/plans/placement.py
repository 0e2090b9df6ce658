"""Running sums over a global order without a one-task window.

Rows are range-partitioned on (group, order) and keep the number of their range. A running sum
is then the sum of all earlier ranges of the group plus a window inside (group, range), so a
group that holds most of the rows is spread over many tasks like any other. The rows are pinned
in buckets of (group, range), so all that follows reads them in place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopledger.plans.pinning import pin, pin_bucketed

RANGE, SLOT = "_range", "_slot"
#: Rows of a range: as many as one task sorts in memory; and as few as are worth a task.
RANGE_ROWS, TASK_ROWS = 1_000_000, 10_000
#: Ranges are dealt to as many buckets by hash, so some share one (up to six of a thousand), and one task
#: sorts a bucket: placed ranges are smaller than what a task sorts by this factor.
SHARED = 4


def ranges_for(rows: int, cores: int, most: int = RANGE_ROWS) -> int:
    """Number of ranges: enough for ``most`` rows in each, and for all cores if rows are many."""
    return max(1, math.ceil(rows / most), min(cores, math.ceil(rows / TASK_ROWS)))


def place(df: DataFrame, keys: Sequence[str], group: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Range-partition on ``keys``, which begin with ``group``, and pin the range of each row.

    The number of ranges follows the number of rows unless given; their bounds are drawn from a
    sample of the keys, so ranges hold about the same number of rows. Bounds are drawn anew per
    plan, hence the pinned copy: all consumers in :func:`running_sums` must see the same ones.
    ``_slot`` is a hash of (group, range) and never null.
    """
    held = pin(df, "to_place")
    cores = df.sparkSession.sparkContext.defaultParallelism
    ranges = ranges or ranges_for(held.count(), cores, RANGE_ROWS // SHARED)
    placed = held.repartitionByRange(ranges, *keys).withColumn(RANGE, F.spark_partition_id())
    placed = placed.withColumn(SLOT, F.xxhash64(*group, RANGE))
    return pin_bucketed(placed, "placed", ranges, [SLOT], [SLOT, *keys])


def with_offsets(
    placed: DataFrame, group: Sequence[str], running: Sequence[str], totals: Sequence[str] = ()
) -> DataFrame:
    """Add ``<c>_all``, the sum over the group, and ``<c>_before``, that of its earlier ranges."""
    return attach(placed, group, offsets(placed, group, running, totals))


def offsets(
    placed: DataFrame, group: Sequence[str], running: Sequence[str], totals: Sequence[str] = ()
) -> DataFrame:
    """One row per (group, range), at most groups + ranges of them, with ``<c>_here``,
    ``<c>_before`` and ``<c>_all``."""
    summed = [*running, *totals]
    per_range = placed.groupBy(SLOT, *group, RANGE).agg(*[F.sum(c).alias(f"{c}_here") for c in summed])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = {
        f"{c}_before": F.coalesce(F.sum(f"{c}_here").over(earlier), F.lit(0)) for c in running
    }
    return per_range.withColumns(
        {**before, **{f"{c}_all": F.sum(f"{c}_here").over(whole) for c in summed}}
    )


def attach(placed: DataFrame, group: Sequence[str], per_range: DataFrame) -> DataFrame:
    """Join rows to the frame of their (group, range); such pairs are as even as the ranges.

    The slot alone is the key of the join, so only the small side moves; the other columns, which
    tell equal hashes apart, are compared in a form that is no further key.
    """
    keys = [SLOT, *group, RANGE]
    side = per_range.withColumnsRenamed({c: f"_side_{c}" for c in keys})
    same = F.col(SLOT) == F.col(f"_side_{SLOT}")
    for c in keys[1:]:
        a, b = F.col(c), F.col(f"_side_{c}")
        same = same & F.coalesce((a <= b) & (a >= b), a.isNull() & b.isNull())
    return placed.join(side, same).drop(*[f"_side_{c}" for c in keys])


def running_sums(
    placed: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    running: Sequence[str],
    totals: Sequence[str] = (),
) -> DataFrame:
    """Add ``<c>_upto`` (running, ties share a value) and ``<c>_all`` (whole group).

    ``placed`` comes from :func:`place` with keys ``[*group, *order]`` and this ``group``; rows equal
    in all keys lie in one range.
    """
    return add_running(with_offsets(placed, group, running, totals), group, order, running)


def add_running(
    df: DataFrame, group: Sequence[str], order: Sequence[str], running: Sequence[str]
) -> DataFrame:
    """Add ``<c>_upto`` to rows with offsets; ranges must be whole."""
    inside = (
        Window.partitionBy(SLOT, *group, RANGE)
        .orderBy(*order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns(
        {f"{c}_upto": F.sum(c).over(inside) + F.col(f"{c}_before") for c in running}
    )
