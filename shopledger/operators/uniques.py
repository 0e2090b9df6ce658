"""Exact distinct counts that can be stored by period and added up over any of them.

Keys are numbered once. What a period has seen of a key column is a set of bitmaps over these
numbers, a few kilobytes for every 32,768 keys; the distinct count of several periods is the
count of bits of their union. So a stored row per period answers for any span of periods
without the lines, which a stored count cannot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.plans.pinning import pin
from shopledger.plans.rows import with_row

#: Keys in one bitmap, which is as many bits as the built-in bitmap aggregates hold.
BITMAP = 32_768


def numbered(lines: DataFrame, column: str) -> DataFrame:
    """The distinct keys of a column, each with its ``number`` from 0; null is no key.

    Every partition counts its own keys and the partitions take turns, so numbers have few gaps
    and no row waits for another partition. The copy is pinned: a number never changes.
    """
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keys = lines.select(column).where(F.col(column).isNotNull()).distinct()
    held = pin(keys.select(column, F.spark_partition_id().alias("_part"), index.alias("_at")), "keys")
    turns = held.agg((F.max("_part") + 1).alias("n"))
    number = F.col("_at") * F.col("_turns")["n"] + F.col("_part")
    return with_row(held, turns, "_turns").select(column, number.alias("number"))


def period_bitmaps(lines: DataFrame, columns: Sequence[str], period: Column) -> DataFrame:
    """``period``, ``measure``, ``block``, ``bits``: the keys of each column seen in each period.

    Lines are reduced to distinct (period, key) pairs before they meet the numbers.
    """

    def one(column: str) -> DataFrame:
        pairs = lines.select(period.alias("period"), F.col(column)).where(F.col(column).isNotNull()).distinct()
        seen = pairs.join(numbered(lines, column), column)
        block = F.floor(F.col("number") / BITMAP).cast("bigint").alias("block")
        bits = F.bitmap_construct_agg(F.col("number") % BITMAP).alias("bits")
        return seen.groupBy("period", F.lit(column).alias("measure"), block).agg(bits)

    return reduce(DataFrame.unionByName, map(one, columns))


def united(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct keys per measure, and per ``by`` (columns derived from the period): ``n``."""
    whole = bitmaps.groupBy(*by, "measure", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*by, "measure").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def unique_counts(bitmaps: DataFrame) -> DataFrame:
    """Distinct keys of every month, of every year, and of all months, from monthly bitmaps.

    ``span`` is the month, the year or ``all``.
    """
    month, year = F.date_format("period", "yyyy-MM"), F.date_format("period", "yyyy")
    spans = [united(bitmaps.withColumn("span", s), ["span"]) for s in (month, year, F.lit("all"))]
    return reduce(DataFrame.unionByName, spans).select("span", "measure", "n")
