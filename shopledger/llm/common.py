"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a character class and as characters.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def fixed(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """``keep`` and the new columns, each computed exactly once per row.

    The generator keeps the optimizer from inlining an array into the body of a lambda, where
    it would be rebuilt for every element.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[F.col(f"`{k}`") for k in keep], F.inline(F.array(made)))


def words(text: Column) -> Column:
    """Words of a text: runs of anything but white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of one piece at a time stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def private(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
