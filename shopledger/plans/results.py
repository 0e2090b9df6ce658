"""One declared shape per registered query, applied alike to Spark results and to oracle SQL.

A shape lists ``column:kind``. Kinds: ``i`` whole number, ``s`` text, ``b`` boolean, ``t``
timestamp, ``m`` month, and a digit count for a double rounded to it. Both sides round half to
even by the same arithmetic, which stays in doubles and so has no greatest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(shape: str) -> dict[str, str]:
    return dict(item.strip().split(":") for item in shape.split(","))


def shaped(df: DataFrame, shape: str) -> DataFrame:
    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.isdigit():
            scale = F.lit(float(10 ** int(kind)))
            c = F.rint(c.cast("double") * scale) / scale
        elif kind in "is":
            c = c.cast({"i": "bigint", "s": "string"}[kind])
        elif kind == "m":
            c = F.date_format(c, "yyyy-MM")
        return c.alias(name)

    return df.select(*[cell(n, k) for n, k in parse(shape).items()])


def shaped_sql(sql: str, ctes: dict[str, str], shape: str) -> str:
    """``sql`` under the shape, preceded by the common tables it needs."""

    def cell(name: str, kind: str) -> str:
        if kind.isdigit():
            scale = f"CAST({10 ** int(kind)} AS DOUBLE)"
            return f"round_even(CAST({name} AS DOUBLE) * {scale}, 0) / {scale} AS {name}"
        if kind in "is":
            return f"CAST({name} AS {'BIGINT' if kind == 'i' else 'VARCHAR'}) AS {name}"
        if kind == "m":
            return f"strftime({name}, '%Y-%m') AS {name}"
        return name

    cells = ", ".join(cell(n, k) for n, k in parse(shape).items())
    tables = ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())
    head = f"WITH {tables}\n" if tables else ""
    return f"{head}SELECT {cells} FROM ({sql}) AS result"
