"""Small fixtures of the training-data tests."""

from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
#: Null, empty, blank, repeated, tied and very long rows.
EDGES = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7),
    (4, "one two three four five six seven", "en", "b", 33),
    (4, "one two three four five six seven", "en", "b", 33),
    (5, "One TWO three four five six seven", "de", "b", 33),
    (6, LONG, "en", "a", len(LONG)),
    (None, "no id here at all", None, None, None),
    (7, "Grüße aus Köln 😀 é́ ﬁ <|endoftext|>", "de", "c", None),
]


def documents(spark, rows=EDGES):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The frame with further columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["kept", "_w", "ids", "spans", "size", "cls", "features", "_row", "h", "row", "pos", "target", "digest", "_text", "_id", "_d", "_of"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def by_id(df) -> dict[object, Row]:
    return {r["doc_id"]: r for r in df.collect()}
