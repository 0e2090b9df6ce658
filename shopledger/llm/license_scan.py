"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined to the positions that grams have in
templates. A hit votes for its diagonal: its word offset in the text less that in the template.
Votes are summed per diagonal; neighbouring diagonals, which small insertions and deletions
leave, are merged; a span is verified by the share of the template's words that its hits confirm.

A phrase is a template of two-word grams whose diagonals are never merged and whose words must
all be there. Notices have four-word grams, and stand changed or missing words.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.llm.common import fixed, private


@dataclass(frozen=True)
class Template:
    """``text`` in lower-case words, in grams of ``k`` words. Diagonals at most ``slack`` apart are
    merged; a span is one with ``share`` of the words."""

    label: str
    text: str
    k: int = 4
    slack: int = 8
    share: float = 0.75


def phrase(label: str, text: str) -> Template:
    return Template(label, text, k=2, slack=0, share=1.0)


# Phrases and their labels.
BASE = (
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
)
# Opening words of well-known license notices.
NOTICES = (
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", share=1.0),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", share=1.0),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation",
    ),
    Template(
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as"
        " published by the free software foundation",
        share=0.9,
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http"
        " www apache org licenses license 2 0",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
TEMPLATES = BASE + NOTICES
SIZES = (2, 4)

_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, _APART), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Hashes of the two-word grams."""
    some = F.when(F.size(words) > 1, F.slice(words, 1, F.size(words) - 1)).otherwise(F.slice(words, 1, 0))
    return F.transform(some, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _fours(pairs: Column) -> Column:
    """Hashes of the four-word grams, each of two pairs."""
    some = F.when(F.size(pairs) > 2, F.slice(pairs, 1, F.size(pairs) - 2)).otherwise(F.slice(pairs, 1, 0))
    return F.transform(some, lambda h, i: F.xxhash64(h, F.get(pairs, i + 2)))


def grams(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``n_words``, and a row per gram: ``k``, its word offset ``at``, hash ``h``.

    A text without grams has one row without them.
    """
    df = fixed(df, keep, _w=_words(F.col(f"`{text}`")))
    df = fixed(df, [*keep, "_w"], _p=_pairs(F.col("_w")))
    df = fixed(df, keep, n_words=F.size("_w").cast("bigint"), _n=F.size("_p"), _h=F.concat("_p", _fours(F.col("_p"))))
    df = df.select(*[F.col(f"`{c}`") for c in keep], "n_words", "_n", F.posexplode_outer("_h").alias("_i", "h"))
    four = F.col("_i") >= F.col("_n")
    return df.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", F.when(four, 4).otherwise(2).alias("k"),
        F.when(four, F.col("_i") - F.col("_n")).otherwise(F.col("_i")).alias("at"), "h", F.col("_i").alias("nth"),
    )


def template_grams(spark, templates: Sequence[Template]) -> DataFrame:
    """A row per gram of every template; templates are code, so this table has a fixed size."""
    rows = [(i, t.k, t.label, len(t.text.split()), t.slack, t.share, t.text) for i, t in enumerate(templates)]
    df = spark.createDataFrame(rows, "tpl int, tk int, label string, size int, slack int, share double, text string")
    kept = ["tpl", "tk", "label", "size", "slack", "share"]
    df = grams(df, "text", kept).where(F.col("k") == F.col("tk"))
    return df.select(*kept, F.col("at").alias("t"), F.col("h").alias("th"))


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``keep``, ``n_words`` and ``spans`` of every row: the verified places of templates.

    A span has ``tpl`` (number of the template), ``label``, ``start`` and ``end`` (words, from 0, end
    exclusive) and ``coverage`` (share of the template's words), and spans go by start, end and
    template. Null and empty texts have no words and no spans; repeated rows are scanned each; an
    empty table gives no rows; texts are read whole, and columns outside ``keep`` are ignored.

    Grams meet the templates by a broadcast join, so only hits leave a task, and one exchange
    by row brings them to all later steps.
    """
    spark = docs.sparkSession
    row = private(docs, "row_number")
    body = private(docs, "body")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(body)).withColumn(row, F.monotonically_increasing_id())
    kept = [row, *keep]
    held = private(docs, "held")
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(held), F.col(f"`{body}`"))
    table = F.broadcast(template_grams(spark, templates))
    all_grams = grams(df, body, [held])
    joined = all_grams.join(table, (F.col("h") == F.col("th")) & (F.col("k") == F.col("tk")), "left")
    # Of the grams without a hit one stays, so that every row is returned.
    hits = joined.where(F.col("tpl").isNotNull() | F.coalesce(F.col("nth") == 0, F.lit(True)))
    hits = hits.select(F.col(f"`{held}`.`{row}`").alias("_r"), F.col(f"`{held}`").alias("_held"), "n_words", "tpl", "tk", "label", "size", "slack", "share", "at", "t")
    hits = hits.repartition("_r")
    of = ["_r", "_held", "n_words", "tpl", "tk", "label", "size", "slack", "share"]
    diagonals = hits.withColumn("diagonal", F.col("at") - F.col("t")).groupBy(*of, "diagonal").agg(
        F.collect_list("t").alias("ts"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    order = Window.partitionBy("_r", "tpl").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack"), F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int"))
    merged = merged.withColumn("cluster", F.sum("apart").over(order))
    merged = merged.groupBy(*of, "cluster").agg(
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min("first").alias("start"), F.max("last").alias("last")
    )
    seen = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.col("tk") - 1))))
    coverage = F.size(seen) / F.col("size")
    span = F.struct(
        F.col("start").cast("bigint").alias("start"), (F.col("last") + F.col("tk")).cast("bigint").alias("end"),
        "tpl", "label", coverage.alias("coverage"),
    )
    found = F.when(F.col("tpl").isNotNull() & (coverage >= F.col("share")), span)
    whole = merged.groupBy("_r", "_held", "n_words").agg(F.array_sort(F.collect_list(found)).alias("spans"))
    return whole.select(*[F.col(f"`_held`.`{c}`").alias(c) for c in keep], "n_words", "spans")


def op12(spark, sf_dir: str) -> DataFrame:
    """Licenses of every document. The score is the best coverage of a notice, or half for a phrase."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["tpl"] < len(BASE))
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    worth = F.transform("spans", lambda s: F.when(s["tpl"] < len(BASE), s["coverage"] / 2).otherwise(s["coverage"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(worth), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """The same in DuckDB SQL, with the words of the grams in place of their hashes."""
    rows = ",\n  ".join(f"({i}, '{t.label}', '{t.text}', {t.k}, {t.slack}, {t.share}::DOUBLE)" for i, t in enumerate(TEMPLATES))
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    gram = lambda of, k: " || ' ' || ".join(f"{of}[i + {j}]" for j in range(k))
    return rf"""
WITH tpl(tpl, label, text, k, slack, share) AS (VALUES
  {rows}),
tw AS (SELECT *, string_split(text, ' ') AS w FROM tpl),
tg AS (SELECT tpl, k, i - 1 AS t, CASE WHEN k = 2 THEN {gram("w", 2)} ELSE {gram("w", 4)} END AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tw)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w))) AS i FROM d),
dg AS (SELECT r, 2 AS k, i - 1 AS pos, {gram("w", 2)} AS g FROM p UNION ALL SELECT r, 4, i - 1, {gram("w", 4)} FROM p WHERE i + 3 <= len(w)),
h AS (SELECT r, tpl, t, pos, pos - t AS diagonal FROM dg JOIN tg USING (k, g)),
g AS (SELECT r, tpl, diagonal, list(t) AS ts, min(pos) AS a, max(pos) AS z FROM h GROUP BY ALL),
b AS (SELECT g.*, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, tpl ORDER BY diagonal) > slack, true) AS apart FROM g JOIN tpl USING (tpl)),
c AS (SELECT *, sum(apart::INT) OVER (PARTITION BY r, tpl ORDER BY diagonal) AS cluster FROM b),
m AS (SELECT r, tpl, cluster, flatten(list(ts)) AS ts, min(a) AS start FROM c GROUP BY ALL),
s AS (SELECT r, tpl, label, start, len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + tw.k))))) / len(tw.w) AS coverage, share FROM m JOIN tw USING (tpl)),
v AS (SELECT *, tpl < {len(BASE)} AS is_base FROM s WHERE coverage >= share)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (is_base) AS n_base, CAST(min(start) FILTER (is_base) AS BIGINT) AS first_word,
  CAST(max(start) FILTER (is_base) AS BIGINT) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(CASE WHEN is_base THEN coverage / 2 ELSE coverage END), 0.0::DOUBLE) AS score
FROM d LEFT JOIN v USING (r) GROUP BY r, doc_id, w
"""


ORACLE = _oracle()
