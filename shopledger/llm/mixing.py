"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

All words of the corpus are cut into blocks of ``block_tokens`` words, and the blocks are given
to the sources by the highest quotients ``target / (2 a + 1)``. A source's quota is divided the
same way among its shards (documents dealt out by a seeded hash). Inside a shard the documents
stand in seeded order on a circle; the mix takes the quota's blocks from a seeded block on, so
it goes round whole times and then takes one run. What a document gives follows from its place
on the circle: blocks are never materialised, and nothing but sums per source and shard meets in
one place.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopledger.llm.common import SPACE, words
from shopledger.plans.pinning import pin
from shopledger.plans.shipping import ship

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often than this.
MOST_TIMES = 3
BLOCK_TOKENS = 16
#: Shards hold about this many words, or a 65,536th of the corpus if that is more.
SHARD_TOKENS = 65_536
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """``source, source_size`` with ``total``, ``weight`` and ``target``; a null source stands last.

    Targets share all words by weight. A target stops at ``most`` times its source's size and the
    excess is shared again by weight. The sources that stop are those with the least
    ``source_size / weight``: going up that order, a source stops if its limit is below its share
    of what those before it have left. One row per source meets in each window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = F.row_number().over(order) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    df = sizes.select(
        "source", "source_size", F.sum("source_size").over(everything).alias("total"),
        F.get(cycle, (place % len(weights)).cast("int")).alias("weight"),
    )
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * most
    df = df.select(
        "*", limit.alias("limit"),
        (F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights"),
    )
    exact = lambda name: F.col(name).cast("decimal(19,0)")  # noqa: E731 - products beyond a bigint
    df = df.withColumn("stops", exact("limit") * exact("weights") <= exact("left") * exact("weight"))
    free = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    spent = F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))).over(everything), F.lit(0))
    share = (F.col("total") - spent).cast("double") * F.col("weight").cast("double") / free.cast("double")
    return df.select(
        "source", "source_size", "total", "weight",
        F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(share).alias("target"),
    )


def apportion(df: DataFrame, keys: Sequence[str], tie: Sequence[str], seats: str, claim: str, out: str) -> DataFrame:
    """Sainte-Laguë: ``df`` with ``out``, the seats of each row within its ``keys``.

    ``seats`` is the number to give within the keys, ``claim`` the weight of a row; ties go by
    ``tie``. Seats that a row certainly gets are given at once; the rest, no more than about two
    per row, go one by one to the highest quotients.
    """
    group = Window.partitionBy(*keys)
    sum_claim, rows = F.sum(claim).over(group), F.count(F.lit(1)).over(group)

    def rounded(offset: Column) -> Column:
        scaled = F.col(claim).cast("double") * (F.col(seats) + offset) / F.col("_claims")
        return F.when(F.col("_claims") > 0, F.floor(scaled + 0.5)).otherwise(F.lit(0)).cast("bigint")

    df = df.select("*", sum_claim.cast("double").alias("_claims"), rows.alias("_rows"))
    df = df.select(
        "*",
        F.greatest(F.lit(0), rounded(-F.col("_rows") / 2) - 1).alias("_low"),
        (rounded(F.col("_rows") / 2) + 1).alias("_high"),
    )
    df = df.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    bids = df.where(F.col(claim) > 0).select(
        *keys, *tie, "_open", F.col(claim).alias("_claim"),
        F.explode(F.sequence(F.col("_low"), F.greatest(F.col("_low"), F.col("_high") - 1))).alias("_a"),
    )
    quotient = F.col("_claim").cast("double") / (2 * F.col("_a") + 1)
    rank = F.row_number().over(group.orderBy(quotient.desc(), *[F.col(t).asc_nulls_last() for t in tie], "_a"))
    won = bids.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_open"))
    won = won.groupBy(*keys, *tie).agg(F.count(F.lit(1)).alias("_won"))
    a, b = df.alias("a"), won.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, *tie]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    kept = [c for c in df.columns if c not in {"_claims", "_rows", "_low", "_high", "_open"}]
    total = F.col("a._low") + F.coalesce(F.col("b._won"), F.lit(0))
    return a.join(b, condition, "left").select(*[F.col(f"a.{c}") for c in kept], total.alias(out))


def seeded(*parts: Column, seed: str) -> Column:
    """A number below 2^60 from the parts and the seed; equal in every engine that has md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _sized(docs: DataFrame, keep: Sequence[str], seed: str) -> DataFrame:
    """Per document its size, and its seeded places among the shards and within one."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select(
        F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept"),
        "source", F.size(words(F.col("text"))).cast("bigint").alias("size"),
        seeded(F.col("doc_id"), digest, seed=f"{seed}-order").alias("order"),
        seeded(F.col("doc_id"), digest, seed=f"{seed}-shard").alias("deal"),
    )


def mixture(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = WEIGHTS,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: str = SEED,
    carry: bool = False,
) -> DataFrame:
    """One row per document: ``keep``, ``source, size, source_size, target, taken`` and the runs.

    ``taken`` words are ``rounds`` whole texts, then the words [``from_1``, ``to_1``) and
    [``from_2``, ``to_2``). Null and empty texts have size 0 and give nothing; an empty table
    gives no rows; a table without words has targets 0. A null source is a source of its own,
    the last. Repeated rows are documents of their own. ``docs`` needs ``doc_id, source, text``;
    other columns are ignored unless kept, whatever their names.

    Sizes are written to the shared folder once, with the kept columns unless ``carry`` asks to
    bring those (whole texts, say) along from ``docs`` instead.
    """
    sized = _sized(docs, keep, seed)
    small = pin(sized.drop("kept") if carry else sized, "mix_sizes")
    by_source = source_targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    shard_words = F.greatest(F.lit(shard_tokens).cast("bigint"), F.ceil(F.col("total") / 65_536))
    by_source = by_source.select(
        "*",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("n_shards"),
        F.floor(F.col("total") / block_tokens).cast("bigint").alias("blocks"),
        F.lit(0).alias("all"),
    )
    by_source = apportion(by_source, ["all"], ["source"], "blocks", "target", "source_blocks")
    by_source = pin(by_source.drop("all"), "mix_sources")
    shard = (F.col("deal") % F.col("n_shards")).alias("shard")
    about = ["source_size", "target", "n_shards", "source_blocks"]
    shards = _join_source(small.select("source", "size", "deal"), by_source, about).select("*", shard)
    shards = shards.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks")
    )
    shards = apportion(shards, ["source"], ["shard"], "source_blocks", "shard_size", "quota")
    ring = F.greatest(F.lit(1), F.col("shard_size"))
    first_block = seeded(F.col("source"), F.col("shard"), seed=f"{seed}-block") % F.ceil(ring / block_tokens)
    # A shard of a source at its limit may be owed part of a block more than its limit.
    words_taken = F.least(F.col("quota") * block_tokens, F.col("shard_size") * MOST_TIMES)
    shards = shards.select(
        "source", "shard", "shard_size",
        (first_block * block_tokens).alias("begin"),
        F.floor(words_taken / ring).cast("bigint").alias("rounds"), (words_taken % ring).alias("rest"),
    )
    shards = pin(shards, "mix_shards")
    df = _join_source(sized if carry else small, by_source, about).select("*", shard)
    a, b = df.alias("a"), shards.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.shard") == F.col("b.shard"))
    df = a.join(b, same).select("a.*", "b.shard_size", "b.begin", "b.rounds", "b.rest")
    circle = Window.partitionBy("source", "shard").orderBy("order", "deal", "size")
    at = F.sum("size").over(circle.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    df = df.withColumn("at", at)

    def cut(position: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), position - F.col("at")))

    # The run [begin, begin + rest) on the circle, as it lies and as it goes on from the start.
    end = F.col("begin") + F.col("rest")
    df = df.select(
        "kept.*", "source", "size", "source_size", "target", "rounds",
        cut(F.col("begin")).alias("from_1"), cut(end).alias("to_1"),
        F.lit(0).cast("bigint").alias("from_2"), cut(end - F.col("shard_size")).alias("to_2"),
    )
    taken = F.col("rounds") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2") - F.col("from_2")
    return df.withColumn("taken", taken)


def _join_source(df: DataFrame, by_source: DataFrame, columns: Sequence[str]) -> DataFrame:
    a, b = df.alias("a"), by_source.alias("b")
    return a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.*", *[F.col(f"b.{c}") for c in columns]
    )


_WORD = re.compile(rf"[^{SPACE}]+")


def word_runs(text: str | None, rounds: int, runs: Sequence[tuple[int, int]]) -> list[str]:
    """``rounds`` times the text, then each non-empty run of words with the space between them."""
    wanted = [r for r in runs if r[0] < r[1]]
    out = [text or ""] * int(rounds)
    if wanted:
        spans = [m.span() for m in _WORD.finditer(text or "")]
        out += [(text or "")[spans[a][0] : spans[b - 1][1]] for a, b in wanted]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(
    text: pd.Series, rounds: pd.Series, a1: pd.Series, b1: pd.Series, a2: pd.Series, b2: pd.Series
) -> pd.Series:
    rows = zip(text, rounds, a1, b1, a2, b2, strict=True)
    return pd.Series([word_runs(t, n, [(i, j), (k, m)]) for t, n, i, j, k, m in rows], dtype=object)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole texts as often as they are taken, and
    each run of words beyond as a row of its own. ``n_chars``, if there, is that of the new text.
    Documents of which nothing is taken have no row."""
    ship(docs.sparkSession)
    fields = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_row")
    mix = mixture(docs.select("doc_id", "source", "text", row), ["_row"], carry=True, **options)
    texts = _pieces("_row.text", "rounds", "from_1", "to_1", "from_2", "to_2")
    mix = mix.where("taken > 0").select("_row", F.explode(texts).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return mix.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in fields])


def op2(spark, sf_dir: str) -> DataFrame:
    mix = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select(
        "doc_id", "size", "source_size", "target", "taken", "rounds", "from_1", "to_1", "from_2", "to_2"
    )


def _sql_seeded(seed: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _sql_apportion(table: str, keys: str, tie: str, seats: str, claim: str, out: str) -> str:
    """All quotients of every row, up to the seats to give; the highest win."""
    return f"""
    SELECT t.*, coalesce(q.n, 0) AS {out} FROM {table} t LEFT JOIN (
      SELECT _k, count(*) AS n FROM (
        SELECT _k, row_number() OVER (PARTITION BY {keys} ORDER BY CAST({claim} AS DOUBLE) / (2 * a + 1) DESC, {tie} NULLS LAST, a) AS place, seats
        FROM (SELECT row_number() OVER (ORDER BY {keys}, {tie} NULLS LAST) AS _k, {keys}, {tie}, {claim}, {seats} AS seats,
              unnest(range(0, CAST(ceil(CAST({claim} AS DOUBLE) * {seats} / greatest(sum({claim}) OVER (PARTITION BY {keys}), 1)) AS BIGINT) + count(*) OVER (PARTITION BY {keys}) + 1)) AS a
              FROM {table}) WHERE {claim} > 0)
      WHERE place <= seats GROUP BY _k) q ON q._k = t._k"""


def oracle() -> str:
    """The same mix in DuckDB SQL."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END"
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
    md5(coalesce(text, '')) AS digest FROM documents),
k AS (SELECT *, {_sql_seeded(SEED + "-order", "doc_id", "digest")} AS ord, {_sql_seeded(SEED + "-shard", "doc_id", "digest")} AS deal FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
s1 AS (SELECT source, source_size, CAST(sum(source_size) OVER () AS BIGINT) AS total, {weight} AS weight, {MOST_TIMES} * source_size AS lim FROM s0),
s2 AS (SELECT *, total - coalesce(sum(lim) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s1),
s3 AS (SELECT *, lim * weights <= remaining * weight AS stops FROM s2),
s4 AS (SELECT row_number() OVER (ORDER BY source NULLS LAST) AS _k, 0 AS one, source, source_size, total // {BLOCK_TOKENS} AS blocks,
    CASE WHEN stops THEN CAST(lim AS DOUBLE) ELSE CAST(total - coalesce(sum(lim) FILTER (stops) OVER (), 0) AS DOUBLE) * weight / sum(weight) FILTER (NOT stops) OVER () END AS target,
    greatest(1, CAST(ceil(source_size / greatest({SHARD_TOKENS}, ceil(total / 65536.0))) AS BIGINT)) AS n_shards FROM s3),
s5 AS ({_sql_apportion("s4", "one", "source", "blocks", "target", "source_blocks")}),
h0 AS (SELECT k.*, s5.source_size, s5.target, s5.source_blocks, deal % n_shards AS shard FROM k JOIN s5 ON k.source IS NOT DISTINCT FROM s5.source),
h1 AS (SELECT row_number() OVER (ORDER BY source, shard NULLS LAST) AS _k, source, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_blocks) AS source_blocks
    FROM h0 GROUP BY source, shard),
h2 AS ({_sql_apportion("h1", "source", "shard", "source_blocks", "shard_size", "quota")}),
h3 AS (SELECT source, shard, shard_size, greatest(1, shard_size) AS ring, least(quota * {BLOCK_TOKENS}, {MOST_TIMES} * shard_size) AS words FROM h2),
h4 AS (SELECT *, {_sql_seeded(SEED + "-block", "source", "shard")} % CAST(ceil(ring / {float(BLOCK_TOKENS)}) AS BIGINT) * {BLOCK_TOKENS} AS at0, words // ring AS rounds, words % ring AS rest FROM h3),
c AS (SELECT h0.*, h4.shard_size, at0, rounds, at0 + rest AS stop,
    sum(size) OVER (PARTITION BY h0.source, h0.shard ORDER BY ord, deal, size ROWS UNBOUNDED PRECEDING) - size AS place
    FROM h0 JOIN h4 ON h0.source IS NOT DISTINCT FROM h4.source AND h0.shard = h4.shard),
r AS (SELECT doc_id, size, source_size, target, rounds, greatest(0, least(size, at0 - place)) AS from_1, greatest(0, least(size, stop - place)) AS to_1,
    0 AS from_2, greatest(0, least(size, stop - shard_size - place)) AS to_2 FROM c)
SELECT doc_id, size, source_size, target, CAST(rounds * size + to_1 - from_1 + to_2 - from_2 AS BIGINT) AS taken, CAST(rounds AS BIGINT) AS rounds,
    CAST(from_1 AS BIGINT) AS from_1, CAST(to_1 AS BIGINT) AS to_1, CAST(from_2 AS BIGINT) AS from_2, CAST(to_2 AS BIGINT) AS to_2 FROM r
"""
