"""Ranked lexical search, reversed: documents stream past an index of the items.

The items are the queries. An inverted index over their terms is broadcast; every task streams
its documents' term counts through it and keeps a bounded heap of the best documents for each
item; the heaps of all tasks are merged. Documents are never shuffled, sorted or joined. Items
are taken in blocks of bounded size, so the index and the heaps fit a worker whatever the
number of items; each block streams the documents once for counts and once for scores.

Scores are whole numbers (a BM25 in fixed point), so results do not depend on the order of
addition, on partitioning or on repeated tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from shopledger.llm.common import sliced
from shopledger.plans.shipping import ship

TOP = 20
#: Bounds of one block of items: their number (heaps) and characters (index).
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
#: Cells (document, item) scored at a time in a task, and (document, term, item) triples.
CELLS, TRIPLES = 1 << 20, 1 << 20
#: Heaps of an item are merged in so many parts first.
PARTS = 32

#: Separators (ASCII but for digits and letters) become blanks, A-Z become a-z; bytes of other
#: characters stay, so the pieces between blanks are the maximal matches of the term pattern.
_PLAIN = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower()
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats; none for null."""
    return text.translate(_PLAIN).split() if text else []


@dataclass
class ItemIndex:
    """Inverted index of a block of items: term ``t`` is in ``item[ptr[t]:ptr[t + 1]]``,
    ``times`` as often. ``weight`` and the totals come from the documents."""

    ids: list
    number: dict[bytes, int]
    ptr: np.ndarray
    item: np.ndarray
    times: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    documents: int = 0
    length: int = 0

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> ItemIndex:
        lists: dict[bytes, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(rows):
            for term, n in Counter(terms((text or "").encode())).items():
                lists.setdefault(term, []).append((i, n))
        flat = [p for postings in lists.values() for p in postings]
        ptr = np.cumsum([0, *map(len, lists.values())], dtype=np.int64)
        pairs = np.array(flat, np.int64).reshape(-1, 2)
        return cls([i for i, _ in rows], {t: k for k, t in enumerate(lists)}, ptr, pairs[:, 0].copy(), pairs[:, 1].copy())


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def _counted(shared):
    """Partial document counts of a task: (term, df); -1 counts documents, -2 their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get = index.number.get
        df = np.zeros(len(index.number) + 1, np.int64)  # the last cell takes all other terms
        other, documents, length = len(index.number), 0, 0
        for batch in sliced(batches):
            for text in _binary(batch, "text"):
                found = terms(text)
                if found:
                    documents, length = documents + 1, length + len(found)
                    known = {get(t, other) for t in set(found)}
                    df[np.fromiter(known, np.int64, len(known))] += 1
        (some,) = np.nonzero(df[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([documents, length, *df[some].tolist()], pa.int64())],
            names=["term", "n"],
        )

    return count


def _weighed(docs: DataFrame, index: ItemIndex) -> ItemIndex:
    """The index with document counts; at most its number of terms reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    counts = docs.select("text").mapInArrow(_counted(shared), "term bigint, n bigint")
    found = {r.term: r.total for r in counts.groupBy("term").agg(F.sum("n").alias("total")).collect()}
    index.documents, index.length = found.get(-1, 0), found.get(-2, 0)
    n = index.documents
    index.weight = np.array(
        [math.floor(1000 * math.log((2 * n + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(index.number))], np.int64
    )
    return index


def scores(index: ItemIndex, texts: list[bytes | None]) -> np.ndarray:
    """Score of every (text, item) pair."""
    out = np.zeros((len(texts), len(index.ids)), np.int64)
    get = index.number.get
    where, term, tf, lengths = [], [], [], np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        found = terms(text)
        lengths[d] = len(found)
        for t, n in Counter(found).items():
            k = get(t)
            if k is not None:
                where.append(d), term.append(k), tf.append(n)
    if not term:
        return out
    where, term, tf = (np.array(x, np.int64) for x in (where, term, tf))
    m = 100 - 25 + (25 * lengths * index.documents) // index.length
    value = index.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[where]))
    size = index.ptr[term + 1] - index.ptr[term]
    ends = np.cumsum(size)
    begin = 0
    while begin < len(term):  # so many terms at a time that their postings fit
        upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TRIPLES, "right")))
        n = size[begin:upto]
        first = np.repeat(index.ptr[term[begin:upto]] - (np.cumsum(n) - n), n)
        at = first + np.arange(len(first))
        np.add.at(
            out.reshape(-1), np.repeat(where[begin:upto], n) * len(index.ids) + index.item[at],
            np.repeat(value[begin:upto], n) * index.times[at],
        )
        begin = upto
    return out


def _searched(shared, top: int, names: list[str], id_type: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        items = len(index.ids)
        # Entries are (score, has an id, -id): the least one is the first to go.
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        floor = np.ones(items, np.int64)
        for batch in sliced(batches, max(1, min(256, CELLS // max(1, items)))):
            found = scores(index, _binary(batch, "text"))
            ids = batch.column("doc_id").to_pylist()
            for d, i in zip(*(x.tolist() for x in np.nonzero(found >= floor))):
                entry = (int(found[d, i]), ids[d] is not None, -(ids[d] or 0))
                if len(heaps[i]) < top:
                    heapq.heappush(heaps[i], entry)
                elif entry > heaps[i][0]:
                    heapq.heapreplace(heaps[i], entry)
                if len(heaps[i]) == top:
                    floor[i] = heaps[i][0][0]
        for i in range(0, items, 1000):
            rows = [(k, *e) for k in range(i, min(i + 1000, items)) for e in heaps[k]]
            columns = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([index.ids[r[0]] for r in rows], id_type),
                pa.array([-r[3] if r[2] else None for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return search


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The ``top`` highest-scoring documents of every item: item_id, rank, doc_id, score.

    ``docs`` has ``doc_id`` (a whole number) and ``text``; ``items`` has ``item_id`` (a whole number or a
    string) and ``text``;
    other columns are ignored, whatever their names. Null and empty texts have no terms: such
    documents count nowhere and such items find nothing. Scores of 0 are left out. Equal scores
    go by ascending ``doc_id``, a null id last. Every row is a document and an item of its own,
    so repeated documents can each be found and a repeated item repeats its result. Empty tables
    give no rows. Long texts are read whole.

    Building the search runs jobs that count the terms of the items in all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = isinstance(items.schema["item_id"].dataType, StringType)
    items = items.select(F.col("item_id").cast("string" if named else "bigint").alias("item_id"), "text")
    of_items = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(of_items.n / block_items), math.ceil(of_items.chars / block_chars))
    schema = StructType().add("_item", LongType()).add("item_id", StringType() if named else LongType()).add("doc_id", LongType()).add("score", LongType())
    id_type = pa.string() if named else pa.int64()
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for block in range(blocks):
        rows = items.where(block_of == block).orderBy("item_id", "text").collect()
        index = _weighed(docs, ItemIndex.of([tuple(r) for r in rows]))
        shared = spark.sparkContext.broadcast(index)
        found = docs.mapInArrow(_searched(shared, top, schema.names, id_type), schema)
        found = found.withColumn("_block", F.lit(block))
        out = found if out is None else out.unionByName(found)
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    one = ["_block", "_item"]
    for parts in ([*one, F.pmod(F.spark_partition_id(), F.lit(PARTS))], one):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*best))).where(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    """The best documents of every ``benchmark`` item."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return search(read("documents"), read("benchmark"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
v AS (SELECT r, doc_id, t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))) AS v FROM tf JOIN df USING (t), totals),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM q JOIN v USING (t) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
