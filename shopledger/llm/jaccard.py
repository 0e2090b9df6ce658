"""N-gram Jaccard join by vertical partitioning, and the groups it links.

A document is the set of its distinct word n-grams, as 64-bit hashes. Equal sets form one class,
and only classes are compared. Linked sets differ in at most ``d = (|x|+|y|)(100-p)/(100+p)``
n-grams; everything follows from that.

* Who can have a partner at all: the hash order is cut into more than d fragments, so a linked
  pair has an equal, non-empty segment in one of them, and as many more as it has fragments
  beyond d. Classes that share fewer segments with others are done.
* Candidates among the rest: their sets are cut vertically into fragments, every fragment counts
  how often its n-grams occur, and the global n-gram order goes by that count, rarest first.
  The first n-grams of two linked sets have one in common. A set with rare n-grams of its own
  therefore never meets those that merely share a frequent passage with it.
* Verification: overlaps are counted fragment by fragment and summed per pair.

In every list of classes with a common n-gram, all are first compared with one leader; those it
links are one component and need no more pairs among them. After ``star_rounds`` such rounds all
pairs between different components are compared. So a group of near copies costs a few
comparisons each, not all pairs, and no link between components is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.llm.common import private, sliced
from shopledger.plans.pinning import pin
from shopledger.plans.shipping import ship

WORDS, PERCENT = 3, 90
#: N-grams in a fragment of all sets, and bits of the bitmap of classes whose sets are needed.
FRAGMENT_GRAMS, BITMAP_BITS = 2_000_000, 1 << 23
_BLOCK = 32_768
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, A-Z lower-cased; of a shorter text, its
    whole word sequence; nothing without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    total = h[: len(h) - n + 1]
    for i in range(1, n):
        total = _mixed(total) + _turned(h[i : len(h) - n + 1 + i], 17 * i % 63 + 1)
    return np.unique(_mixed(total))


@functools.cache
def bands(percent: int) -> tuple[list[int], list[int]]:
    """Least size of each size band, and the greatest number of differing n-grams if the larger
    set of a pair lies in it. Linked sets lie in one band or in neighbouring ones."""
    least, differ = [1], []
    while least[-1] < 1 << 40:
        after = max(least[-1] + 1, least[-1] * 100 // percent + 1)
        differ.append(2 * (after - 1) * (100 - percent) // (100 + percent))
        least.append(after)
    return least, differ


def segment_keys(found: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Keys of the set's segments, in the scheme of its own band and of the next, and how many of
    them a linked set has at least: all non-empty segments but those with a differing n-gram.

    In each scheme a set with too few non-empty segments also gives the hashes at the start of
    the order, enough to hold a common one with any set it is linked to.
    """
    least, differ = bands(percent)
    own = int(np.searchsorted(least, len(found), "right")) - 1
    out = []
    for band in (own, own + 1):
        d = differ[band]
        if d == 0:
            continue  # sets that may not differ are one class
        n = d + 2 + d // 8
        starts = np.searchsorted(found >> _U(32), (np.arange(n, dtype=np.uint64) << _U(32)) // _U(n))
        ends = np.append(starts[1:], len(found))
        filled = np.flatnonzero(ends > starts)
        sums = np.add.reduceat(_mixed(found), starts[filled])
        keys = _mixed(sums ^ _mixed(filled.astype(np.uint64) + (_U(band) << _U(40))))
        if len(filled) <= d:
            keys = np.append(keys, _mixed(found[: d + 1] ^ _mixed(np.array([band + (1 << 63)], np.uint64))))
        out.append((keys, max(1, len(filled) - d)))
    return out


def _bit(cls: bytes) -> int:
    return int.from_bytes(cls[:4], "big") % BITMAP_BITS


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    for i, text in enumerate(batch.column("text").to_pylist()):
        found = shingles(text, n)
        yield i, xxhash.xxh3_128_digest(found.tobytes()), found


def described(docs: DataFrame, keep: Sequence[str], n: int) -> DataFrame:
    """``kept``, the size of each set, and its class: a digest of the whole set."""
    kept = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept")
    df = docs.select(kept, "text")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(len(s), c) for _, c, s in _sets(batch, n)]
            size, cls = zip(*made, strict=True) if made else ((), ())
            yield pa.record_batch(
                [batch.column("kept"), pa.array(size, pa.int64()), pa.array(cls, pa.binary())],
                ["kept", "n_shingles", "cls"],
            )

    schema = f"kept {df.schema['kept'].dataType.simpleString()}, n_shingles bigint, cls binary"
    return df.mapInArrow(rows, schema)


def beyond_two(keys: np.ndarray) -> np.ndarray:
    """Which places hold a key that two earlier places hold already."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    new = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    earlier = np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))
    out = np.empty(len(keys), bool)
    out[order] = earlier >= 2
    return out


def _meeting(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(cls, size) of the classes that share as many segments with others as a link asks for.

    Of a key's classes in one batch two are enough to tell that it is shared; the rows of the
    others are sure and go where a key of their own sends them, so no task gets a frequent key whole.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a class gives its keys once per task
        for batch in sliced(batches, 1000):
            keys, classes, sizes, needs = [], [], [], []
            for _, cls, found in _sets(batch, n):
                if len(found) == 0 or cls in seen:
                    continue
                seen.add(cls)
                for i, (k, need) in enumerate(segment_keys(found, percent)):
                    keys.append(k)
                    classes += [cls] * len(k)
                    sizes += [len(found)] * len(k)
                    needs += [2 * need + i] * len(k)
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            sure = beyond_two(flat)
            flat = np.where(sure, _mixed(flat ^ _mixed(np.arange(len(flat), dtype=np.uint64))), flat)
            columns = [pa.array(flat.view(np.int64)), pa.array(classes, pa.binary())]
            columns += [pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.array(sure)]
            yield pa.record_batch(columns, ["key", "cls", "size", "need", "sure"])

    df = docs.select("text").mapInArrow(rows, "key bigint, cls binary, size int, need int, sure boolean")
    whole = Window.partitionBy("key")
    df = df.select("*", F.min("cls").over(whole).alias("_a"), F.max("cls").over(whole).alias("_z"))
    shared = df.where("sure OR _a <> _z").groupBy("cls", "size", "need").agg(F.count(F.lit(1)).alias("n"))
    return shared.where("n >= need div 2").select("cls", "size").distinct()


def _needed(classes: DataFrame) -> bytes:
    """Bits of the classes, 1 MB at most."""
    word = F.conv(F.hex(F.substring("cls", 1, 4)), 16, 10).cast("bigint")
    bit = (word % BITMAP_BITS).cast("int")
    blocks = classes.select(bit.alias("bit")).groupBy(F.expr(f"bit div {_BLOCK}").cast("int").alias("block"))
    rows = blocks.agg(F.bitmap_construct_agg(F.col("bit") % _BLOCK).alias("bits")).collect()
    out = bytearray(BITMAP_BITS // 8)
    for row in rows:
        at = row["block"] * _BLOCK // 8
        out[at : at + len(row["bits"])] = row["bits"]
    return bytes(out)


def _segments(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(id, size, fragment, grams) of the classes; the order is cut so that a fragment of all sets
    has about ``FRAGMENT_GRAMS`` n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(_needed(classes))
    grams = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    fragments = max(8, -(-grams // FRAGMENT_GRAMS))
    cuts = np.array([(i << 64) // fragments for i in range(1, fragments)], np.uint64)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        bits = sent.value
        for batch in sliced(batches, 1000):
            names, numbers, parts = [], [], []
            for _, cls, found in _sets(batch, n):
                bit = _bit(cls)
                if not bits[bit >> 3] >> (bit & 7) & 1 or cls in seen:
                    continue
                seen.add(cls)
                at = np.searchsorted(cuts, found, "right")
                filled = np.unique(at)
                for i, part in zip(filled, np.split(found, np.searchsorted(at, filled[1:])), strict=True):
                    names.append(cls)
                    numbers.append(int(i))
                    parts.append(part.view(np.int64))
            yield pa.record_batch(
                [pa.array(names, pa.binary()), pa.array(numbers, pa.int32()), _lists_of(parts, np.int64)],
                ["cls", "fragment", "grams"],
            )

    df = docs.select("text").mapInArrow(rows, "cls binary, fragment int, grams array<bigint>")
    # A class met in several tasks is told by each of them.
    return df.join(classes, "cls").groupBy("cls", "id", "size", "fragment").agg(F.any_value("grams").alias("grams")).drop("cls")


def _lists_of(parts: Sequence[np.ndarray], kind: type) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the length of each list."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = whole.value_lengths().to_numpy(zero_copy_only=False)
    return whole.flatten().to_numpy(zero_copy_only=False), lengths


def _counted(table: pa.Table) -> pa.Table:
    """One fragment of all sets: each n-gram with the number of sets it is in."""
    grams, lengths = _flat(table.column("grams"))
    _, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
    bounds = np.cumsum(lengths)[:-1]
    counted = np.split(counts[place].astype(np.int64), bounds)
    columns = [table.column("id"), table.column("size"), table.column("grams"), _lists_of(counted, np.int64)]
    return pa.table(columns, ["id", "size", "grams", "counts"])


def _part_counted(table: pa.Table) -> pa.Table:
    """One part of a heavy fragment: each n-gram once, with the number of the part's sets it is in."""
    grams, counts = np.unique(_flat(table.column("grams"))[0], return_counts=True)
    place = [pa.array(np.full(len(grams), table.column(c)[0].as_py(), np.int32)) for c in ("fragment", "salt")]
    return pa.table([*place, pa.array(grams), pa.array(counts.astype(np.int64))], ["fragment", "salt", "gram", "n"])


def _looked_up(sets: pa.Table, counts: pa.Table) -> pa.Table:
    """The sets of one part, each n-gram with its count in the whole fragment."""
    grams, lengths = _flat(sets.column("grams"))
    known, n = (counts.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(known)
    found = n[order][np.searchsorted(known[order], grams)]
    found = np.split(found.astype(np.int64), np.cumsum(lengths)[:-1])
    columns = [sets.column("id"), sets.column("size"), sets.column("grams"), _lists_of(found, np.int64)]
    return pa.table(columns, ["id", "size", "grams", "counts"])


_COUNTED = "id bigint, size int, grams array<bigint>, counts array<bigint>"


def with_counts(segments: DataFrame, most: int = 2 * FRAGMENT_GRAMS) -> DataFrame:
    """The segments, each n-gram with the number of sets it is in.

    A fragment of more than ``most`` n-grams, as one with an n-gram of very many sets, is dealt
    over parts by set; the parts' counts, one row per n-gram and part, are summed.
    """
    heavy = segments.groupBy("fragment").agg(F.sum(F.size("grams")).alias("n")).where(F.col("n") > most)
    heavy = pin(heavy.select("fragment", F.ceil(F.col("n") * 2 / most).cast("int").alias("parts")), "jaccard_heavy")
    if heavy.isEmpty():
        return segments.groupBy("fragment").applyInArrow(_counted, _COUNTED)
    light = segments.join(F.broadcast(heavy), "fragment", "left_anti").groupBy("fragment").applyInArrow(_counted, _COUNTED)
    salt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = segments.join(F.broadcast(heavy), "fragment").withColumn("salt", salt).drop("parts")
    counts = dealt.groupBy("fragment", "salt").applyInArrow(_part_counted, "fragment int, salt int, gram bigint, n bigint")
    counts = counts.withColumn("n", F.sum("n").over(Window.partitionBy("gram")))
    both = dealt.groupBy("fragment", "salt").cogroup(counts.groupBy("fragment", "salt"))
    return light.unionByName(both.applyInArrow(_looked_up, _COUNTED))


def differing(size_a: int, size_b: int, percent: int) -> int:
    """The most n-grams in which two linked sets of these sizes differ."""
    return (size_a + size_b) * (100 - percent) // (100 + percent)


def prefix_lengths(size: int, percent: int) -> tuple[int, int]:
    """How many first n-grams a set shows as the smaller and as the larger one of a pair.

    The smaller one has at most half of the differing n-grams; the larger one also those by
    which it is larger.
    """
    smaller = differing(size, size * 100 // percent, percent) // 2 + 1
    return min(size, smaller), size - (size * percent + 99) // 100 + 1


def _prefixes(segments: DataFrame, percent: int) -> DataFrame:
    """(key, id, size, pos): the first n-grams of every set in the global order, rarest first.

    Only those of two sets or more; the rows of a key beyond two of a batch are counted apart.
    """
    whole = with_counts(segments).groupBy("id", "size").agg(
        F.flatten(F.collect_list("grams")).alias("grams"), F.flatten(F.collect_list("counts")).alias("counts")
    )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, sizes, places = [], [], [], []
            grams, lengths = _flat(batch.column("grams"))
            counts, _ = _flat(batch.column("counts"))
            start = 0
            for i, size, length in zip(
                batch.column("id").to_pylist(), batch.column("size").to_pylist(), lengths.tolist(), strict=True
            ):
                g, c = grams[start : start + length], counts[start : start + length]
                start += length
                n = max(prefix_lengths(size, percent))
                first = np.lexsort((g, c))[:n]
                keys.append(g[first])
                ids.append(np.full(len(first), i, np.int64))
                sizes.append(np.full(len(first), size, np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            kinds = (np.int64, np.int64, np.int32, np.int32)
            columns = [
                np.concatenate(c) if c else np.empty(0, k)
                for c, k in zip((keys, ids, sizes, places), kinds, strict=True)
            ]
            columns.append(np.where(beyond_two(columns[0]), columns[1] + 1, 0))
            yield pa.record_batch([*map(pa.array, columns)], ["key", "id", "size", "pos", "apart"])

    df = whole.mapInArrow(rows, "key bigint, id bigint, size int, pos int, apart bigint")
    lists = Window.partitionBy("key", "apart")
    df = df.withColumn("_n", F.count(F.lit(1)).over(lists))
    return df.where("_n > 1 OR apart > 0").drop("_n", "apart")


def verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, sizes) that are linked: partial overlaps per fragment, summed."""
    one = segments.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("x"))
    two = segments.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("y"))
    partial = pairs.join(one, "a").join(two, ["b", "fragment"])
    partial = partial.select("a", "b", "sizes", F.size(F.array_intersect("x", "y")).alias("common"))
    total = partial.groupBy("a", "b", "sizes").agg(F.sum("common").alias("common"))
    union = F.col("sizes") - F.col("common")
    return total.where(F.col("common") * 100 >= union * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b); a component is named by its least node.

    Every node takes the least name among its own and its neighbours', then the name its name
    has, until nothing changes; the second step halves the way left.
    """
    both = pin(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    names = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    names = pin(names.select("node", F.least("node", "least").alias("name")), "names")
    while True:
        named = names.select(F.col("node").alias("b"), F.col("name").alias("heard"))
        heard = both.join(named, "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
        after = names.join(heard, "node").select("node", "name", F.least("name", "heard").alias("new"))
        jump = names.select(F.col("node").alias("new"), F.col("name").alias("next"))
        after = after.join(jump, "new").select("node", "name", F.least("new", "next").alias("new"))
        after = pin(after, "names")
        changed = after.where("name <> new").limit(1).count()
        names = after.select("node", F.col("new").alias("name"))
        if not changed:
            return names.select("node", F.col("name").alias("component"))


def _may_link(percent: int) -> Column:
    """Whether this meeting of x and y (``size_x``, ``pos_x`` and so on) can belong to a link.

    The n-grams before the first common one are not common. So a set that has more of them than
    it may have alone is not linked, or else met the other at an earlier n-gram.
    """
    x, y = F.col("size_x"), F.col("size_y")
    differ = F.floor((x + y) * (100 - percent) / (100 + percent))
    near = F.least(x, y) * 100 >= F.greatest(x, y) * percent
    alone_x, alone_y = F.floor((differ + x - y) / 2), F.floor((differ + y - x) / 2)
    return near & (F.col("pos_x") <= alone_x) & (F.col("pos_y") <= alone_y)


def linked_classes(docs: DataFrame, n: int, percent: int, star_rounds: int) -> DataFrame | None:
    """(cls, component) of the classes linked to another; None if none is."""
    classes = pin(_meeting(docs, n, percent).withColumn("id", F.monotonically_increasing_id()), "jaccard_classes")
    if classes.isEmpty():
        return None
    segments = pin(_segments(docs, classes, n), "jaccard_segments")
    lists = pin(_prefixes(segments, percent), "jaccard_lists")
    tested = links = found = None
    for turn in range(star_rounds + 1):
        members = lists.withColumn("component", F.col("id"))
        if found is not None:
            members = lists.join(found.withColumnRenamed("node", "id"), "id", "left")
            members = members.withColumn("component", F.coalesce("component", "id"))
        fields = ("id", "size", "pos", "component")
        # The leader is another one in every round: first the one that shows the n-gram first.
        rank = F.col("pos") / F.col("size") if turn == 0 else F.xxhash64("id", F.lit(turn))
        keys = members.groupBy("key").agg(
            F.min("component").alias("_a"), F.max("component").alias("_z"),
            F.min(F.struct(rank.alias("rank"), *fields)).alias("first"),
        )
        keys = pin(keys.where("_a <> _z").select("key", *[F.col(f"first.{c}").alias(f"{c}_y") for c in fields]), "jaccard_keys")
        if keys.isEmpty():
            break
        if turn < star_rounds:
            pairs = members.select("key", *[F.col(c).alias(f"{c}_x") for c in fields]).join(keys, "key")
            pairs = pairs.where(F.col("component_x") != F.col("component_y"))
        else:
            members = pin(members.join(keys.select("key"), "key"), "jaccard_members")
            one = members.select("key", *[F.col(c).alias(f"{c}_x") for c in fields])
            two = members.select("key", *[F.col(c).alias(f"{c}_y") for c in fields])
            pairs = one.join(two, (one["key"] == two["key"]) & (F.col("id_x") < F.col("id_y"))
                             & (F.col("component_x") != F.col("component_y")) & _may_link(percent))
        pairs = pairs.where(_may_link(percent)).select(
            F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"),
            (F.col("size_x") + F.col("size_y")).alias("sizes"),
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = pin(pairs, "jaccard_pairs")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        new = pin(verified(pairs, segments, percent), "jaccard_links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            found = components(links)
    if found is None:
        return None
    return classes.join(found, classes["id"] == found["node"]).select("cls", "component")


def linked_groups(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    n: int = WORDS,
    percent: int = PERCENT,
    star_rounds: int = 2,
) -> DataFrame:
    """One row per document: ``keep``, ``n_shingles`` and ``component_id``.

    Two documents are linked if their sets of n-word shingles have ``100 * intersection >= percent
    * union``; ``component_id`` is the least ``doc_id`` reachable by links, the own one without
    any. Null and blank texts have no shingles and no links. Repeated rows are linked to each
    other, unless blank; null ids are passed over unless a group has no other. ``docs`` needs
    ``doc_id`` and ``text``, and ``doc_id`` must be among ``keep``; other columns are ignored.
    """
    ship(docs.sparkSession)
    about = pin(described(docs, keep, n), "jaccard_sets")
    found = linked_classes(docs, n, percent, star_rounds)
    least = about.where("n_shingles > 0").groupBy("cls").agg(F.min("kept.doc_id").alias("least"))
    if found is not None:
        least = least.join(found, "cls", "left")
        whole = least.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("_whole"))
        least = least.join(whole, "component", "left").select("cls", F.coalesce("_whole", "least").alias("component_id"))
    else:
        least = least.withColumnRenamed("least", "component_id")
    df = about.join(least, "cls", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("kept.doc_id"))
    return df.select("kept.*", "n_shingles", own.alias("component_id"))


def representatives(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, star_rounds: int = 2) -> DataFrame:
    """One document of each group, that of the least id, with all its columns, whatever their names.

    Null, empty and blank texts have no group and all stay; of repeated rows one stays; of a
    group whose ids are all null, too. An empty table gives no rows. Texts are compared whole.
    """
    digest, place = private(docs, "_digest"), private(docs, "_place")
    of, least = private(docs, "_of"), private(docs, "_least")
    marked = docs.withColumn(digest, F.xxhash64("text"))
    groups = linked_groups(marked, ["doc_id", digest], n, percent, star_rounds)
    groups = groups.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", digest)).alias("row"))
    kept = groups.select(F.col("row.doc_id").alias(least), F.col(f"row.`{digest}`").alias(of))
    same = F.col("doc_id").eqNullSafe(F.col(least)) & F.col(digest).eqNullSafe(F.col(of))
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = Window.partitionBy("doc_id", digest).orderBy("doc_id")
    full = marked.where(~blank).join(kept, same).withColumn(place, F.row_number().over(once)).where(F.col(place) == 1)
    return full.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(blank))


def op8(spark, sf_dir: str) -> DataFrame:
    return linked_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) m ON m.node = d.doc_id
"""
