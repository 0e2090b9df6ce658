"""Document fingerprints of closed syncmers over words.

A k-mer is ``k`` words in a row. It is an anchor if, among its inner runs of ``s`` words, the
first or the last has the least hash. Whether it is one depends on these k words alone, so an
edit leaves all anchors outside it in place, and equal passages have equal anchors at matching
positions whatever surrounds them. At least one of any k-s neighbouring k-mers is an anchor, so
a text of 2k-s-1 words or more has some. Where a shorter one has none, its k-mer of least hash
stands for it in the fingerprint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.llm.common import fixed, words

K, S = 12, 3


def anchors(df: DataFrame, keep: Sequence[str], text: Column, out: str, k: int = K, s: int = S) -> DataFrame:
    """``keep`` and ``out``, structs (pos, hash) of the anchors in order of position; and as
    ``<out>_least`` the least hash of a k-mer, for texts of k words or more that may have none.

    ``hash`` is xxhash64 (seed 42) of the k words joined by blanks, ``pos`` the number of the
    first. A text of fewer than k words has its whole word sequence as its only anchor; a null,
    empty or blank text has none.
    """
    df = fixed(df, keep, _w=words(text))
    inner = F.transform(
        F.slice("_w", 1, F.greatest(F.lit(0), F.size("_w") - (s - 1))),
        lambda w, i: F.xxhash64(F.concat_ws(" ", w, *[F.get("_w", i + j) for j in range(1, s)])),
    )
    df = fixed(df, [*keep, "_w"], _h=F.when(F.size("_w") >= k, inner))
    width = k - s + 1
    closed = F.filter(
        F.sequence(F.lit(0), F.size("_w") - k),
        lambda i: F.least(F.get("_h", i), F.get("_h", i + (width - 1))) <= F.array_min(F.slice("_h", i + 1, width)),
    )
    hashed = lambda i: F.xxhash64(F.array_join(F.slice("_w", i + 1, k), " "))
    found = F.transform(closed, lambda i: F.struct(i.alias("pos"), hashed(i).alias("hash")))
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.size("_w") - k), hashed))
    short = F.struct(F.lit(0).alias("pos"), F.xxhash64(F.array_join("_w", " ")).alias("hash"))
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    made = F.when(F.size("_w") >= k, found).when(F.size("_w") > 0, F.array(short)).otherwise(none)
    unsure = F.size("_w").between(k, 2 * k - s - 2)
    return fixed(df, keep, **{out: made, f"{out}_least": F.when(unsure, least)})


def with_least(found: Column, least: Column) -> Column:
    """The anchors, or ``least`` (see :func:`anchors`) at place 0 where there are none."""
    alone = F.array(F.struct(F.lit(0).alias("pos"), least.alias("hash")))
    return F.when((F.size(found) == 0) & least.isNotNull(), alone).otherwise(found)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of anchor hashes; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def matched(df: DataFrame, keep: Sequence[str], **pairs: tuple[str, str]) -> DataFrame:
    """``keep`` and the likeness (0 to 1) of each pair of columns of anchors by matching positions.

    Anchors of equal hash, each at its first place, are matched and put in the order of the one
    text. A match counts if its place in the other text follows that of the match before it, so
    each jump back costs one. The likeness is the share of these among all distinct anchors of
    both: 1 for equal texts and for two without anchors, and never above that of the bare hashes.
    Anchors of both texts are sorted by hash once, so a long text costs little more than its sort.
    """
    tagged = lambda c, side: F.transform(c, lambda a: F.struct(a["hash"].alias("hash"), F.lit(side).alias("side"), a["pos"].alias("pos")))
    df = fixed(df, keep, **{n: F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))) for n, (a, b) in pairs.items()})

    def first_places(n: str) -> Column:
        before = lambda i: F.get(n, i - 1)
        new = lambda x, i: (i == 0) | (x["hash"] != before(i)["hash"]) | (x["side"] != before(i)["side"])
        return F.filter(n, lambda x, i: F.coalesce(new(x, i), F.lit(True)))

    def matches(n: str) -> Column:
        after = lambda i: F.get(n, i + 1)
        both = lambda x, i: F.when(after(i)["hash"] == x["hash"], F.struct(x["pos"].alias("a"), after(i)["pos"].alias("b")))
        return F.array_sort(F.filter(F.transform(n, both), lambda p: p.isNotNull()))

    def share(n: str) -> Column:
        common = f"{n}_common"
        forward = F.filter(common, lambda p, i: F.coalesce(p["b"] > F.get(common, i - 1)["b"], F.lit(True)))
        union = F.size(n) - F.size(common)
        return F.when(union == 0, F.lit(1.0)).otherwise(F.size(forward) / union).cast("double")

    df = fixed(df, keep, **{n: first_places(n) for n in pairs})
    df = fixed(df, [*keep, *pairs], **{f"{n}_common": matches(n) for n in pairs})
    return fixed(df, keep, **{n: share(n) for n in pairs})


def text_form(found: Column) -> Column:
    """Hashes of the anchors in order of position, 16 hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda a: F.lpad(F.lower(F.hex(a["hash"])), 16, "0")), " ")


def ranges_of(key: str, cuts: Sequence[int]) -> Column:
    """How many of the sorted cuts lie below the key; looked up in two steps of square-root size."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [list(cuts[i : i + step]) for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(key)))
    # The last block whose first cut lies below the key holds the place.
    block = F.greatest(F.lit(0), below(F.lit([b[0] for b in blocks])) - 1)
    inner = F.get(F.array(*[F.lit(b) for b in blocks]), block)
    return F.coalesce(block * step + below(inner), F.lit(0))


def routed(docs: DataFrame, key: str, n_ranges: int) -> DataFrame:
    """``docs`` with ``_range`` and ``_ghost``: ranges of the key, and copies of their first rows.

    Ranges are cut at approximate quantiles of the key. The first row of every range is also sent,
    as a ghost, to the range before it (that of the first to the last), so each range finds the
    successor of its last row at home. Only the cuts reach the driver, and only one row per range
    is broadcast.
    """
    shares = [i / n_ranges for i in range(1, n_ranges)]
    cuts = docs.agg(F.percentile_approx(key, shares or [0.5], max(10_000, 20 * n_ranges)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or [])) if shares else []
    at = ranges_of(key, cuts)
    own = docs.select(key).withColumn("_own", at)
    firsts = own.groupBy("_own").agg(F.min(F.struct(key)).alias("least"))
    ordered = Window.orderBy("_own")
    to = F.coalesce(F.lag("_own").over(ordered), F.max("_own").over(Window.partitionBy()))
    firsts = firsts.select("_own", F.col(f"least.{key}").alias("_first"), to.alias("_to"))
    df = docs.withColumn("_range", at)
    is_first = (F.col("_range") == F.col("_own")) & F.col(key).eqNullSafe(F.col("_first"))
    df = df.join(F.broadcast(firsts), is_first, "left")
    place = lambda n, ghost: F.struct(F.col(n).alias("_range"), F.lit(ghost).alias("_ghost"))
    places = F.when(F.col("_own").isNull(), F.array(place("_range", False))).otherwise(
        F.array(place("_range", False), place("_to", True))
    )
    return df.select(*docs.columns, F.inline(places))


def edited_fingerprints(docs: DataFrame, k: int = K, s: int = S, n_ranges: int | None = None) -> DataFrame:
    """Every document's anchors, those of its edited text, and those of the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all)
    of the next document by ``doc_id``; the first follows the last, and a single document
    follows itself. Null texts are empty. Rows of one ``doc_id`` go by text, a null ``doc_id``
    comes first. Other columns are ignored. The one shuffle of texts is that to the ranges.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = routed(plain, "doc_id", n_ranges)
    own = anchors(plain, ["doc_id", "text", "_range", "_ghost"], F.col("text"), "anchors", k, s)
    # Own rows first; the ghosts of the next range come after them, the least one first.
    order = Window.partitionBy("_range").orderBy("_ghost", "doc_id", "text")
    df = own.select(
        "doc_id", "text", "anchors", "anchors_least", "_ghost",
        *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "anchors", "anchors_least")],
    ).where(~F.col("_ghost"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    found = ["doc_id", "anchors", "anchors_least", "next_anchors", "next_anchors_least"]
    df = fixed(df, found, n_chars=n.cast("bigint"), edited=edited)
    return anchors(df, [*found, "n_chars", "edited"], F.col("edited"), "edited_anchors", k, s)


def op7(spark, sf_dir: str) -> DataFrame:
    df = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df = fixed(
        df, ["doc_id", "n_chars"], edited_sha256=F.sha2("edited", 256),
        **{n: with_least(F.col(c), F.col(f"{c}_least")) for n, c in (("a", "anchors"), ("e", "edited_anchors"), ("x", "next_anchors"))},
    )
    df = fixed(
        df, ["doc_id", "n_chars", "edited_sha256", "a", "e", "x"],
        fingerprint=text_form(F.col("a")), edited_fingerprint=text_form(F.col("e")),
    )
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    return matched(df, out, near_edited=("a", "e"), near_next=("a", "x"))
