"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities themselves (``find_entities``). Terms near them may give an
entity away all the same. How much is estimated from co-occurrence in the whole corpus::

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 + log2 P(e | t) / IC(e),   IC(e) = log2(N / n(e))

which is 1 if the term never occurs without the entity and falls as it occurs elsewhere. A term
whose disclosure reaches ``generalise_at`` for any entity is replaced by its class, one that
reaches ``remove_at`` is removed, wherever it occurs. Protected are single entities and what they
share: the domain of an e-mail address, the network of an IP address, the first digits of a card
or phone number.

Counts are of distinct texts: copies of a document are evidence once, and what stands in
different documents counts in each. A pair needs ``least_texts`` of them. The corpus is read for
the digests of texts, for the surroundings of entities, for the counts of the candidate terms, and to
apply the result. Tasks know candidate terms and repeated texts by bitmaps of fixed size. The
terms of other texts are counted inside the task; only repeated texts send a row per term, of
which one per text counts. What the bitmaps let through by chance costs work, not results.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopledger.llm.common import sliced
from shopledger.plans.pinning import pin
from shopledger.plans.shipping import ship

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as near it.
NEAR = 8
#: Bits of the bitmaps of terms (128 KB) and of repeated texts (1 MB), whatever the size of the corpus.
BITMAP_BITS, TEXT_BITS = 1 << 20, 1 << 23
#: Terms that a task counts before it sends them.
TERMS_HELD = 200_000
_BLOCK = 32_768

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A failing match can start nowhere inside its run of digits, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _DIGIT_OR_AT = re.compile(r"[0-9]"), re.compile(r"[0-9@]")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find_entities(text: str) -> list[Span]:
    """Spans (kind, start, end) by kind, then start; leftmost and non-overlapping per kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def entity_name(kind: str, raw: str) -> str:
    """One name per entity, however it is written."""
    return f"{kind}:{raw.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(_DIGIT.findall(raw))}"


def protected(kind: str, raw: str) -> tuple[str, str]:
    """The entity, and what it shares with others of its kind."""
    name = entity_name(kind, raw)
    bare = name.split(":", 1)[1]
    shared = {"email": bare.rpartition("@")[2], "ip": bare.rpartition(".")[0], "card": bare[:6], "phone": bare[:5]}
    return name, f"{kind} in {shared[kind]}"


def terms_of(text: str, hidden: Sequence[Span]) -> list[tuple[str, int, int]]:
    """Lower-case words of three letters or more outside the hidden spans, in order."""
    out, spans, k = [], sorted((a, b) for _, a, b in hidden), 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if any(a < m.end() and m.start() < b for a, b in spans[k : k + 4]):
            continue
        out.append((m[0].lower(), *m.span()))
    return out


def near_entities(text: str) -> set[tuple[str, str]]:
    """(term, entity) of the words near each entity; an empty term stands for the entity itself."""
    spans = find_entities(text)
    if not spans:
        return set()
    terms, found = terms_of(text, spans), set()
    starts = [a for _, a, _ in terms]
    for kind, a, b in spans:
        i = bisect.bisect_left(starts, a)
        around = {t for t, _, _ in terms[max(0, i - NEAR) : i + NEAR]} | {""}
        found.update((t, entity) for t in around for entity in protected(kind, text[a:b]))
    return found


def in_bitmap(bitmap: bytes, bit: int) -> bool:
    return bool(bitmap[bit >> 3] >> (bit & 7) & 1)


def _term_bit(term: str) -> int:
    return zlib.crc32(term.encode()) % BITMAP_BITS


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _near_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = zip(batch.column("digest").to_pylist(), _texts(batch), strict=True)
        rows = {(*pair, digest) for digest, text in texts for pair in near_entities(text)}
        columns = [*zip(*rows)] if rows else [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "entity", "digest"])


def _bitmap_of(bits: DataFrame, size: int) -> bytes | None:
    """Bitmap of the column ``bit``, ``size`` bits at most; None without rows."""
    blocks = bits.groupBy(F.floor(F.col("bit") / _BLOCK).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(F.col("bit") % _BLOCK).alias("bits")
    )
    rows = blocks.collect()  # one row per block, at most size / 32,768
    if not rows:
        return None
    out = bytearray(size // 8)
    for row in rows:
        at = row["block"] * _BLOCK // 8
        out[at : at + len(row["bits"])] = row["bits"]
    return bytes(out)


def _bitmap_of_terms(terms: DataFrame) -> bytes | None:
    return _bitmap_of(terms.select((F.crc32(F.col("term").cast("binary")) % BITMAP_BITS).alias("bit")), BITMAP_BITS)


class _Likely:
    """The terms whose bit is set, remembered for frequent words."""

    def __init__(self, bitmap: bytes):
        self.bitmap, self.known = bitmap, {}

    def among(self, words: Iterable[str]) -> set[str]:
        if len(self.known) > TERMS_HELD:
            self.known.clear()
        known, found = self.known, set()
        for word in words:
            term = known.get(word)
            if term is None:
                low = word.lower()
                term = known[word] = low if in_bitmap(self.bitmap, _term_bit(low)) else ""
            if term:
                found.add(term)
        return found


def _occurrences(text: str, likely: _Likely) -> Iterator[Span]:
    """(term, start, end) of the words outside entities whose bit is set."""
    some = likely.among(set(_TERM.findall(text)))
    if some:
        yield from (x for x in terms_of(text, find_entities(text)) if x[0] in some)


def text_counts(docs: DataFrame, terms: DataFrame, repeated: bytes | None) -> DataFrame:
    """``term, n_term``: distinct texts with each term, and with some others that share a bit."""
    bitmap = _bitmap_of_terms(terms)

    def told(counts: dict[str, int], rows: set[tuple[str, int]]) -> pa.RecordBatch:
        columns = [[*counts, *(t for t, _ in rows)], [*[None] * len(counts), *(d for _, d in rows)], [*counts.values(), *[1] * len(rows)]]
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "digest", "n"])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely, counts, rows = _Likely(bitmap), Counter(), set()
        for batch in sliced(batches):
            for digest, text in zip(batch.column("digest").to_pylist(), _texts(batch), strict=True):
                found = likely.among(set(_TERM.findall(text)))
                if found and _DIGIT_OR_AT.search(text):
                    found &= {t for t, _, _ in terms_of(text, find_entities(text))}
                if repeated and in_bitmap(repeated, digest % TEXT_BITS):
                    rows.update((t, digest) for t in found)
                else:
                    counts.update(found)
            if len(counts) + len(rows) > TERMS_HELD:
                yield told(counts, rows)
                counts, rows = Counter(), set()
        yield told(counts, rows)

    sent = docs.mapInArrow(counted, "term string, digest bigint, n bigint").groupBy("term", "digest").agg(F.sum("n").alias("n"))
    return sent.groupBy("term").agg(F.sum(F.when(F.col("digest").isNull(), F.col("n")).otherwise(1)).alias("n_term"))


def _disclosure(n_both: Column, n_term: Column, n_entity: Column, texts: int) -> Column:
    information = F.greatest(F.log2(F.lit(float(texts)) / n_entity), F.lit(1.0))
    return 1 + F.log2(F.least(F.lit(1.0), n_both / n_term)) / information


def rated_terms(docs: DataFrame, least_texts: int = 3, at_least: float | None = None) -> DataFrame:
    """``term, disclosure`` of every term near entities in ``least_texts`` distinct texts: the highest
    disclosure of any entity. ``docs`` needs ``text``; null and empty texts hold no terms.

    With ``at_least`` terms below it are left out. A term is in as many texts at least as it is
    near any entity in, which bounds its disclosure from above; only terms whose bound
    reaches ``at_least`` are counted in the whole corpus.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.xxhash64(body).alias("digest"), body.alias("text"))
    near = pin(docs.mapInArrow(_near_batches, "term string, entity string, digest bigint"), "pii_near")
    counts = near.groupBy("entity", "term").agg(F.countDistinct("digest").alias("n_both"))
    counts = pin(counts.where((F.col("term") == "") | (F.col("n_both") >= least_texts)), "pii_counts")
    entities = counts.where("term = ''").select("entity", F.col("n_both").alias("n_entity"))
    digests = pin(docs.groupBy("digest").agg((F.count(F.lit(1)) > 1).alias("again")), "pii_texts")
    texts = digests.count()
    pairs = counts.where("term <> ''").join(entities, "entity")
    if at_least is not None:
        anywhere = near.where("term <> ''").groupBy("term").agg(F.countDistinct("digest").alias("n_near"))
        bound = _disclosure(F.col("n_both"), F.col("n_near"), F.col("n_entity"), texts)
        pairs = pairs.join(anywhere, "term").where(bound >= at_least).drop("n_near")
    pairs = pin(pairs, "pii_pairs")
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, disclosure double")
    repeated = _bitmap_of(digests.where("again").select(F.pmod("digest", F.lit(TEXT_BITS)).alias("bit")), TEXT_BITS)
    joined = pairs.join(text_counts(docs, pairs, repeated), "term")
    disclosure = _disclosure(F.col("n_both"), F.col("n_term"), F.col("n_entity"), texts)
    rated = joined.select("term", disclosure.alias("disclosure")).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return rated if at_least is None else rated.where(F.col("disclosure") >= at_least)


def disclosing_terms(
    docs: DataFrame, generalise_at: float = 0.9, remove_at: float = 0.97, least_texts: int = 3
) -> DataFrame:
    """``term, disclosure, action`` of the terms that reveal some entity too strongly.

    Null and empty texts hold none; repeated texts count once; an empty table gives no rows.
    """
    action = F.when(F.col("disclosure") >= remove_at, F.lit("remove")).otherwise(F.lit("generalise"))
    rated = rated_terms(docs, least_texts, generalise_at)
    return pin(rated.withColumn("action", action), "pii_terms")


_SPAN = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)


@F.pandas_udf(_SPAN)
def _entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in find_entities(t)])


def personal_data(docs: DataFrame, keep: Sequence[str] = ("doc_id",), terms: DataFrame | None = None) -> DataFrame:
    """``keep`` and ``spans`` (kind, start, end; code points, end exclusive) of every whole text.

    Kinds are those of ``KINDS``, then ``generalise`` and ``remove`` for disclosing terms (found
    in ``docs`` unless given). Spans go by kind in this order, then start. Null and empty texts
    have none; repeated rows each keep theirs; other columns are ignored. ``docs`` needs
    ``text`` only, besides ``keep``.
    """
    ship(docs.sparkSession)
    terms = disclosing_terms(docs) if terms is None else terms
    text = F.coalesce("text", F.lit(""))
    kept = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept")
    digest = F.sha2(text, 256)
    df = docs.select(kept, digest.alias("digest"), _entities(text).alias("base"))
    bitmap = _bitmap_of_terms(terms)
    if bitmap is None:
        return df.select("kept.*", F.col("base").alias("spans"))

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = _Likely(bitmap)
        for batch in sliced(batches):
            rows = [
                (d, *x)
                for d, text in zip(batch.column("digest").to_pylist(), _texts(batch), strict=True)
                for x in _occurrences(text, likely)
            ]
            columns = [*zip(*rows, strict=True)] if rows else [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "term", "start", "end"]
            )

    found = docs.select(digest.alias("digest"), "text").mapInArrow(
        hits, "digest string, term string, start bigint, end bigint"
    )
    span = F.struct(F.col("action").alias("kind"), "start", "end")
    found = found.join(terms, "term").groupBy("digest").agg(F.sort_array(F.collect_set(span)).alias("more"))
    df = df.join(found, "digest", "left")
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    return df.select("kept.*", F.concat("base", more).alias("spans"))


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def sanitise(text: str, spans: Iterable[Span]) -> str:
    """The text with entities replaced by labels, terms by their class or nothing.

    Overlapping spans are replaced together, by the label of the one that starts first.
    """
    out, done = [], 0
    for start, neg_end, kind in sorted((a, -b, k) for k, a, b in spans):
        end = -neg_end
        if start < done:
            done = max(done, end)
            continue
        out.append(text[done:start])
        if kind in LABELS:
            out.append(LABELS[kind])
        elif kind == "generalise":
            out.append("[NAME]" if text[start].isupper() else "[WORD]")
        done = end
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def _sanitised(text: pd.Series, kinds: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    rows = zip(text, kinds, starts, ends, strict=True)
    return pd.Series([sanitise(t, [*zip(k, a, b, strict=True)]) for t, k, a, b in rows], dtype=object)


def sanitised_documents(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``docs`` with the texts sanitised, and ``n_chars``, if there, that of the new text.

    Rows, their number and all other columns stay as they are, whatever their names; a null text
    stays null, an empty one empty, and texts without personal data do not change. Repeated rows
    are treated each; an empty table gives no rows.
    """
    fields = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_row")
    found = personal_data(docs.select(row, "text"), ["_row"], terms)
    get = lambda name: F.transform("spans", lambda s: s[name])
    body = F.coalesce("_row.text", F.lit(""))
    new = F.when(F.size("spans") > 0, _sanitised(body, get("kind"), get("start"), get("end"))).otherwise(
        F.col("_row.text")
    )
    df = found.select("_row", new.alias("_text"))
    made = {"text": F.col("_text"), "n_chars": F.length(F.coalesce("_text", F.lit(""))).cast("bigint")}
    return df.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in fields])


def told(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document; disclosing terms come from ``documents`` as well."""
    df = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return df.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )
