"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash over the last bytes hits a pattern, so equal passages are cut
alike wherever they stand. A chunk found in several documents is encoded once, in a table of
its own; all others are encoded where they are. Cuts fall anywhere, also inside words, so a
chunk's own ids cover only its core, from its first to its last white space. At a join, the open
end of one chunk and the open start of the next are encoded again together, widened over whole
chunks until white space closes both sides. There the ids must agree with those of the
unbroken text: the tokenizer splits at white space before it merges anything.

Which chunks are shared is found from counts of their hashes; tasks know it by a bitmap of fixed
size. A chunk it wrongly takes for shared only travels more; ids are the same either way.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopledger.llm.common import sliced
from shopledger.plans.pinning import pin
from shopledger.plans.shipping import ship

#: Mean bytes per chunk (a power of two), bytes the rolling hash sees, and bits of the bitmap (1 MB).
CHUNK_BYTES, WINDOW, BITMAP_BITS = 1024, 16, 1 << 23
_BLOCK = 32_768
#: Words whose ids a process remembers: between once and twice as many.
REMEMBERED = 75_000
_SPACE = re.compile(rb"[ \t-\r]")
_MULTIPLIER, _MULTIPLIER_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes hashed at a time.
_SLAB = 1 << 20


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Words of ASCII and Latin-1 letters, unchanged by canonical composition.
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the vocabulary's rule for splitting a lower-case word, in these letters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others are numbered from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.cache
def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """UTF-8 text to ids (little-endian, 32 bits each), word by word, remembering words.

    White space separates words for the tokenizer too. Simple words are lower-cased and split
    here and merged by the tokenizer's model, all others go through the whole tokenizer. The
    memory of a process is kept between tasks and bounded by ``REMEMBERED``.
    """
    t = tokenizer(path)
    letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
    special = [a.content for a in t.get_added_tokens_decoder().values()]
    known: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
    pieces: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def remember(memory: tuple[dict, dict], key: bytes | str, ids: bytes) -> bytes:
        """Keep in the young half; when it is full, the old one is forgotten."""
        young, old = memory
        if len(young) >= REMEMBERED:
            old.clear()
            old.update(young)
            young.clear()
        young[key] = ids
        return ids

    def ids_of(ids: Sequence[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(p: str) -> bytes:
        found = pieces[0].get(p)
        if found is None:
            found = pieces[1].get(p)
            if found is None:
                plain = p if p.isascii() else p.encode().decode("latin-1").translate(letters)
                found = ids_of([token.id for token in t.model.tokenize(plain)])
            if len(p) <= 64:
                remember(pieces, p, found)
        return found

    def word(w: bytes) -> bytes:
        text = w.decode()
        if _SIMPLE.fullmatch(text) and not any(s in text for s in special):
            return b"".join(map(piece, _PIECES.findall(text.lower())))
        return ids_of(t.encode(text, add_special_tokens=False).ids)

    young, old = known

    def encode(text: bytes) -> bytes:
        out = []
        for w in text.split():
            ids = young.get(w)
            if ids is None:
                ids = old.get(w) or word(w)
                if len(w) <= 64:
                    remember(known, w, ids)
            out.append(ids)
        return b"".join(out)

    return encode


def cuts(data: bytes) -> list[int]:
    """Where chunks end: positions whose last ``WINDOW`` bytes hash to the pattern, and the end.

    Positions are moved back to the start of a code point, so a window that ends inside one cuts
    alike everywhere.
    """
    if not data:
        return []
    hits: list[int] = []
    for start in range(0, len(data) - WINDOW + 1, _SLAB):
        slab = np.frombuffer(data, np.uint8)[start : start + _SLAB + WINDOW - 1]
        # The eight bytes from every position, as one number; two of them make a window.
        number = np.empty(len(slab) - 7, "<u8")
        for i in range(8):
            places = number[i::8]
            places[:] = slab[i : i + 8 * len(places)].view("<u8")
        mixed = (number[:-8] * _MULTIPLIER) ^ (number[8:] * _MULTIPLIER_2)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER
        found = np.flatnonzero((mixed >> np.uint64(40)) & np.uint64(CHUNK_BYTES - 1) == 0)
        hits += (found + (start + WINDOW)).tolist()
    ends: list[int] = []
    for end in hits:
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end > (ends[-1] if ends else 0) and end < len(data):
            ends.append(end)
    return [*ends, len(data)]


def chunks(data: bytes) -> list[bytes]:
    out, start = [], 0
    for end in cuts(data):
        out.append(data[start:end])
        start = end
    return out


def address(chunk: bytes) -> bytes:
    """The chunk's content address; 128 bits, so that no two chunks of any corpus share one."""
    return xxhash.xxh3_128_digest(chunk)


def _bit_of(h: bytes) -> int:
    return int.from_bytes(h[:4], "little") % BITMAP_BITS


Parts = tuple[bytes, bytes | None, bytes]


def split_ends(chunk: bytes) -> Parts:
    """(open start, core, open end); the core is None if the chunk has no white space."""
    first = _SPACE.search(chunk)
    if not first:
        return chunk, None, b""
    last = max(chunk.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return chunk[: first.start()], chunk[first.start() : last + 1], chunk[last + 1 :]


def joined_ids(parts: Iterable[Parts], encode: Callable[[bytes], bytes]) -> bytes:
    """Ids of the whole text, from parts whose cores are encoded already."""
    out, run = [], []
    for head, core, tail in parts:
        run.append(head)
        if core is not None:
            out += [encode(b"".join(run)), core]
            run = [tail]
    return b"".join([*out, encode(b"".join(run))])


def _bit(bitmap: bytes, h: bytes) -> bool:
    bit = _bit_of(h)
    return bool(bitmap[bit >> 3] >> (bit & 7) & 1)


def _addresses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out: list[bytes] = []
        for t in batch.column("text").to_pylist():
            out += {address(c) for c in chunks((t or "").encode())}
        bits = pa.array(map(_bit_of, out), pa.int32())
        yield pa.record_batch([pa.array(out, pa.binary()), bits], ["h", "bit"])


def _shared_bitmap(docs: DataFrame) -> bytes | None:
    """Bits of the chunks found in two documents or more; None if there are none."""
    found = docs.select("text").mapInArrow(_addresses, "h binary, bit int").groupBy("h", "bit").count()
    block = F.expr(f"bit div {_BLOCK}").cast("int").alias("block")
    blocks = found.where("count > 1").groupBy(block).agg(F.bitmap_construct_agg(F.col("bit") % _BLOCK).alias("bits"))
    rows = blocks.collect()  # at most BITMAP_BITS / 32,768 rows of 4 KB
    if not rows:
        return None
    out = bytearray(BITMAP_BITS // 8)
    for row in rows:
        at = row["block"] * _BLOCK // 8
        out[at : at + len(row["bits"])] = row["bits"]
    return bytes(out)


_PART = "row bigint, n int, pos int, h binary, head binary, core binary, tail binary, chunk binary"


def encode_documents(
    docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), decode: bool = False
) -> DataFrame:
    """``keep``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text.

    With ``decode`` also ``decoded``, the text of the ids, made by the task that made them.
    The result is that of the tokenizer without added special tokens, truncation or padding. Null
    and empty texts have no ids. Repeated rows are encoded each; other columns are ignored. The
    parts of documents with shared chunks, and those chunks, are written to the shared folder.
    """
    ship(docs.sparkSession)
    kept = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept")
    df = docs.select(kept, "text")
    bitmap = _shared_bitmap(docs)
    fields = f"kept {df.schema['kept'].dataType.simpleString()}, ids binary, decoded string"
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without shared chunks."""
        encode, shared = word_encoder(path), sent.value
        for batch in sliced(batches):
            made: list[bytes] = []
            rows: list[int] = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                pieces = chunks((t or "").encode())
                if shared and any(_bit(shared, address(c)) for c in pieces):
                    continue
                split = map(split_ends, pieces)
                made.append(joined_ids(((a, c if c is None else encode(c), z) for a, c, z in split), encode))
                rows.append(i)
            yield _result(batch.column("kept").take(pa.array(rows, pa.int32())), made, path, decode)

    result = df.mapInArrow(whole, fields)
    if bitmap is not None:
        result = result.unionByName(_with_shared(df, fields, path, sent, decode))
    more = ["decoded"] if decode else []
    return result.select("kept.*", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", *more)


def _result(kept: pa.Array, made: list[bytes], path: str, decode: bool) -> pa.RecordBatch:
    text = [*map(decoder(path), made)] if decode else [None] * len(made)
    return pa.record_batch([kept, pa.array(made, pa.binary()), pa.array(text, pa.string())], ["kept", "ids", "decoded"])


def _with_shared(df: DataFrame, fields: str, path: str, sent, decode: bool) -> DataFrame:
    """Ids of the documents that have shared chunks."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The document's row (pos -1), its chunks, and each shared chunk's text once per task."""
        encode, shared = word_encoder(path), sent.value
        task, count = TaskContext.get().partitionId() << 40, 0
        told: set[bytes] = set()
        for batch in sliced(batches):
            out: list[tuple] = []
            takes: list[int | None] = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                pieces = [(address(c), c) for c in chunks((t or "").encode())]
                if not any(_bit(shared, h) for h, _ in pieces):
                    continue
                count += 1
                row = task + count
                out.append((row, len(pieces), -1, None, None, None, None, None))
                takes.append(i)
                for pos, (h, c) in enumerate(pieces):
                    if not _bit(shared, h):
                        head, core, tail = split_ends(c)
                        core = core if core is None else encode(core)
                        out.append((row, len(pieces), pos, None, head, core, tail, None))
                    else:
                        out.append((row, len(pieces), pos, h, None, None, None, None if h in told else c))
                        told.add(h)
                    takes.append(None)
            columns = [*zip(*out, strict=True)] if out else [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["row", "n", "pos", "h", "head", "core", "tail", "chunk"]
            who = batch.column("kept").take(pa.array(takes, pa.int32()))
            yield pa.record_batch([*arrays, who], [*names, "kept"])

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in sliced(batches):
            split = [split_ends(c) for c in batch.column("chunk").to_pylist()]
            cores = [c if c is None else encode(c) for _, c, _ in split]
            arrays = [pa.array([s[0] for s in split], pa.binary()), pa.array(cores, pa.binary())]
            arrays.append(pa.array([s[2] for s in split], pa.binary()))
            yield pa.record_batch([batch.column("h"), *arrays], ["h", "head", "core", "tail"])

    kept = fields.rsplit(", ids binary", 1)[0]
    cut = pin(df.mapInArrow(parts, f"{_PART}, {kept}"), "bpe_parts")
    content = cut.where("chunk IS NOT NULL").groupBy("h").agg(F.any_value("chunk").alias("chunk"))
    table = pin(content.mapInArrow(encoded, "h binary, head binary, core binary, tail binary"), "bpe_chunks")
    part = F.struct("pos", "head", "core", "tail")
    own = cut.where("pos >= 0 AND h IS NULL").select("row", part.alias("part"))
    reused = cut.where("pos >= 0 AND h IS NOT NULL").select("row", "pos", "h").join(table, "h")
    both = own.unionByName(reused.select("row", part.alias("part")))
    gathered = both.groupBy("row").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    owners = cut.where("pos = -1").select("row", "kept")

    def assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in sliced(batches):
            made = [
                joined_ids(((p["head"], p["core"], p["tail"]) for p in parts), encode)
                for parts in batch.column("parts").to_pylist()
            ]
            yield _result(batch.column("kept"), made, path, decode)

    return owners.join(gathered, "row").select("kept", "parts").mapInArrow(assembled, fields)


@functools.cache
def token_table(path: str) -> np.ndarray:
    """Tokens by id."""
    t = tokenizer(path)
    return np.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size())], dtype=object)


def decoder(path: str) -> Callable[[bytes], str]:
    """Binary ids to text, special tokens included.

    A vocabulary without a decoder gives its tokens joined by blanks, which needs no more than a
    table; any other goes through its own decoder.
    """
    t = tokenizer(path)
    if t.decoder is None:
        table = token_table(path)
        return lambda ids: " ".join(table[np.frombuffer(ids, "<u4")].tolist())
    return lambda ids: t.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def decode_ids(ids: Column, path: str) -> Column:
    """The text of a column of binary ids."""

    @F.pandas_udf(T.StringType())
    def decoded(ids: pd.Series) -> pd.Series:
        return ids.map(decoder(path))

    return decoded(ids)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_documents(docs: DataFrame, path: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encoded documents with digests of the ids and of the text they decode to."""
    path = path or vocabulary()
    df = encode_documents(docs, path, keep, decode=True)
    return df.select(
        *keep, F.col("n_tokens").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
