"""Conversation structure repair by a run-length dynamic program.

A row of a conversation is a symbol: the initial of its role, and its first fault. The cheapest
edits that give role initials ``(s?(ua)+)?`` are a shortest path through four states (start,
after system, after user, after assistant). What a symbol does to the costs of the states is a
min-plus matrix; equal consecutive symbols form a run, and a run of n is advanced by the cached
powers of its matrix for the binary digits of n. From the costs at the ends of the runs, the
choices are unrolled forward, at every step the least letter that still leads to the least cost.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shopledger.llm.common import SPACE_CHARS, private, sliced
from shopledger.plans.shipping import ship


@dataclass(frozen=True)
class Costs:
    """Prices of the edits; a truncated row that stays costs ``truncated`` in addition."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


COSTS = Costs()
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
_FAR = 1 << 60
#: Where an inserted or re-roled row leads, and where a kept one of each initial.
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_OPEN = {START: 0, ASSISTANT: 0}  # states in which a conversation may end

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def _edits(symbol: str, state: int, costs: Costs) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, by letter."""
    found = [("D", costs.delete, state)]
    if symbol != "x":
        more = costs.truncated if symbol.isupper() else 0
        kept = _KEPT.get(symbol.lower(), {}).get(state)
        found += [("K", more, kept)] if kept is not None else []
        found.append(("R", costs.rerole + more, _TURN[state]))
    return found


def _times(left: Matrix, right: Matrix) -> Matrix:
    return tuple(tuple(min(min(a + b for a, b in zip(row, col)), _FAR) for col in zip(*right)) for row in left)


def _applied(matrix: Matrix, after: Vector) -> Vector:
    return tuple(min(min(a + b for a, b in zip(row, after)), _FAR) for row in matrix)


@functools.cache
def _inserts(costs: Costs) -> Matrix:
    """Least cost from state to state by insertions alone; two reach every state they can."""
    once = tuple(tuple(0 if p == q else costs.insert if _TURN[q] == p else _FAR for p in STATES) for q in STATES)
    return _times(once, once)


@functools.cache
def power(symbol: str, k: int, costs: Costs = COSTS) -> Matrix:
    """Transition of 2^k rows of one symbol."""
    if k:
        half = power(symbol, k - 1, costs)
        return _times(half, half)
    row = [[_FAR] * len(STATES) for _ in STATES]
    for state in STATES:
        for _, cost, to in _edits(symbol, state, costs):
            row[state][to] = min(row[state][to], cost)
    return _times(_inserts(costs), tuple(map(tuple, row)))


def advanced(symbol: str, n: int, after: Vector, costs: Costs = COSTS) -> Vector:
    """Costs before a run of n rows, from those after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = _applied(power(symbol, k, costs), after)
    return after


@functools.cache
def _end(costs: Costs) -> Vector:
    return _applied(_inserts(costs), tuple(_OPEN.get(q, _FAR) for q in STATES))


def _level(v: Vector) -> Vector:
    return tuple(x - min(v) for x in v)


@functools.lru_cache(1 << 16)
def _before(symbol: str, after: Vector, costs: Costs) -> Vector:
    """What the costs before one row have above the least of them."""
    return _level(_applied(power(symbol, 0, costs), after))


@functools.lru_cache(1 << 16)
def _choice(symbol: str, state: int, after: Vector, costs: Costs) -> tuple[str, int]:
    """The least letters that end with the use of a row at least cost, and the state then."""
    before = _applied(power(symbol, 0, costs), after)
    letters = ""
    while True:
        options = [(x, cost + after[to], to) for x, cost, to in _edits(symbol, state, costs)]
        options.append(("I", costs.insert + before[_TURN[state]], _TURN[state]))
        letter, _, to = min(o for o in options if o[1] == before[state])
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def cheapest(symbols: str, costs: Costs = COSTS) -> tuple[int, str]:
    """Least cost, and of the cheapest edits' letters in order the ASCII-least."""
    runs = [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]
    after = [_end(costs)]
    for symbol, n in reversed(runs):
        after.append(advanced(symbol, n, after[-1], costs))
    after.reverse()
    state, audit = START, []
    for (symbol, n), v in zip(runs, after[1:]):
        inside = [_level(v)]
        for _ in range(n - 1):
            inside.append(_before(symbol, inside[-1], costs))
        for v in reversed(inside):
            letters, state = _choice(symbol, state, v, costs)
            audit.append(letters)
    while state not in _OPEN:
        audit.append("I")
        state = _TURN[state]
    return after[0][START], "".join(audit)


def edited(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns under the edits of an audit."""
    state, out, rows = START, [], iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = _KEPT[role[:1]][state] if letter == "K" else _TURN[state]
        out.append((role, text) if letter == "K" else (_NAME[state], text))
    return out


class _Conversation:
    """What is known of the rows seen so far, which come by turn."""

    def __init__(self):
        self.turns: list[tuple[str, str]] = []
        self.symbols: list[str] = []
        self.seen: set[bytes] = set()
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.numbers: list[int] = [0, 0, 0]  # least, greatest, distinct

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            least, most, n = self.numbers
            self.numbers = [least, turn, n + (turn != most)] if n else [turn, turn, 1]
        initial = role[:1]
        if self.turns and self.turns[-1][0][:1] + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        said = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        tail = text.rstrip(SPACE_CHARS)[-1:]
        if not tail:
            fault = "blank"
        elif said in self.seen:
            fault = "duplicate"
        else:
            fault = "" if tail in ".!?" else "truncated"
        if fault:
            self.count[fault] += 1
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append(symbol.upper() if fault == "truncated" else "x" if fault else symbol)
        self.seen.add(said)
        self.turns.append((role, text))

    def row(self, key: object, costs: Costs) -> tuple:
        cost, audit = cheapest("".join(self.symbols), costs)
        least, most, n = self.numbers
        gaps = most - least + 1 - n if n else 0
        return key, gaps, *self.count.values(), cost, audit, edited(self.turns, audit)


_MADE = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired array<struct<role:string,text:string>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
#: Finished conversations go out when they hold so many turns.
_TURNS_OUT = 4096


def _repaired(costs: Costs, id_type: pa.DataType):
    types = [id_type, *[pa.int64()] * 6, pa.string(), _TURNS]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        as_rows = lambda turns: [{"role": r, "text": t} for r, t in turns]
        columns = list(zip(*rows))
        columns[-1] = map(as_rows, columns[-1])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    def repair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, key, now = [], 0, None, None
        for batch in sliced(batches, 1024):
            for conv, turn, role, text, live in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != key:
                    if now is not None:
                        done.append(now.row(key, costs))
                        size += len(done[-1][-1]) + 1
                    if size >= _TURNS_OUT:
                        yield told(done)
                        done, size = [], 0
                    key, now = conv, _Conversation()
                if live:
                    now.add(turn, role, text)
        if now is not None:
            yield told([*done, now.row(key, costs)])

    return repair_rows


def repair(rows: DataFrame, costs: Costs = COSTS, live: str | None = None) -> DataFrame:
    """One row per ``conv_id``: gaps, faults, illegal neighbours, cost, audit, repaired turns.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored, whatever
    their names. Rows go by turn, nulls first, and rows of one turn by role and text. A null role
    or text is one space, so such a text is blank; a null ``conv_id`` is a conversation. Where the
    boolean column ``live`` is given, rows without it do not count, but their conversation is
    returned: without rows it has zeros, an empty audit and no turns. Texts are never cut, an
    empty table gives no rows.

    Rows are dealt by conversation and sorted; a task streams them and holds one conversation.
    """
    ship(rows.sparkSession)
    here = F.coalesce(F.col(f"`{live}`"), F.lit(False)) if live else F.lit(True)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    picked = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"), here.alias("live"))
    kind = rows.schema["conv_id"].dataType
    if not isinstance(kind, StringType):
        picked = picked.withColumn("conv_id", F.col("conv_id").cast("bigint"))
    id_type, told = (pa.string(), "string") if isinstance(kind, StringType) else (pa.int64(), "bigint")
    ordered = picked.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text"
    )
    return ordered.mapInArrow(_repaired(costs, id_type), f"conv_id {told}, {_MADE}")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults dealt out by crc32 of ``conv_id:turn``, nulls read as one space.

    Of 20 remainders 0 drops the row (its column ``live`` is false), 1 empties the text, 2 takes
    out its sentence ends, 3 repeats it at the same turn, 4 makes the role user. Columns are
    conv_id, turn, role, text and ``live``.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = private(rows, "code")
    dealt = rows.withColumn(code, F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20)
    of: Column = F.col(code)
    role = F.when(of == 4, "user").otherwise(told("role"))
    text = F.when(of == 1, "").when(of == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(of == 3, 2).otherwise(1)))
    out = dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (of != 0).alias("live"), times.alias("copy"))
    return out.drop("copy")


def op11(spark, sf_dir: str) -> DataFrame:
    """Damaged ``conversations``, repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repair(damaged(rows), live="live").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(turns, "\n"), 256).alias("repaired_sha256"),
    )


def _oracle() -> str:
    """Row by row instead of run by run: for every state the least (cost, audit) of the rest."""
    c = COSTS
    bytes_of = "flatten(list_transform(string_split(key, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (
        f"xor(list_reduce(list_prepend(4294967295, {bytes_of}::BIGINT[]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) "
        "ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"
    )
    pack = lambda cost, letters, turn, q: (
        f"{{'c': {cost} + f{q}.c, 'a': '{letters}' || f{q}.a, 't': " + (f"list_prepend({turn}, f{q}.t)" if turn else f"f{q}.t") + "}"
    )
    name = {USER: "'user:'", ASSISTANT: "'assistant:'"}
    steps, inserted = [], []
    for q in STATES:
        options = [pack(c.delete, "D", "", q)]
        to = _TURN[q]
        options.append(f"CASE WHEN symbol <> 'x' THEN {pack(f'{c.rerole} + cut', 'R', f'{name[to]} || text', to)} END")
        for initial, moves in _KEPT.items():
            if q in moves:
                options.append(f"CASE WHEN symbol = '{initial}' THEN {pack('cut', 'K', "role || ':' || text", moves[q])} END")
        steps.append(f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL)) AS f{q}")
        one, two = _TURN[q], _TURN[_TURN[q]]
        more = [f"f{q}", pack(c.insert, "I", name[one], one)]
        more.append(f"{{'c': {2 * c.insert} + f{two}.c, 'a': 'II' || f{two}.a, 't': list_concat([{name[one]}, {name[two]}], f{two}.t)}}")
        inserted.append(f"list_min([{', '.join(more)}]) AS f{q}")
    states = ", ".join(f"f{q}" for q in STATES)
    ends = ", ".join(f"{{'c': {_OPEN.get(q, 1 << 40)}::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS f{q}" for q in STATES)
    return rf"""
WITH RECURSIVE c AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, {crc} % 20 AS code FROM c),
d AS (SELECT g, conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM k, (VALUES (1), (2)) AS t(copy) WHERE code <> 0 AND (copy = 1 OR code = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair FROM o),
x AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
r AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS symbol,
    CASE WHEN fault = 'truncated' THEN {c.truncated} ELSE 0 END AS cut FROM x),
s AS (SELECT g, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY g),
e AS (SELECT g, n, {ends} FROM s),
b AS (SELECT g, n AS i, {", ".join(inserted)} FROM e
  UNION ALL
  SELECT g, i, {", ".join(inserted)} FROM (SELECT b.g, b.i - 1 AS i, {", ".join(steps)} FROM b JOIN r ON r.g = b.g AND r.i = b.i)),
names AS (SELECT DISTINCT g, conv_id FROM c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(array_to_string(f0.t, chr(10)), '')) AS repaired_sha256
FROM names LEFT JOIN s USING (g) LEFT JOIN (SELECT g, f0 FROM b WHERE i = 0) AS z USING (g)
"""


ORACLE = _oracle()
