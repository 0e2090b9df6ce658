"""Secret scans over an incremental blob ledger.

A blob is the content of one version of one path, addressed by its SHA-256. The ledger holds
what each (blob, rule version) pair was found to contain; a scan reads only blobs that lack a
pair, each content once however many paths and versions carry it, and evaluates only the rules
that are missing. Findings are joined back to every path and version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.plans.pinning import pin

_ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)"
)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are the base; a changed rule gets a new version and is scanned anew.
RULES = (
    Rule("assign", 1, _ASSIGN, group=1, least=8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", 1, r"[0-9a-f]{32,}", least=32),
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def spans_of(text: Column, rule: Rule, wanted: Column) -> Column:
    """Spans of the rule's matches in code points, end exclusive; null where not ``wanted``.

    The k-th match starts after k+1 pieces between matches and k matches.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    lengths = F.arrays_zip(
        F.transform(between, lambda p: F.length(p).cast("bigint")).alias("gap"),
        F.transform(whole, lambda m: F.length(m).cast("bigint")).alias("n"),
        F.transform(inner, lambda m: F.length(m)).alias("inner"),
    )
    empty = F.array().cast(SPANS)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"))
        found = F.when(x["inner"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct((start + F.coalesce(x["n"], F.lit(0))).alias("at"), found.alias("out"))

    spans = F.aggregate(lengths, begin, step, lambda s: s["out"])
    return F.when(wanted, F.when(text.rlike(rule.pattern), spans).otherwise(empty))


def scan(
    versions: DataFrame, keys: Sequence[str], ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES
) -> tuple[DataFrame, DataFrame]:
    """New ledger rows, and the findings of every row of ``versions``.

    ``versions`` has the ``keys`` (path, version, ...) and ``text``; a null text is empty. The
    ledger has ``blob``, ``rule`` and ``spans`` (kind, start, end in code points); the returned
    rows extend it, one per scanned pair, findings or not. Findings have the keys, ``blob``
    and ``spans`` by start, then kind in rule order. Repeated rows keep their findings each, an
    empty table gives none, and other columns are ignored.

    The new ledger rows are written to the shared folder once, so texts are scanned once.
    """
    named = [r.key for r in rules]
    text = F.coalesce(F.col("text"), F.lit(""))
    addressed = versions.select(*keys, F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    # One text per content; each task first reduces its own rows to one per content.
    blobs = addressed.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin(named)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    missing = lambda key: ~F.coalesce(F.array_contains("seen", key), F.lit(False))
    columns = [spans_of(F.col("text"), r, missing(r.key)).alias(f"r{i}") for i, r in enumerate(rules)]
    pairs = F.filter(
        F.array(*[F.struct(F.lit(r.key).alias("rule"), F.col(f"r{i}").alias("spans")) for i, r in enumerate(rules)]),
        lambda p: p["spans"].isNotNull(),
    )
    fresh = pin(blobs.select("blob", *columns).select("blob", F.inline(pairs)), "secret_ledger")
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule").isin(named)))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("span.kind"))
    ordered = F.array_sort(F.collect_list(F.struct("span.start", rank.alias("rank"), "span.end", "span.kind")))
    found = known.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("span"))
    found = found.groupBy("blob").agg(ordered.alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    paths = addressed.select(*keys, "blob").join(found, "blob", "left")
    return fresh, paths.select(*keys, "blob", F.coalesce(spans, F.array().cast(SPANS)).alias("spans"))


def scan_deliveries(
    deliveries: Sequence[DataFrame], keys: Sequence[str], ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES
) -> tuple[DataFrame, DataFrame]:
    """:func:`scan` of one delivery of versions after another, each with the ledger so far.

    Content that an earlier delivery brought is not scanned again. Returns the rows to add to
    ``ledger``, and the findings of every row of every delivery. An empty delivery adds nothing.
    """
    added = findings = None
    for versions in deliveries:
        fresh, found = scan(versions, keys, ledger, rules)
        ledger = fresh if ledger is None else ledger.unionByName(fresh)
        added = fresh if added is None else added.unionByName(fresh)
        findings = found if findings is None else findings.unionByName(found)
    return added, findings


def older_and_newer(docs: DataFrame, key: str) -> list[DataFrame]:
    """All rows in two deliveries: up to the (approximate) middle key, with null keys, and beyond."""
    middle = docs.agg(F.percentile_approx(key, 0.5).alias("m")).first()["m"]
    newer = F.coalesce(F.col(key) > F.lit(middle), F.lit(False))
    return [docs.where(~newer), docs.where(newer)]


def told(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op9(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document, delivered in two halves by id; a document is a version of its id.

    The second half meets the ledger of the first: copies of its contents are known there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, found = scan_deliveries(older_and_newer(docs, "doc_id"), ["doc_id"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """The same spans in DuckDB SQL; its engine needs no possessive quantifiers."""
    quoted = lambda p: "'" + p.replace("}+", "}").replace("'", "''") + "'"
    rows = ", ".join(f"({i}, '{r.kind}', {quoted(r.pattern)}, {r.least})" for i, r in enumerate(RULES))
    n = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in BASE)
    span = "kind || ':' || start || ':' || stop"
    base = ", ".join(f"'{k}'" for k in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rules(place, kind, pattern, least) AS (VALUES {rows}),
m AS (SELECT r, place, kind, least, regexp_extract_all(t, pattern) AS w, string_split_regex(t, pattern) AS p,
    CASE WHEN kind = 'assign' THEN regexp_extract_all(t, {quoted(_ASSIGN)}, 1) ELSE regexp_extract_all(t, pattern) END AS g FROM d, rules),
u AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
s AS (SELECT r, place, kind, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start,
    length(w[i]) AS n FROM u WHERE length(g[i]) >= least),
e AS (SELECT *, start + n AS stop FROM s)
SELECT doc_id, {n}, sha256(coalesce(string_agg({span}, ',' ORDER BY start, place) FILTER (kind IN ({base})), '')) AS base_sha256,
    coalesce(string_agg({span}, ',' ORDER BY start, place) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN e USING (r) GROUP BY r, doc_id
"""


ORACLE = _oracle()
