"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a named, versioned mask over these bits. Verdicts of any policy and
ablations (what would a policy without one rule keep?) come from the ledger by bit operations
alone; the texts are not read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.llm.common import SPACE, fixed, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements holds."""

    name: str
    fails: str


#: The position of a rule is its bit; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
)


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in names)


#: Policies by version; a published version never changes.
POLICIES: dict[str, int] = {
    "base": mask_of(["few_words", "repeated_windows"]),
    "v1": mask_of([r.name for r in RULES]),
}


def measured(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measurements of every whole text, each a bigint.

    A null text has no words. Windows of three words are compared as text, so counts are exact.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    count = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    df = fixed(
        docs, keep,
        _w=words(F.col(f"`{text}`")), _lines=lines,
        n_symbols=count(r"[^#*$%&|<>]+").cast("bigint"),
        n_capitals=count(r"\P{Lu}+").cast("bigint"),
    )
    kept = [*keep, "n_symbols", "n_capitals"]
    df = fixed(
        df, kept,
        n_words=F.size("_w").cast("bigint"),
        word_chars=F.length(F.array_join("_w", "")).cast("bigint"),
        n_lines=F.size("_lines").cast("bigint"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        _g=F.when(
            F.size("_w") >= 3,
            F.transform(
                F.slice("_w", 1, F.size("_w") - 2),
                lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    kept += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    # Equal windows side by side, each with its position; nothing to sort without repeats.
    ordered = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    df = fixed(df, kept, _o=F.when(repeats, ordered).otherwise(F.slice(ordered, 1, 0)))

    def twin(x: Column, k: Column) -> Column:
        same = lambda other: F.coalesce(F.get("_o", other)["g"] == x["g"], F.lit(False))
        return F.when(same(k - 1) | same(k + 1), x["i"])

    df = fixed(df, kept, _p=F.sort_array(F.filter(F.transform("_o", twin), lambda i: i.isNotNull())))
    # A repeated window covers three words, or as many as there are before the next one.
    covered = F.transform("_p", lambda p, k: F.least(F.coalesce(F.get("_p", k + 1) - p, F.lit(3)), F.lit(3)))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return df.select(*[F.col(f"`{k}`") for k in kept], total.alias("n_repeat_words"))


def failures(rules: Sequence[Rule] = RULES) -> Column:
    """Bits of the failed rules."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("bigint")


def quality_ledger(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES
) -> DataFrame:
    """One row per document: ``keep``, the measurements and ``failed_bits``.

    Null and empty texts have no words and fail ``few_words``. Rows are never merged, so
    repeated rows give repeated ledger rows; an empty table gives an empty ledger. Columns of
    the input outside ``keep`` are ignored, whatever their names.
    """
    return measured(docs, text, keep).withColumn("failed_bits", failures(rules))


def kept_by(policy: str, policies: Mapping[str, int] = POLICIES) -> Column:
    """Whether a ledger row passes every rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policies[policy])) == 0


def ablation(
    ledger: DataFrame, policy: str, policies: Mapping[str, int] = POLICIES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Per rule of the policy: documents failing it, and documents only it rejects.

    Ledger rows are first counted per bit pattern (at most 2^rules rows leave each task).
    """
    mask = policies[policy]
    used = [(r.name, 1 << i) for i, r in enumerate(rules) if mask >> i & 1]
    patterns = ledger.select(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).groupBy("bits").count()
    sums = []
    for name, bit in used:
        sums += [
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("count")).otherwise(0)).alias(f"fail_{name}"),
            F.sum(F.when(F.col("bits") == bit, F.col("count")).otherwise(0)).alias(f"only_{name}"),
        ]
    table = ", ".join(f"'{n}', coalesce(fail_{n}, 0), coalesce(only_{n}, 0)" for n, _ in used)
    return patterns.agg(*sums).select(F.expr(f"stack({len(used)}, {table}) AS (rule, n_failed, n_only)"))


def filter_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    carried = fixed(docs, [], _row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), _text=F.col("text"))
    ledger = quality_ledger(carried, "_text", ["_row"])
    return ledger.where(kept_by(policy)).select("_row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    """Ledger of ``documents`` under policy ``v1``."""
    ledger = quality_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept_by("base")).alias("base_failed"), kept_by("v1").alias("kept"),
        "n_lines", "n_capitals", "failed_bits",
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(i := i, g := w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS s FROM w),
k AS (SELECT r, s.i AS i, count(*) OVER (PARTITION BY r, s.g) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM k, (VALUES (0), (1), (2)) AS t(o) WHERE k.n > 1 GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(w.lines) - len(list_distinct(w.lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(w.lines) AS BIGINT) AS n_lines, CAST(length(regexp_replace(w.text, '\P{Lu}+', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * word_chars)::INT
  + 8 * (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (100 * n_capitals > 40 * word_chars)::INT
  + 32 * (word_chars > 20 * n_words OR word_chars < 2 * n_words)::INT AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
  failed_bits = 0 AS kept, n_lines, n_capitals, failed_bits FROM f
"""
