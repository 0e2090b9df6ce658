"""Chat formatting by relational means: sort turn structs, merge neighbours, concatenate.

The template::

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

Adjacent turns of one role become one message whose texts are joined by ``<|im_next|>``, so
that every turn can be read back. Control strings inside roles and texts (the template's own
and those of common other templates) get a backslash after their first character, one more
than they already have; taking one away restores the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: A control string after its first character and any backslashes.
_REST = r"(\||/?s>|/?INST\]|</?SYS>>)"
_PLAIN = r"([<\[])(\\*)" + _REST
_ESCAPED = r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(rows: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``segments``.

    ``segments`` are (text, loss) structs whose texts, concatenated, are ``formatted``; the loss
    mask covers those with ``loss``, the escaped texts of the role ``learn_from``. Rows are
    ordered by turn, null first; rows of one turn by role, then text, and repeated rows stay. A
    null role or text is empty, a null ``conv_id`` is a conversation of its own. Other columns
    are ignored. A conversation is one output value, so it must fit one row.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Positions where a run of one role begins, and the end of each run.
    first = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    df = _once(df, ["conv_id", "turns"], "begins", first)

    def message(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("begins", k + 1), F.size("turns"))
        run = F.slice("turns", begin + 1, end - begin)
        role = F.get("turns", begin)["role"]
        loss = role == learn_from
        texts = F.flatten(F.transform(run, lambda t, j: F.array(
            _segment(F.when(j == 0, F.lit("")).otherwise(F.lit(NEXT)), F.lit(False)),
            _segment(escape(t["text"]), loss),
        )))
        head = _segment(F.concat(F.lit(START), escape(role), F.lit(SEP)), F.lit(False))
        return F.concat(F.array(head), texts, F.array(_segment(F.lit(END), F.lit(False))))

    df = _once(df, ["conv_id"], "segments", F.flatten(F.transform("begins", message)))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return df.select("conv_id", joined.alias("formatted"), "segments")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _once(df: DataFrame, keep: list[str], name: str, made: Column) -> DataFrame:
    return df.select(*keep, F.explode(F.array(made)).alias(name))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns parsed from ``formatted``: the columns and ``turns``, structs of role and text."""
    messages = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda m: m != "")

    def parsed(message: Column) -> Column:
        role = F.substring_index(message, SEP, 1)
        body = F.substring_index(F.substring(message, F.length(role) + len(SEP) + 1, 2**31 - 1), END, 1)
        texts = F.split(body, r"<\|im_next\|>", -1)
        return F.transform(
            texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text"))
        )

    return _once(formatted, formatted.columns, "turns", F.flatten(F.transform(messages, parsed)))


def op3(spark, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations, and one conversation of control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    df = read_back(format_conversations(rows.unionByName(extra)))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # Neighbouring segments may not merge into a control string, so each is restored by itself.
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    df = df.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(told, "").alias("told"), F.explode(F.array(F.array_join(learnt, ""))).alias("learnt"),
        "formatted",
    )
    return df.select(
        "conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
  regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS erole,
  regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS etext
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN before IS DISTINCT FROM role OR k = 1 THEN 12 + length(erole) + 10 + 10 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
