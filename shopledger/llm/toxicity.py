"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels are learned from, never looked at otherwise: rows whose crc32(doc_id as text) mod 5 is 0
are held out, those with remainder 1 calibrate, the others fit a lexicon and the trees. The
lexicon holds the words and stems of words most typical of toxic documents. What the trees see of a text
are rates only: density and number of lexicon words, how near the second person stands to
them, capitals, punctuation, obfuscated spellings, lengths.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.plans.pinning import pin
from shopledger.plans.shipping import ship

#: At most so many labelled rows fit lexicon and trees, those of the least md5(doc_id).
FIT_ROWS = 20_000
#: Entries of the lexicon: words, and stems (beginnings of words) of these lengths.
LEXICON_ENTRIES, STEMS = 300, (4, 5, 6, 7, 8)
#: An entry is in so many labelled toxic documents, and in this share of them, with these log odds.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_ODDS = 4, 0.015, 1.5
TREES, DEPTH = 30, 4
FEATURES = (
    "log_words", "lexicon_rate", "lexicon_hits", "weight_rate", "weight_sum", "weight_max", "weight_third",
    "second_person_rate", "person_near_lexicon", "capital_rate", "capital_words", "exclamations",
    "punctuation_rate", "obfuscation_rate", "obfuscated_hits", "word_length", "distinct_share",
)
#: Second persons of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos"
    " tú ti tus usted ustedes vosotros os".split()
)
#: Characters written for letters.
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_DISGUISE = re.compile(r"[^\W\d_][0-9@$!|*.\-_]+[^\W\d_]|[0-9@$][^\W\d_]{2}")
_MARKS = re.compile(r"[!?.,;:*#%&$|]")
_NEAR = 5
#: Words that a task remembers at once.
REMEMBERED = 300_000


def plain_word(word: str) -> str:
    return _EDGE.sub("", word.lower())


def revealed(word: str) -> str:
    """The word without its disguise: substituted letters, letters set apart, stretched letters."""
    bare = unicodedata.normalize("NFKC", word).lower().strip(".,;:?\"'()[]").translate(_LEET)
    return re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W_]+", "", bare))


def entries(word: str) -> list[str]:
    """The lexicon entries that a plain word may match: itself, and its stems with a star."""
    return [word, *[f"{word[:k]}*" for k in STEMS if len(word) >= k]] if len(word) > 1 else []


class WordTable(dict):
    """Number of each word met, and by number what the features need to know of it."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.beginnings = {e[:4] for e in lexicon}
        self.new: list[tuple[float, int, int, int, int, int, int, int]] = []
        self.filled, self.table = 0, np.empty((1024, 8))

    def weight(self, plain: str) -> float:
        if plain[:4] not in self.beginnings:
            return 0.0  # neither the word nor a stem of it can be an entry
        return max((self.lexicon.get(e, 0.0) for e in entries(plain)), default=0.0)

    def __missing__(self, word: str) -> int:
        plain = plain_word(word)
        weight, odd, hidden = self.weight(plain), 0, 0
        if not word.isalpha() and _DISGUISE.search(word):
            odd = 1
            if not weight and (weight := self.weight(revealed(word))):
                hidden = 1
        upper = 0 if word.islower() else sum(map(str.isupper, word))
        marks = 0 if word.isalpha() else len(_MARKS.findall(word))
        shout = int(len(word) > 1 and word.isupper())
        self.new.append((weight, plain in SECOND_PERSON, odd, hidden, upper, shout, marks, word.count("!")))
        number = self[word] = self.filled + len(self.new) - 1
        return number

    def known(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words, and a row of facts for each."""
        if self.filled > REMEMBERED:
            self.clear()
            self.filled = 0
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            filled = self.filled + len(self.new)
            if filled > len(self.table):  # doubled, so that rows are copied a few times at most
                larger = np.empty((2 * filled, 8))
                larger[: self.filled] = self.table[: self.filled]
                self.table = larger
            self.table[self.filled : filled] = self.new
            self.filled, self.new = filled, []
        return numbers, self.table


def features(text: str | None, table: WordTable) -> list[float]:
    """The features of a whole text; all zero without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    numbers, facts = table.known(words)
    own = facts[numbers]
    weight = own[:, 0]
    hits = np.flatnonzero(weight)
    sums = own[:, 1:].sum(axis=0).tolist()
    persons, odd, hidden, upper, shout, marks, cries = sums
    near = 0.0
    if persons and len(hits):
        at = np.flatnonzero(own[:, 1])
        k = np.searchsorted(at, hits)
        before, after = np.abs(hits - at[np.maximum(k - 1, 0)]), np.abs(at[np.minimum(k, len(at) - 1)] - hits)
        near = float((np.minimum(before, after) <= _NEAR).mean())
    # Distinct entries count: a repeated word is one piece of evidence.
    best = np.sort(facts[:, 0][np.unique(numbers[hits])])[::-1] if len(hits) else np.zeros(1)
    letters = float(sum(map(len, words)))
    return [
        float(np.log1p(n)), len(hits) / n, float(np.log1p(len(hits))), float(weight.sum()) / n,
        float(best.sum()), float(best[0]), float(best[2]) if len(best) > 2 else 0.0,
        persons / n, near, upper / letters, shout / n, cries / n, marks / letters, odd / n,
        float(np.log1p(hidden)), letters / n, len(np.unique(numbers)) / n,
    ]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 (held out) for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """``doc_id, text, label, fold`` of at most ``most`` labelled rows outside the held-out fifth.

    An id with several labels counts as toxic if any of them is; rows without a label are not
    used. The rows are those of the least md5 of their id, so reruns agree. Only ``most`` ids with
    two numbers each are broadcast; no text moves.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.max("toxic").cast("double").alias("label"), F.md5(F.first("doc_id").cast("string").cast("binary")).alias("place"))
    known = known.withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 0")
    known = known.orderBy("place", "doc_id").limit(most).select("doc_id", "label", "fold")
    return docs.select("doc_id", "text").join(F.broadcast(pin(known, "toxic_known")), "doc_id")


def _entry_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, toxic, other): documents with the entry, summed within each batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label < 0.5].update({e for w in set((text or "").split()) for e in entries(plain_word(w))})
        names = list(counts[0])  # entries of other documents only can't be typical of toxic ones
        columns = [pa.array(names, pa.string()), *[pa.array([c[e] for e in names], pa.int64()) for c in counts]]
        yield pa.record_batch(columns, ["entry", "toxic", "other"])
        rest = [e for e in counts[1] if e not in counts[0]]
        zeros = pa.array([0] * len(rest), pa.int64())
        columns = [pa.array(rest, pa.string()), zeros, pa.array([counts[1][e] for e in rest], pa.int64())]
        yield pa.record_batch(columns, ["entry", "toxic", "other"])


def learn_lexicon(rows: DataFrame, most: int = LEXICON_ENTRIES) -> dict[str, float]:
    """Entries typical of toxic documents with their log odds; at most ``most`` reach the driver."""
    n = rows.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")).first()
    toxic, other = n["toxic"] or 0.0, n["other"] or 0.0
    counts = rows.select("text", "label").mapInArrow(_entry_counts, "entry string, toxic bigint, other bigint")
    counts = counts.groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (other + 1.0))
    enough = F.col("a") >= max(LEAST_DOCUMENTS, LEAST_SHARE * toxic)
    rated = counts.where(enough).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    # Of the typical entries the most frequent ones: rare ones are typical by chance.
    best = rated.orderBy((F.col("a") * F.col("odds")).desc(), "entry").limit(most).collect()
    return {r["entry"]: r["odds"] for r in best}


def featured(docs: DataFrame, keep: Sequence[str], lexicon: dict[str, float]) -> DataFrame:
    """``keep`` and ``features`` (array of doubles) of every whole text."""
    kept = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept")
    df = docs.select(kept, "text")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(lexicon)
        for batch in batches:
            made = [features(t, table) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("kept"), pa.array(made, pa.list_(pa.float64()))], ["kept", "features"])

    schema = f"kept {df.schema['kept'].dataType.simpleString()}, features array<double>"
    return df.mapInArrow(rows, schema).select("kept.*", "features")


def train(
    docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS
) -> tuple[dict[str, float], GBTClassificationModel | None, IsotonicRegressionModel | None, float]:
    """Lexicon, trees, calibration and the share of toxic rows.

    Trees or calibration are None where the rows have one label only or there are none.
    """
    ship(docs.sparkSession)
    rows = pin(training_rows(docs, labels, most), "toxic_rows")
    lexicon = learn_lexicon(rows.where("fold <> 1"))
    data = featured(rows, ["doc_id", "label", "fold"], lexicon)
    data = pin(data, "toxic_features")
    base = data.agg(F.avg("label")).first()[0]
    data = data.withColumn("vector", array_to_vector("features"))
    fit, rest = data.where("fold <> 1"), data.where("fold = 1")
    if fit.select("label").distinct().count() < 2:
        return lexicon, None, None, base or 0.0
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7,
        predictionCol="guess", minInstancesPerNode=5,
    ).fit(fit)
    if rest.isEmpty():
        return lexicon, trees, None, base
    odds = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("p"))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(odds)
    return lexicon, trees, isotonic, base


def scored(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",), most: int = FIT_ROWS) -> DataFrame:
    """``keep``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every whole text.

    Null and empty texts get the score of a text without features. Without usable labels every
    score is the share of toxic labels (0 without any). Repeated rows each get their score;
    other columns are ignored. A score blends the calibrated probability with a hundredth of
    the trees' own, so that documents of one calibration step keep their order.
    """
    lexicon, trees, isotonic, base = train(docs, labels, most)
    df = featured(docs, list(dict.fromkeys(["doc_id", *keep])), lexicon)
    if trees is None:
        score = F.lit(float(base))
    else:
        df = trees.transform(df.withColumn("vector", array_to_vector("features")))
        df = df.withColumn("p", vector_to_array("probability")[1])
        score = F.col("p")
        if isotonic is not None:
            df = isotonic.transform(df)
            score = 0.99 * F.col("calibrated") + 0.01 * F.col("p")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    df = df.select(*keep, (remainder(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"))
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
