"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Three folds of a bounded labelled sample serve one step each: the first gives the lexicons (words
and word beginnings whose use goes with the label), the second the trees, the third the
calibration. So no step judges rows that an earlier one has seen. Scoring reads every text once.

Features per text: density, number and strength of lexicon words and of lexicon beginnings, hits
near a word of address, density of words of address, shares of capitals, punctuation, exclamation
marks and digits, rate of words with disguised letters, hits only after undoing disguises, length.

Cases: null and empty texts have all features zero and are scored by the model; a sample without
both labels gives every row the sample's share of label 1 (0 without a sample); null and repeated
ids keep their rows; equal texts have equal scores, and of several labels of one id the largest counts;
texts of any length are read whole; an empty table gives no rows; extra columns, also of clashing
names, are ignored by scores and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from natal.llm.common import extended, packed, rows_of, written
from natal.llm.labelled import held_out, sample

#: Labelled rows to learn from, at most.
SAMPLE = 30_000
#: Entries kept per lexicon, at most.
LEXICON = 3_000
#: Lengths of the word beginnings that the second lexicon holds.
STEMS = (4, 5, 6)
THRESHOLD = 0.5
NEAR = 5

#: Words of address in English, German, French and Spanish.
ADDRESS = frozenset(
    "you your yours yourself ya u ur du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tus vosotros vos contigo".split()
)
#: Characters that stand for letters in disguised words.
DISGUISES = bytes.maketrans(b"013457@$!|", b"oieastasil")
_DISGUISED = re.compile(rb"[a-z\x80-\xff][0-9@$!|*._-]+[a-z\x80-\xff]")
#: Everything in ASCII that is no letter parts words, for the plain and the undisguised reading.
_PARTED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
FEATURES = 16


@dataclass(frozen=True)
class Lexicon:
    words: dict[bytes, float]
    stems: dict[bytes, float]

    def readers(self):
        """Value per word, worked out once for each: (word value, beginning value)."""
        words, stems = self.words, self.stems

        class Kept(dict):
            def __init__(self, value):
                super().__init__()
                self.value = value

            def __missing__(self, word):
                if len(self) >= 400_000:
                    self.clear()
                v = self[word] = self.value(word)
                return v

        def stem(word):
            text = word.decode("utf-8", "ignore")
            return max((stems.get(text[:n].encode(), 0.0) for n in STEMS if len(text) >= n), default=0.0)

        return Kept(lambda w: words.get(w, 0.0)), Kept(stem)


def _words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_PARTED).split()


def features(text: str | None, by_word, by_stem, address=frozenset(w.encode() for w in ADDRESS)) -> list[float]:
    """The dense features of one text."""
    if not text:
        return [0.0] * FEATURES
    low = text.lower().encode()
    words = low.translate(_PARTED).split()
    n = max(1, len(words))
    values = list(map(by_word.__getitem__, words))
    stems = list(map(by_stem.__getitem__, words))
    hits, stem_hits = [i for i, v in enumerate(values) if v] if any(values) else [], sum(1 for v in stems if v) if any(stems) else 0
    near = 0
    if hits:
        near = sum(1 for i in hits if not address.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    disguised = len(_DISGUISED.findall(low))
    undone = 0
    if disguised:
        undone = sum(map(bool, map(by_word.__getitem__, low.translate(DISGUISES).translate(_PARTED).split()))) - len(hits)
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    signs = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    size = len(raw)
    return [
        sum(values) / n,
        math.log1p(len(hits)),
        max(values, default=0.0),
        sum(stems) / n,
        math.log1p(stem_hits),
        max(stems, default=0.0),
        math.log1p(near),
        sum(map(address.__contains__, words)) / n,
        upper / max(1, upper + lower),
        signs / size,
        int(counts[33]) / size,
        digits / size,
        disguised / n,
        math.log1p(max(0, undone)),
        math.log1p(len(words)),
        size / n,
    ]


def lexicon(rows: DataFrame, keep: int = LEXICON) -> Lexicon:
    """Words and word beginnings that go with label 1, with the log odds of their use."""
    parted = F.split(F.lower("text"), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")
    words = rows.select("label", F.explode(F.array_distinct(parted)).alias("word")).filter("word <> ''")
    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)

    def best(units: DataFrame) -> dict[bytes, float]:
        counted = units.groupBy("unit").agg(F.sum("label").alias("one"), F.sum(1 - F.col("label")).alias("zero"))
        odds = F.log((F.col("one") + 0.5) / (ones + 1)) - F.log((F.col("zero") + 0.5) / (zeros + 1))
        # How far the share of label 1 stands above chance, in standard errors.
        error = F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
        found = counted.withColumns({"odds": odds, "z": odds / error}).filter("one >= 4 and odds > 2 and z > 3")
        top = found.orderBy(F.desc("z"), "unit").limit(keep).select("unit", "odds").collect()
        return {r["unit"].encode(): float(r["odds"]) for r in top}

    beginnings = [
        words.filter(F.length("word") >= n).select("label", F.substring("word", 1, n).alias("unit")) for n in STEMS
    ]
    stems = beginnings[0]
    for b in beginnings[1:]:
        stems = stems.unionByName(b)
    return Lexicon(best(words.withColumnRenamed("word", "unit")), best(stems))


def featured(df: DataFrame, words: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and ``features`` (array of doubles) for every row with a ``text``."""

    def run(batches):
        by_word, by_stem = words.readers()
        for batch in batches:
            rows = np.array([features(t, by_word, by_stem) for t in rows_of(batch, "text")], dtype=float).reshape(-1, FEATURES)
            offsets = pa.array(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "features"])

    return df.select(*keep, "text").mapInArrow(run, extended(df, keep, features=ArrayType(DoubleType())))


@dataclass
class Model:
    """What scoring needs; ``trees`` is None where the sample lacks one of the labels."""

    words: Lexicon
    share: float
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None

    def score(self, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """``keep`` and ``score`` for every row of ``df``."""
        rows = featured(df, self.words, keep)
        if self.trees is None:
            return rows.select(*keep, F.lit(self.share).alias("score"))
        raw = self.trees.transform(rows.withColumn("vector", array_to_vector("features")))
        raw = raw.select(*keep, vector_to_array("probability")[1].alias("raw"))
        if self.steps is None:
            return raw.withColumnRenamed("raw", "score")
        return self.steps.transform(raw).select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Learn lexicons, trees and calibration from at most ``bound`` labelled rows."""
    rows = written(sample(docs, labels, label, bound), "toxicity-sample")
    totals = {(r[0], r[1]): r[2] for r in rows.groupBy("fold", "label").count().collect()}
    known = sum(totals.values())
    share = sum(n for (_, y), n in totals.items() if y == 1) / known if known else 0.0
    words = lexicon(rows.filter("fold = 0"))
    if not (totals.get((1, 0)) and totals.get((1, 1))):
        return Model(words, share)
    learned = written(featured(rows, words, ("label", "fold")).coalesce(4), "toxicity-features")
    learned = learned.withColumn("vector", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", predictionCol="class", maxIter=16, maxDepth=3, stepSize=0.3, seed=7
    ).fit(learned.filter("fold = 1"))
    model = Model(words, share, trees)
    if totals.get((2, 0)) and totals.get((2, 1)):
        rest = trees.transform(learned.filter("fold = 2")).select("label", vector_to_array("probability")[1].alias("raw"))
        model.steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(rest)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The query's columns for every document."""
    scored = fit(docs, labels, bound=bound).score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ("doc_id",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    return fit(docs, labels, bound=bound).score(packed(docs), ("row",)).filter(F.col("score") < threshold).select("row.*")
