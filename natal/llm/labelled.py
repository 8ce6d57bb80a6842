"""Labelled rows to learn from: a bounded sample in three folds that do not overlap.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0. Of these at most
``bound`` rows are taken, those with the smallest hashes of their id and then of their text, so the
choice is the same on any cluster and at any partitioning. Rows of one id count by their different
texts. The bound is a parameter of each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.llm.common import remainder

HELD_OUT_OF = 5


def held_out(doc_id: str = "doc_id"):
    """True where labels must not be learned from; false for a null id."""
    return F.coalesce(remainder(doc_id, HELD_OUT_OF) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label, fold) of at most ``bound`` labelled rows; ``fold`` is 0, 1 or 2.

    Of several labels of one id the largest counts. Equal rows count once, and the bound holds for
    rows also where one id has very many texts. Null ids and null labels are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    # A top-k by hash: each task keeps ``bound`` rows at most, so the ids can be broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(5)).cast("int")
    found = texts_of(docs, chosen)
    rows = rows_picked(found, smallest(found.select("doc_id", "label", "digest").distinct(), bound))
    return rows.select("text", "label", F.when(fold < 2, 0).when(fold < 4, 1).otherwise(2).alias("fold"))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of few ``chosen`` ids, with a hash of the text as ``digest``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").withColumn("digest", F.xxhash64("text"))


def smallest(keys: DataFrame, bound: int, *salt: str) -> DataFrame:
    """The first ``bound`` of different keys by hash; keys hold hashes, no texts."""
    return keys.orderBy(F.xxhash64(*map(F.lit, salt), "doc_id"), "doc_id", "digest").limit(bound)


def rows_picked(found: DataFrame, picked: DataFrame) -> DataFrame:
    """One row of ``found`` for each of the bounded ``picked`` keys."""
    keys = picked.columns
    return found.join(F.broadcast(picked), keys).dropDuplicates(keys)
