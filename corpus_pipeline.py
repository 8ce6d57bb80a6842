"""A pipeline from raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, is written as Parquet and read again.

Cases: null and empty texts are scored and packed like others (packed, they hold the end token); rows
without an id pass every stage by their text alone; repeated rows are one near-copy group; texts of
any length are read whole; an empty table gives no rows; extra columns, also of clashing names, pass
all stages but the last. Without labels nothing is toxic and, as nothing is trusted, nothing is good.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from natal.llm import near_copies, packing, quality, toxicity
from natal.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", best_fit_packing),
]
#: Boosted trees, a fitted risk and a tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
