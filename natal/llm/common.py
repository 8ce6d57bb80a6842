"""Small helpers that the text operators share: tables, written cuts, Arrow loops."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from natal.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Default tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batch: pa.RecordBatch, column: str, step: int = 128) -> Iterator:
    """Values of a column, turned into Python objects a few rows at a time."""
    values = batch.column(column)
    for at in range(0, len(values), step):
        yield from values.slice(at, step).to_pylist()


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): every column of a row in one struct, so that no added column can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))


def extended(df: DataFrame, keep: tuple[str, ...], **added) -> StructType:
    """The schema of the columns ``keep`` of ``df`` and of those added."""
    return StructType([df.schema[c] for c in keep] + [StructField(n, t) for n, t in added.items()])
