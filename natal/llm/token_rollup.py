"""Token counts as delta-maintained rollups.

Counts of documents arrive as signed changes: an insert adds, a delete subtracts, a revision adds
the difference of the counts after and before, also where it moves a document to another source,
language or tokenizer version. A batch of changes is folded to one row per (source, lang,
tokenizer) and committed as a table of its own below the rollup's folder; totals are sums over
the committed batches, so nothing is read and rewritten. A batch is committed by renaming its
finished table into place: a batch id that is there already is skipped, an unfinished table never
counts, and two writers of one id cannot both commit. ``compact`` folds committed batches into
one table that remembers their ids. A hot source is folded in every task before it moves.

Cases: null source, lang or tokenizer is a group of its own; a null token count counts as none; a
null or empty text has no tokens; groups whose documents and tokens are all gone are left out;
repeated documents count as often as they occur; an empty batch can be committed and an empty table
gives empty totals; texts of any length are counted whole; extra columns, also of clashing names, are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from natal.llm import bpe
from natal.llm.common import rows_of, tokenizer_path

KEYS = ("source", "lang", "tokenizer")
_ROLLUP = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def counted(docs: DataFrame, tokenizers: Mapping[str, Column]) -> DataFrame:
    """One row per document and tokenizer version: doc_id, source, lang, tokenizer, tokens."""
    versions = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.coalesce(c, F.lit(0)).cast("bigint").alias("tokens")) for v, c in tokenizers.items()])
    return docs.select("doc_id", "source", "lang", F.explode(versions).alias("v")).select("doc_id", "source", "lang", "v.tokenizer", "v.tokens")


def with_token_counts(docs: DataFrame, texts: Mapping[str, str], path: str | None = None) -> DataFrame:
    """``docs`` with a count of token ids in place of each text column; null stays null.

    ``texts`` names the text column that each added column counts. The ids stay in the worker: only
    their number leaves it.
    """
    path = path or tokenizer_path()
    kept = [f for f in docs.schema if f.name not in {*texts, *texts.values()}]
    schema = StructType([*kept, *[StructField(into, LongType()) for into in texts]])
    names = [f.name for f in kept]

    def run(batches):
        coder = bpe.codec(path)
        for batch in batches:
            counts = [
                pa.array([None if t is None else len(coder.encode(t)) // 4 for t in rows_of(batch, column)], pa.int64())
                for column in texts.values()
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *counts], schema.names)

    return docs.mapInArrow(run, schema)


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add ``rows`` (KEYS, tokens)."""
    return rows.select(*KEYS, F.lit(1).alias("documents"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take ``rows`` away again."""
    return inserts(rows).withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")})


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from the counts ``before`` to the counts ``after`` of the same documents."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Additive totals in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._paths(f"{self.path}/{name}")

    def committed(self) -> list[str]:
        """Names of the tables that count: batches and compacted tables, without those folded in."""
        if not self.fs.exists(self._paths(self.path)):
            return []
        names = {s.getPath().getName() for s in self.fs.listStatus(self._paths(self.path))}
        folded = {n for name in names if name.startswith("upto=") for n in self._folded(name)}
        return sorted(n for n in names if n.startswith(("batch=", "upto=")) and n not in folded)

    def _folded(self, name: str) -> list[str]:
        return [r[0] for r in self.spark.read.text(f"{self.path}/{name}/folded").collect()]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Fold and commit a batch; False if this id was committed before."""
        name = f"batch={batch_id}"
        done = self.fs.exists(self._at(name)) or any(name in self._folded(n) for n in self.committed() if n.startswith("upto="))
        if done:
            return False
        spare = f".{name}-{uuid.uuid4().hex}"
        folded = changes.groupBy(*KEYS).agg(F.sum("documents").cast("bigint").alias("documents"), F.sum("tokens").cast("bigint").alias("tokens"))
        folded.filter("documents <> 0 or tokens <> 0").write.parquet(f"{self.path}/{spare}/data")
        return self._publish(spare, name)

    def _publish(self, spare: str, name: str) -> bool:
        """Rename into place. A rename onto a folder moves into it, so the outcome is looked at."""
        moved = self.fs.rename(self._at(spare), self._at(name)) and not self.fs.exists(self._at(f"{name}/{spare}"))
        if not moved:
            self.fs.delete(self._at(f"{name}/{spare}"), True)
            self.fs.delete(self._at(spare), True)
        return bool(moved)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches."""
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], _ROLLUP)
        rows = self.spark.read.schema(_ROLLUP).parquet(*[f"{self.path}/{n}/data" for n in names])
        summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Fold the committed tables into one that replaces them."""
        names = self.committed()
        if len(names) < 2:
            return False
        name = f"upto={uuid.uuid4().hex}"
        spare = f".{name}"
        self.totals().write.parquet(f"{self.path}/{spare}/data")
        earlier = [n for name_ in names if name_.startswith("upto=") for n in self._folded(name_)]
        listed = self.spark.createDataFrame([(n,) for n in sorted({*names, *earlier})], "name string")
        listed.coalesce(1).write.text(f"{self.path}/{spare}/folded")
        return self._publish(spare, name)
