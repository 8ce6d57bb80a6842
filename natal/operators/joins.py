"""Joins of a large fact table to lookups and panels.

Building a join starts no job and keeps no table. Its size decides how a lookup is joined: the sizes of
the files behind it are known from the plan, and a lookup made of few bytes is broadcast. Any other
one is an ordinary equi-join, for which adaptive execution measures both sides when they have been
written for the shuffle: a side that turned out small is broadcast then, and partitions that a heavy key
fills are split. Without adaptive execution heavy keys are split by :func:`salted_join`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most that a broadcast side may hold, and the most that the files behind one may hold, which are
#: packed and lose columns and rows on the way.
BROADCAST_BYTES = 64 * 1024 * 1024
SOURCE_BYTES = BROADCAST_BYTES // 4
#: Items that one frequent-items sketch tracks; beyond that keys are dealt to several by their hash.
SKETCH_ITEMS = 500_000
_HASH, _SPLITS, _SALT = "_natal_hash", "_natal_splits", "_natal_salt"


def literal_table(spark: SparkSession, columns: dict[str, Sequence], schema: str) -> DataFrame:
    """A small rule table; becomes a local relation whose size the planner knows."""
    struct = T._parse_datatype_string(schema)
    arrow = pa.table({k: pa.array(list(v)) for k, v in columns.items()})
    return spark.createDataFrame(arrow).select(
        [F.col(f.name).cast(f.dataType).alias(f.name) for f in struct.fields]
    )


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files and local tables that ``df`` is made of, as the optimised plan knows them.

    A relation of unknown size counts as very large. Filters, aggregates and joins that find one row
    at most do not add to it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fixed_width(schema: T.StructType) -> int | None:
    """Bytes of a row whose columns all have a fixed width; ``None`` where one has not."""
    varying = T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.StructType | T.VariantType
    return None if any(isinstance(f.dataType, varying) for f in schema.fields) else 16 + 8 * len(schema.fields)


def fits_broadcast(lookup: DataFrame, rows: int | None = None, grows: int = 1) -> bool:
    """Whether ``lookup`` is known to be small: by its number of rows of fixed width, or by its sources.

    ``grows`` says how many rows at most a row of the sources turns into.
    """
    width = fixed_width(lookup.schema)
    if rows is not None and width is not None:
        return rows * width <= BROADCAST_BYTES
    return source_bytes(lookup) * grows <= min(SOURCE_BYTES, BROADCAST_BYTES)


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    rows: int | None = None,
    spread: bool = True,
    grows: int = 1,
) -> DataFrame:
    """Join ``fact`` to ``lookup`` on equal column names, ``how`` as seen from ``fact``.

    ``rows`` is the number of rows of the lookup where the caller knows it, ``grows`` how many rows at
    most a row of its sources turns into. ``spread=False`` states that no key of ``fact`` is heavy
    (it was aggregated by that key).
    """
    on = list(on)
    if fits_broadcast(lookup, rows, grows):
        return fact.join(F.broadcast(lookup), on, how)
    conf = fact.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled") == "true" and conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    return salted_join(fact, lookup, on, how) if spread and not adaptive else fact.join(lookup, on, how)


def heavy_keys(df: DataFrame, on: Sequence[str], partitions: int) -> DataFrame:
    """Hashes of keys above half a fair partition share, with the number of splits each needs.

    One pass with frequent-items sketches, so no key is shuffled. At most ``2 * partitions`` keys
    can hold more than half a share. A sketch tracks a bounded number of items; for more partitions
    keys are dealt to several sketches by their hash, each of which sees its share of the rows and of
    the heavy keys, so there is no most number of partitions. The sketches steer the split only; which
    rows come out never depends on them.
    """
    tracked = max(32 * partitions, 1024)
    slices = math.ceil(tracked / SKETCH_ITEMS)
    tracked = min(tracked, SKETCH_ITEMS)
    top = F.expr(f"approx_top_k({_HASH}, {max(tracked // 16, 1)}, {tracked})")
    sketches = (
        df.select(F.xxhash64(*on).alias(_HASH))
        .groupBy(F.pmod(F.shiftright(_HASH, 7), F.lit(slices)).alias("_slice"))
        .agg(top.alias("top"), F.count("*").alias("n"))
    )
    # One row with at most 2 * partitions items, whatever the number of rows.
    whole = sketches.agg(F.flatten(F.collect_list("top")).alias("top"), F.sum("n").alias("n"))
    share = F.greatest(F.col("n") / (2 * partitions), F.lit(1.0))
    items = F.filter("top", lambda i: i["count"] > share)
    return whole.select(F.explode(items).alias("i"), share.alias("share")).select(
        F.col("i.item").alias(_HASH), F.ceil(F.col("i.count") / F.col("share")).cast("int").alias(_SPLITS)
    )


def split_number(columns: Sequence[str], splits: Column) -> Column:
    """Which split a row goes to: a hash of the row and of the input partition it came from.

    The partition tells identical copies apart. Both parts are the same when a task runs
    again after a lost executor, so every row is sent to the same place.
    """
    return F.pmod(F.xxhash64(F.lit(17), F.spark_partition_id(), *columns), splits).cast("int")


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", partitions: int | None = None
) -> DataFrame:
    """Shuffle join in which rows of a heavy left key are spread over several tasks.

    The matching right rows are repeated once per split, so any split number is right.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join keeps left rows; {how!r} is not supported")
    on = list(on)
    partitions = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(left, on, partitions))  # at most 2 * partitions rows of two numbers
    salted_left = (
        left.withColumn(_HASH, F.xxhash64(*on))
        .join(heavy, _HASH, "left")
        .withColumn(_SALT, split_number(left.columns, F.coalesce(_SPLITS, F.lit(1))))
        .drop(_HASH, _SPLITS)
    )
    salted_right = (
        right.withColumn(_HASH, F.xxhash64(*on))
        .join(heavy, _HASH, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_SPLITS, F.lit(1)) - 1)))
        .drop(_HASH, _SPLITS)
    )
    return salted_left.join(salted_right, [*on, _SALT], how).drop(_SALT)


def keep_all_right(
    lookup: DataFrame, fact: DataFrame, left_key: str, right_key: str, rows: int | None = None
) -> DataFrame:
    """Right outer join with differently named keys: every fact row stays.

    The key keeps the lookup's name and the fact's own key column goes.
    """
    return lookup_join(fact.withColumnRenamed(right_key, left_key), lookup, [left_key], "left", rows)


def null_safe_join(fact: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Equi-join in which a missing key matches a missing key."""
    flags = [f"_natal_null_{c}" for c in on]
    types = {f.name: f.dataType for f in fact.schema}

    def filled(df):
        # Any value of the right type serves where the flag says that the key is missing.
        keys_ = {c: F.col(c).try_cast(types[c]) for c in on}
        return df.withColumns(
            {flag: F.col(c).isNull() for flag, c in zip(flags, on)}
            | {f"_natal_key_{c}": F.coalesce(k, F.lit(_ZEROS.get(types[c].typeName(), "0")).cast(types[c])) for c, k in keys_.items()}
            | {f"_natal_odd_{c}": F.col(c).isNotNull() & k.isNull() for c, k in keys_.items()}
        )

    # A lookup key that is no value of the fact's type matches nothing.
    odd = [f"_natal_odd_{c}" for c in on]
    keys = [*flags, *[f"_natal_key_{c}" for c in on], *odd]
    joined = lookup_join(filled(fact), filled(lookup).drop(*on), keys, how, rows)
    return joined.drop(*keys)


#: A value of each type, written as text.
_ZEROS = {"string": "", "date": "1970-01-01", "timestamp": "1970-01-01 00:00:00", "timestamp_ntz": "1970-01-01 00:00:00", "boolean": "false"}


def enrich(fact: DataFrame, cross_sections: Sequence[DataFrame], on: str) -> DataFrame:
    """Left join a chain of country cross-sections."""
    for xs in cross_sections:
        fact = lookup_join(fact, xs, [on], "left")
    return fact


def unmatched(fact: DataFrame, lookup: DataFrame, on: Sequence[str], count: str = "n") -> DataFrame:
    """Keys of ``fact`` without a lookup row, with their row counts.

    Rows are counted per key first, so the anti join sees one row per key.
    """
    counts = fact.groupBy(*on).agg(F.count("*").alias(count))
    return counts.join(lookup.select(*on).distinct(), list(on), "left_anti")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with a guard: the job that uses it fails where ``keys`` repeat, so a join cannot multiply rows unseen.

    The guard is an aggregate by key within the same job.
    """
    rest = [c for c in df.columns if c not in keys]
    shown = F.concat(F.lit(f"keys {list(keys)} repeat: "), F.to_json(F.struct(*keys)))
    counted = df.groupBy(*keys).agg(F.count("*").alias("_natal_n"), *[F.any_value(c).alias(c) for c in rest])
    # The check is part of the first key, so no plan can leave it out.
    checked = F.when(F.col("_natal_n") > 1, F.raise_error(shown).cast(df.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))
    return counted.select(*[checked.alias(c) if c == keys[0] else F.col(c) for c in df.columns])
