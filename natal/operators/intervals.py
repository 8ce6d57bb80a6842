"""Joins of points to validity intervals, such as the years in which a state held a code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from natal.operators.joins import lookup_join

#: Points that intervals tell apart by their bucket; those beyond meet in the first and last one.
DOMAIN = (0, 4096)
BUCKET = 64


def disjoint(intervals: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """``intervals`` with a guard: the job that uses them fails where two of one key overlap.

    A pass in the order of the lower ends compares each with the greatest upper end before it. An
    end that is missing is open.
    """
    before = Window.partitionBy(*keys).orderBy(F.col(low).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    none_before = F.count("*").over(before) == 0
    open_before = F.count(F.when(F.col(high).isNull(), 1)).over(before) > 0
    overlaps = ~none_before & (open_before | F.col(low).isNull() | (F.col(low) <= F.max(high).over(before)))
    shown = F.concat(F.lit("ranges overlap: "), F.to_json(F.struct(*keys, low, high)))
    first = keys[0]
    kind = intervals.schema[first].dataType
    checked = intervals.withColumn("_natal_overlaps", overlaps)
    return checked.withColumn(first, F.when(F.col("_natal_overlaps"), F.raise_error(shown).cast(kind)).otherwise(F.col(first))).drop("_natal_overlaps")


def interval_join(df: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str, how: str = "left") -> DataFrame:
    """Each row with the interval of its key that holds its point; the ends belong to it.

    Intervals are spelled out as buckets of the axis and joined on key and bucket, so this is an
    equi-join of rows that can match, not a product per key. Intervals of a key must not overlap,
    which is checked, so no row is repeated.
    """
    first, last = DOMAIN[0] // BUCKET, DOMAIN[1] // BUCKET

    def bucket(c, missing):
        place = F.floor(F.col(c) / BUCKET).cast("int")
        return F.when(F.col(c).isNull(), F.lit(missing)).otherwise(F.greatest(F.least(place, F.lit(last)), F.lit(first)))

    spelled = (
        disjoint(intervals, keys, low, high)
        .filter(F.col(low).isNull() | F.col(high).isNull() | (F.col(low) <= F.col(high)))
        .withColumn("_natal_bucket", F.explode(F.sequence(bucket(low, first), bucket(high, last))))
    )
    keyed = df.withColumn("_natal_bucket", F.when(F.col(point).isNotNull(), bucket(point, first)))
    # One bucket can hold several short intervals of a key: gather them, so that the join finds one row.
    rest = [c for c in intervals.columns if c not in keys]
    gathered = spelled.groupBy(*keys, "_natal_bucket").agg(F.collect_list(F.struct(*rest)).alias("_natal_ranges"))
    joined = lookup_join(keyed, gathered, [*keys, "_natal_bucket"], "left", grows=last - first + 1)
    p = F.col(point)
    holds = F.filter("_natal_ranges", lambda r: (r[low].isNull() | (r[low] <= p)) & (r[high].isNull() | (p <= r[high])))
    found = joined.withColumn("_natal_one", F.get(holds, F.lit(0)))
    found = found if how == "left" else found.filter(F.col("_natal_one").isNotNull())
    return found.select(*df.columns, *[F.col(f"_natal_one.{c}").alias(c) for c in rest])
