"""Country-year panels: reshape, average, splice and check."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.functions.columns import mean, to_number
from natal.functions.names import period_name
from natal.operators.intervals import interval_join
from natal.operators.joins import literal_table, lookup_join
from natal.rules import Splice


def period_mean(
    panel: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str],
    start: int,
    end: int,
    lagged: bool = False,
    year: str = "year",
) -> DataFrame:
    """Mean of each variable per entity over ``start..end``; one row per entity.

    ``lagged`` renames the results to ``lagged_<variable>_<yy><yy>``.
    """
    means = [mean(v).alias(period_name(v, start, end) if lagged else v) for v in variables]
    return panel.filter(F.col(year).between(start, end)).groupBy(*keys).agg(*means)


def wide_to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Turn value columns into rows; missing cells stay as rows."""
    return df.unpivot(list(ids), [F.col(f"`{c}`").alias(c) for c in columns], name, value)


def split_name(df: DataFrame, column: str, into: Sequence[str], sep: str = "/") -> DataFrame:
    """Split a text column into parts and drop it; a part that is absent gives null."""
    parts = F.split(F.col(column), f"[{sep}]")
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(into)}).drop(column)


def annual_mean(monthly: DataFrame, entity: Sequence[str], value: str, result: str) -> DataFrame:
    """Monthly rows to one row per entity and year, missing months ignored."""
    return monthly.withColumn("year", to_number("year", "int")).groupBy(*entity, "year").agg(mean(value).alias(result))


def splice(
    panel: DataFrame,
    rules: Iterable[Splice],
    entity: str = "country",
    year: str = "year",
    code: str = "cowcode",
) -> DataFrame:
    """Let predecessor and successor states share one code over disjoint years.

    An entity may have several ranges, each with its own code; ranges of one entity that overlap
    make the job fail. Rows outside all ranges of an entity that has some go; an entity without a
    rule is untouched.
    """
    rules = list(rules)
    table = literal_table(
        panel.sparkSession,
        {
            entity: [r.entity for r in rules],
            "_from": [r.keep_from for r in rules],
            "_to": [r.keep_to for r in rules],
            "_code": [r.code for r in rules],
        },
        f"{entity} string, _from int, _to int, _code int",
    ).withColumn("_inside", F.lit(True))
    ruled = table.select(entity).distinct().withColumn("_ruled", F.lit(True))
    code_type = panel.schema[code].dataType
    return (
        interval_join(lookup_join(panel, ruled, [entity], "left"), table, [entity], year, "_from", "_to")
        .filter(F.col("_ruled").isNull() | F.col("_inside"))
        .withColumn(code, F.coalesce(F.col("_code").cast(code_type), F.col(code)))
        .select(*panel.columns)
    )


def fold_places(
    panel: DataFrame, measures: Sequence[str], labels: Sequence[str] = (), code: str = "cowcode", year: str = "year"
) -> DataFrame:
    """One row per code and year: places that share a code are averaged, missing values left out.

    ``labels`` are columns that name a place; of all places of a code the first name stays, the
    same in every year. Rows without a code go. Both steps are partial aggregates.
    """
    known = panel.filter(F.col(code).isNotNull())
    folded = known.groupBy(code, year).agg(*[mean(m).alias(m) for m in measures])
    if labels:
        names = known.groupBy(code).agg(F.min(F.struct(*labels)).alias("_names")).select(code, "_names.*")
        folded = lookup_join(folded, names, [code], "inner")
    return folded.select(code, *labels, year, *measures)


def duplicate_keys(df: DataFrame, keys: Sequence[str], count: str = "dupe_count") -> DataFrame:
    """Keys that occur more than once, with how often. Counted by partial aggregation."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).filter(F.col(count) > 1)


def duplicate_rows(df: DataFrame, keys: Sequence[str], count: str = "dupe_count") -> DataFrame:
    """All rows whose key repeats, with the count attached."""
    return lookup_join(df, duplicate_keys(df, keys, count), keys, "inner")


def keep_panel(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep every row of ``base`` and add ``other`` where the composite key matches.

    Missing years of ``base`` (before independence, say) drop the other panel's rows.
    """
    return lookup_join(base, other, keys, "left")
