"""Entity names to codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from natal.functions.columns import not_in, override, to_number
from natal.operators.joins import literal_table, lookup_join
from natal.rules import CODE_LIST_JUNK, CODE_OVERRIDES, NAME_FIXES, STATE_ABBREVIATIONS


def name_key(c: Column | str) -> Column:
    """Comparable form of a name: lower case, punctuation and spare blanks removed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def fix_names(df: DataFrame, source: str, target: str, fixes: Mapping[str, str] = NAME_FIXES) -> DataFrame:
    """Corrected copy of a name column; many names may map to one."""
    return df.withColumn(target, override(source, source, fixes))


def attach_code(
    df: DataFrame,
    names: DataFrame,
    name: str,
    code: str = "cowcode",
    overrides: Mapping[str, int] = CODE_OVERRIDES,
    rows: int | None = None,
) -> DataFrame:
    """Numeric code of a named entity; manual overrides win over the lookup.

    ``names`` holds columns ``name`` and ``code``. Names that compare as equal must have one code;
    where they have several, joining fails instead of repeating rows.
    """
    keyed_names = names.select(name_key("name").alias("_key"), F.col("code").cast("int").alias(code))
    one = F.when(F.count_distinct(code) > 1, F.raise_error(F.concat(F.lit("several codes for the name "), F.col("_key")))).otherwise(F.max(code))
    lookup = keyed_names.groupBy("_key").agg(one.cast("int").alias(code))
    keyed = lookup_join(df.withColumn("_key", name_key(name)), lookup, ["_key"], "left", rows).drop("_key")
    return keyed.withColumn(code, override(code, name, overrides)) if overrides else keyed


def clean_code_list(codes: DataFrame, code: str, junk: Sequence[str] = CODE_LIST_JUNK) -> DataFrame:
    """Drop regional headings and repeated headers, then make the code a number."""
    return codes.filter(F.col(code).isNotNull() & not_in(code, junk)).withColumn(code, to_number(code, "int"))


def attach_state(df: DataFrame, fips: str = "statefip", state: str = "state_abb") -> DataFrame:
    """Postal abbreviation of a state code."""
    table = literal_table(
        df.sparkSession,
        {fips: STATE_ABBREVIATIONS.keys(), state: STATE_ABBREVIATIONS.values()},
        f"{fips} int, {state} string",
    )
    return lookup_join(df, table, [fips], "left", len(STATE_ABBREVIATIONS))
