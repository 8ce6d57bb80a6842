"""Fixed-width microdata described by an XML codebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from natal.operators.joins import lookup_join

_SCHEMA = """
_name string, _dcml int,
location struct<_StartPos: int, _EndPos: int>,
varFormat struct<_type: string>,
catgry array<struct<catValu: string, labl: string>>
"""


def read_codebook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Layout ``(var, start, end, type, decimals)`` and value labels ``(var, code, label)``."""
    variables = spark.read.format("xml").option("rowTag", "var").schema(_SCHEMA).load(path)
    layout = variables.select(
        F.col("_name").alias("var"),
        F.col("location._StartPos").alias("start"),
        F.col("location._EndPos").alias("end"),
        F.coalesce("varFormat._type", F.lit("character")).alias("type"),
        F.coalesce("_dcml", F.lit(0)).alias("decimals"),
    )
    labels = variables.select(F.col("_name").alias("var"), F.explode("catgry").alias("c")).select(
        "var", F.col("c.catValu").alias("code"), F.col("c.labl").alias("label")
    )
    return layout, labels


def read_fixed_width(spark: SparkSession, path: str, layout: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cut lines into columns by position and cast them, all as built-in expressions.

    The layout is schema information: it has one row per variable and becomes the select list.
    Numbers may carry implied decimals; a blank field is null.
    """
    wanted = layout.filter(F.col("var").isin(columns)) if columns else layout
    lines = spark.read.text(path)
    return lines.select([_field(v).alias(v["var"]) for v in wanted.orderBy("start").collect()])


def _text(v) -> Column:
    return F.nullif(F.trim(F.substring("value", v["start"], v["end"] - v["start"] + 1)), F.lit(""))


def _field(v) -> Column:
    text = _text(v)
    if v["type"] != "numeric":
        return text
    width = v["end"] - v["start"] + 1
    if v["decimals"]:
        return text.try_cast("double") / float(10 ** v["decimals"])
    return text.try_cast("int" if width <= 9 else "bigint" if width <= 18 else "decimal(38,0)")


def unread_fields(lines: DataFrame, layout: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(var, n): numeric fields that hold something which is no number, and in how many lines."""
    wanted = layout.filter(F.col("type") == "numeric")
    wanted = wanted.filter(F.col("var").isin(columns)) if columns else wanted
    fields = wanted.orderBy("start").collect()
    counts = [
        F.count_if(_text(v).isNotNull() & _field(v).isNull()).alias(v["var"]) for v in fields
    ]
    if not counts:
        return lines.sparkSession.createDataFrame([], "var string, n bigint")
    row = lines.agg(F.array(*[F.struct(F.lit(v["var"]).alias("var"), c.alias("n")) for v, c in zip(fields, counts)]).alias("a"))
    return row.select(F.inline("a"))


def with_label(df: DataFrame, labels: DataFrame, var: str, suffix: str = "_factor") -> DataFrame:
    """Add the value label of a coded column; the code stays."""
    lookup = labels.filter(F.col("var") == var).select(
        F.col("code").try_cast(df.schema[var].dataType).alias(var), F.col("label").alias(f"{var}{suffix}")
    )
    return lookup_join(df, lookup, [var], "left")
