"""Readers and writers for survey files and panels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from natal.functions.columns import in_levels, nan_to_null
from natal.functions.names import select_renamed
from natal.sources import split_csv

NA = "NA"
#: Quotes inside a quoted field are doubled, and a quoted field may hold line breaks.
DIALECT = {"header": True, "nullValue": NA, "quote": '"', "escape": '"', "multiLine": True}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    sample: float | None = None,
    declared: Mapping[str, str] | None = None,
    multiline: bool = True,
) -> DataFrame:
    """CSV with header and ``NA`` for missing; quotes inside quoted fields are doubled.

    A quoted field may hold line breaks. Files that are larger than one split are read by many
    tasks all the same, after a scan of their quotes (:mod:`natal.sources.split_csv`); smaller ones
    by one task each. ``multiline=False`` states that no field holds a line break, which saves the scan.

    With a schema there is one pass and the wanted columns are parsed only. Without one,
    types are inferred from all rows, or from a share of them with ``sample``; ``declared``
    fixes the types of some columns and leaves the others to inference.
    """
    dialect = DIALECT | {"multiLine": multiline}
    reader = spark.read.options(**dialect)
    records = split_csv.read_records(spark, path) if multiline and split_csv.needs_split(spark, path) else None
    if schema is None and records is not None:
        text = T.StructType([T.StructField(c, T.StringType()) for c in reader.csv(path).columns])  # reads the header only
        rows = split_csv.parsed(records, text, dialect)
        schema = split_csv.inferred(rows.sample(sample, seed=1) if sample else rows)
    elif schema is None:
        guess = spark.read.options(**dialect, inferSchema=True)
        schema = (guess.option("samplingRatio", sample) if sample else guess).csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if declared:
        schema = T.StructType([T.StructField(f.name, _type(declared.get(f.name)) or f.dataType) for f in schema])
    return nan_to_null(reader.schema(schema).csv(path) if records is None else split_csv.parsed(records, schema, dialect))


def _type(ddl: str | None) -> T.DataType | None:
    return T.StructType.fromDDL(f"c {ddl}")["c"].dataType if ddl else None


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV export with header and ``NA`` for missing; one file per partition."""
    df.write.mode(mode).options(**{k: v for k, v in DIALECT.items() if k != "multiLine"}).csv(path)


def write_stage(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Parquet between stages; hands back the written table."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_levels(
    spark: SparkSession, path: str, levels: Mapping[str, Sequence[str]], schema: str | T.StructType | None = None
) -> DataFrame:
    """CSV with closed domains: values outside a column's levels become null.

    Columns with levels are text; without a schema the other columns are inferred.
    """
    return with_levels(read_csv(spark, path, schema, declared=dict.fromkeys(levels, "string")), levels)


def with_levels(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    return df.withColumns({c: in_levels(c, allowed) for c, allowed in levels.items()})


def level_violations(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values outside their column's domain, with how many rows hold them.

    One pass; rows without a violation are dropped before the columns are turned into rows.
    """
    any_bad = reduce(lambda a, b: a | b, [F.coalesce(~F.col(c).isin(*allowed), F.lit(False)) for c, allowed in levels.items()])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"))
            for c in levels
        ]
    )
    bad = reduce(
        lambda a, b: a | b,
        [(F.col("cell.variable") == c) & ~F.col("cell.value").isin(*allowed) for c, allowed in levels.items()],
    )
    return (
        df.filter(any_bad)
        .select(F.explode(cells).alias("cell"))
        .filter(bad)
        .groupBy("cell.variable", "cell.value")
        .agg(F.count("*").alias("n"))
    )


def read_wide(spark: SparkSession, path: str, key: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Wide sheet landed as CSV; footer rows are those without a key."""
    return read_csv(spark, path, schema).filter(F.col(key).isNotNull())


def read_panel(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str],
    years: tuple[int, int] | None = None,
    year: str = "year",
    fmt: str = "parquet",
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """Landed panel: pick and rename ``{new: old}``, keep a range of years.

    Both reach the scan, so unused columns and row groups are not read.
    """
    source = read_csv(spark, path, schema) if fmt == "csv" else nan_to_null(spark.read.format(fmt).load(path))
    df = select_renamed(source, columns)
    return df.filter(F.col(year).between(*years)) if years else df


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Stored result of a fit or stage: read it if it is there whole, else compute and store it.

    A folder without the mark of a finished write, as a crash leaves it, does not count and is
    written over.
    """
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(path)
    return write_stage(compute(), path, mode="overwrite")
