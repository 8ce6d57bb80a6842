"""Survey-like views of the shared test tables, once for Spark and once as SQL.

Orders stand for respondents, customers for their attributes, nations for origin countries
and line items for the yearly measurements of a country. One nation code is nulled and some
nations have no panel, so that missing keys and unmatched countries really occur.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from natal.functions.columns import bands, ratio, recode
from natal.operators.joins import lookup_join

NULLED_NATION = 7
PANEL_NATIONS = 20
WINDOW = 3
VOTE_CODES = {"F": 2, "O": 1, "P": 96}
INCOME_BY_BALANCE = ((300, None, 0), (710, 0.01, 2000), (820, 2000.01, 4000), (840, 4000.01, 6000), (842, 6000.01, 8000))


_SCHEMAS: dict[tuple, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables; its schema is inferred once per version of the file, as a catalog would keep it."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    state = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    version = (path, state.getModificationTime(), state.getLen())
    if version not in _SCHEMAS:
        _SCHEMAS[version] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[version]).parquet(path)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("cowcode", F.nullif("c_nationkey", F.lit(NULLED_NATION)))


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with survey-like columns. Customers join as a lookup."""
    attributes = customers(spark, sf_dir).select(
        F.col("c_custkey").alias("o_custkey"),
        "cowcode",
        F.coalesce(bands("c_acctbal", INCOME_BY_BALANCE), F.lit(999)).alias("faminc"),
        F.col("c_mktsegment").alias("sex"),
    )
    orders = table(spark, sf_dir, "orders")
    return lookup_join(orders, attributes, ["o_custkey"], "inner").select(
        F.col("o_orderkey").alias("cpsidp"),
        "cowcode",
        F.year("o_orderdate").alias("svy_year"),
        F.col("o_totalprice").alias("weight"),
        recode("o_orderstatus", VOTE_CODES).alias("voted"),
        (18 + F.col("o_custkey") % 70).cast("int").alias("age"),
        (F.col("o_custkey") % 19).cast("int").alias("educ99"),
        "faminc",
        "sex",
    )


RESPONDENTS_SQL = f"""
resp AS (
  SELECT o_orderkey AS cpsidp, nullif(c_nationkey, {NULLED_NATION}) AS cowcode,
         CAST(year(o_orderdate) AS INTEGER) AS svy_year, o_totalprice AS weight,
         CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 WHEN 'P' THEN 96 END AS voted,
         CAST(18 + o_custkey % 70 AS INTEGER) AS age,
         CAST(o_custkey % 19 AS INTEGER) AS educ99,
         CASE WHEN c_acctbal <= 0 THEN 300 WHEN c_acctbal <= 2000 THEN 710
              WHEN c_acctbal <= 4000 THEN 820 WHEN c_acctbal <= 6000 THEN 840
              WHEN c_acctbal <= 8000 THEN 842 ELSE 999 END AS faminc,
         c_mktsegment AS sex
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def by_supplier_nation(
    spark: SparkSession, sf_dir: str, keys: Mapping[str, Column], measures: Mapping[str, Column]
) -> DataFrame:
    """Means of line-item measures per supplier nation and ``keys``.

    Line items are summed per supplier first, so the join carries one row per supplier and
    key and a supplier that holds many line items is folded before any shuffle.
    """
    parts = [
        part
        for name, c in measures.items()
        for part in (F.sum(c).alias(f"s_{name}"), F.count(c).alias(f"n_{name}"))
    ]
    per_supplier = (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", *[c.alias(k) for k, c in keys.items()], "l_discount", "l_quantity", "l_extendedprice")
        .groupBy("l_suppkey", *keys)
        .agg(*parts)
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    # One row per supplier and key is left, so no supplier can be heavy here.
    joined = lookup_join(per_supplier, suppliers, ["l_suppkey"], "inner", spread=False)
    return (
        joined.withColumnRenamed("s_nationkey", "cowcode")
        .groupBy("cowcode", *keys)
        .agg(*[ratio(F.sum(f"s_{m}"), F.sum(f"n_{m}")).alias(m) for m in measures])
    )


def whole(column: str) -> Column:
    """Hundredths as whole numbers: their sums are exact in any order."""
    return F.floor(F.col(column) * 100 + 0.5)


WHOLE_SQL = "CAST(floor({} * 100 + 0.5) AS BIGINT)"


def panel(spark: SparkSession, sf_dir: str, year: str = "src_year", nations: int = PANEL_NATIONS) -> DataFrame:
    """Country-year panel with three measures and one logged measure."""
    means = by_supplier_nation(
        spark,
        sf_dir,
        {year: F.year("l_shipdate")},
        {
            "corrupt": whole("l_discount"),
            "polity2": F.col("l_quantity"),
            "gdpcap": whole("l_extendedprice"),
        },
    )
    return means.filter(F.col("cowcode") < nations).withColumn("ln_gdpcap", F.log("gdpcap"))


PANEL_SQL = f"""
panel AS (
  SELECT s_nationkey AS cowcode, CAST(year(l_shipdate) AS INTEGER) AS src_year,
         avg({WHOLE_SQL.format("l_discount")}) AS corrupt, avg(l_quantity) AS polity2,
         avg({WHOLE_SQL.format("l_extendedprice")}) AS gdpcap,
         ln(avg({WHOLE_SQL.format("l_extendedprice")})) AS ln_gdpcap
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey < {PANEL_NATIONS}
  GROUP BY ALL)"""

VARIABLES = ("corrupt", "polity2", "gdpcap", "ln_gdpcap")

EXPOSURE_SQL = f"""{RESPONDENTS_SQL}, {PANEL_SQL},
expo AS (
  SELECT cpsidp, any_value(r.cowcode) AS cowcode, any_value(svy_year) AS svy_year,
         any_value(voted) AS voted, any_value(age) AS age, any_value(educ99) AS educ99,
         any_value(faminc) AS faminc, any_value(sex) AS sex,
         CAST(min(src_year) - any_value(svy_year) AS INTEGER) AS year_diff, count(*) AS n_years,
         {", ".join(f"avg({v}) AS fuzzy_{v}" for v in VARIABLES)}
  FROM resp r JOIN panel p ON r.cowcode = p.cowcode AND src_year BETWEEN svy_year - {WINDOW} AND svy_year
  GROUP BY cpsidp)"""


def rounded(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """Round for comparison: engines add doubles in different orders.

    Plain arithmetic; ``round`` on doubles goes through a decimal object per value.
    """
    unit = 10.0**places
    return df.withColumns({c: F.floor(F.col(c) * unit + 0.5) / unit for c in columns})
