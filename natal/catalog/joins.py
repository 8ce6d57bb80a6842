"""Join queries."""

from pyspark.sql import functions as F

from natal.catalog.base import (
    NULLED_NATION,
    PANEL_NATIONS,
    PANEL_SQL,
    WHOLE_SQL,
    customers,
    panel,
    rounded,
    table,
    whole,
)
from natal.catalog.registry import query
from natal.operators import entity, joins
from natal.operators.panel import keep_panel, period_mean

# A code list with the usual blemishes: headings without a code and repeated headers.
CODE_LIST = [("Code", "Label"), (None, "FIRST GROUP")]
CODE_LIST += [(str(n), f"NATION_{n}") for n in range(8)]
CODE_LIST += [("Code", "Label"), (None, "SECOND GROUP"), (None, None)]
CODE_LIST += [(str(n), f"NATION_{n}") for n in range(8, 15)]


def code_list(spark):
    codes, labels = zip(*CODE_LIST)
    raw = joins.literal_table(
        spark, {"cps_country_code": codes, "cps_country_name": labels}, "cps_country_code string, cps_country_name string"
    )
    return entity.clean_code_list(raw, "cps_country_code").withColumn("cowcode", F.col("cps_country_code") + 100)


def _sql_text(v):
    return "NULL" if v is None else f"'{v}'"


CODE_LIST_SQL = f"""
raw_codes(code, label) AS (VALUES {", ".join(f"({_sql_text(c)}, {_sql_text(n)})" for c, n in CODE_LIST)}),
codes AS (SELECT CAST(code AS INTEGER) AS cps_country_code, label AS cps_country_name
          FROM raw_codes WHERE code IS NOT NULL AND code NOT IN ('NA', 'Code'))"""


@query(
    "lookup_right_join",
    f"""WITH {CODE_LIST_SQL}
    SELECT c_custkey, k.cps_country_code, cps_country_name, codes.cps_country_code + 100 AS cowcode
    FROM codes RIGHT JOIN (SELECT c_custkey, nullif(c_nationkey, {NULLED_NATION}) AS cps_country_code FROM customer) k
      ON codes.cps_country_code = k.cps_country_code""",
)
def lookup_right_join(spark, sf_dir):
    people = customers(spark, sf_dir).select("c_custkey", F.col("cowcode").alias("fbpl"))
    return joins.keep_all_right(code_list(spark), people, "cps_country_code", "fbpl", len(CODE_LIST))


def order_means(spark, sf_dir):
    """Mean order value per customer nation and year; orders are folded per customer first."""
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("src_year"))
        .agg(F.sum(whole("o_totalprice")).alias("s"), F.count("o_totalprice").alias("n"))
    )
    nations = customers(spark, sf_dir).select("c_custkey", "c_nationkey")
    return (
        joins.lookup_join(per_customer, nations, ["c_custkey"], "inner", spread=False)
        .groupBy(F.col("c_nationkey").alias("cowcode"), "src_year")
        .agg((F.sum("s") / F.sum("n")).alias("polity2"))
    )


#: The two panel joins are about panels that lack countries and years; this is their gap on one side.
GAP = "cowcode > 2 AND src_year >= 1997"


ORDER_MEANS_SQL = f"""
order_means AS (
  SELECT c_nationkey AS cowcode, CAST(year(o_orderdate) AS INTEGER) AS src_year, avg({WHOLE_SQL.format("o_totalprice")}) AS polity2
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query(
    "enrich_left_chain",
    f"""WITH {PANEL_SQL}, {ORDER_MEANS_SQL},
    xs1 AS (SELECT cowcode, avg(corrupt) AS corrupt FROM panel GROUP BY 1),
    xs2 AS (SELECT s_nationkey AS cowcode, avg(s_acctbal) AS balance FROM supplier WHERE s_nationkey <> 3 GROUP BY 1),
    xs3 AS (SELECT cowcode, avg(polity2) AS polity2 FROM order_means GROUP BY 1)
    SELECT c_custkey, c.cowcode, round(corrupt, 6) AS corrupt, round(balance, 4) AS balance, round(polity2, 4) AS polity2
    FROM (SELECT c_custkey, nullif(c_nationkey, {NULLED_NATION}) AS cowcode FROM customer) c
    LEFT JOIN xs1 USING (cowcode) LEFT JOIN xs2 USING (cowcode) LEFT JOIN xs3 USING (cowcode)""",
)
def enrich_left_chain(spark, sf_dir):
    xs1 = period_mean(panel(spark, sf_dir), ["cowcode"], ["corrupt"], 1995, 2001, year="src_year")
    xs2 = (
        table(spark, sf_dir, "supplier")
        .filter("s_nationkey <> 3")
        .groupBy(F.col("s_nationkey").alias("cowcode"))
        .agg(F.avg("s_acctbal").alias("balance"))
    )
    xs3 = period_mean(order_means(spark, sf_dir), ["cowcode"], ["polity2"], 1995, 2001, year="src_year")
    people = customers(spark, sf_dir).select("c_custkey", "cowcode")
    out = joins.enrich(people, [xs1, xs2, xs3], "cowcode")
    return rounded(rounded(out, ["corrupt"]), ["balance", "polity2"], 4)


@query(
    "panel_right_join",
    f"""WITH {PANEL_SQL}, {ORDER_MEANS_SQL}
    SELECT b.cowcode, b.src_year, round(b.polity2, 4) AS polity2, round(corrupt, 6) AS corrupt
    FROM (SELECT * FROM panel WHERE src_year <> 1999) a
    RIGHT JOIN (SELECT * FROM order_means WHERE {GAP}) b ON a.cowcode = b.cowcode AND a.src_year = b.src_year""",
)
def panel_right_join(spark, sf_dir):
    other = panel(spark, sf_dir).filter("src_year <> 1999").select("cowcode", "src_year", "corrupt")
    out = keep_panel(order_means(spark, sf_dir).filter(GAP), other, ["cowcode", "src_year"])
    return rounded(rounded(out, ["corrupt"]), ["polity2"], 4)


@query(
    "panel_left_join",
    f"""WITH {PANEL_SQL}, {ORDER_MEANS_SQL}
    SELECT a.cowcode, a.src_year, round(corrupt, 6) AS corrupt, round(b.polity2, 4) AS income
    FROM panel a LEFT JOIN (SELECT * FROM order_means WHERE {GAP}) b ON a.cowcode = b.cowcode AND a.src_year = b.src_year""",
)
def panel_left_join(spark, sf_dir):
    income = order_means(spark, sf_dir).filter(GAP).withColumnRenamed("polity2", "income")
    base = panel(spark, sf_dir).select("cowcode", "src_year", "corrupt")
    return rounded(rounded(keep_panel(base, income, ["cowcode", "src_year"]), ["corrupt"]), ["income"], 4)


@query(
    "unmatched_entities",
    f"""WITH {PANEL_SQL}
    SELECT c_nationkey AS cowcode, count(*) AS n FROM customer
    WHERE c_nationkey NOT IN (SELECT cowcode FROM panel) GROUP BY 1""",
)
def unmatched_entities(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cowcode"))
    return joins.unmatched(people, panel(spark, sf_dir), ["cowcode"])


@query(
    "null_safe_join",
    f"""SELECT c_custkey, cowcode, n_name
    FROM (SELECT c_custkey, nullif(c_nationkey, {NULLED_NATION}) AS cowcode FROM customer) c
    LEFT JOIN (SELECT nullif(n_nationkey, {NULLED_NATION}) AS code, n_name FROM nation WHERE n_nationkey < {PANEL_NATIONS})
      ON cowcode IS NOT DISTINCT FROM code""",
)
def null_safe_join(spark, sf_dir):
    names = (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_nationkey") < PANEL_NATIONS)
        .select(F.nullif("n_nationkey", F.lit(NULLED_NATION)).alias("cowcode"), "n_name")
    )
    return joins.null_safe_join(customers(spark, sf_dir).select("c_custkey", "cowcode"), names, ["cowcode"])
