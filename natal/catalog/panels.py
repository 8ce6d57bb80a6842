"""Panel queries: period means, reshaping, splices and checks."""

from pyspark.sql import functions as F

from natal.catalog.base import PANEL_SQL, WHOLE_SQL, by_supplier_nation, panel, rounded, table, whole
from natal.catalog.registry import query
from natal.functions.columns import log
from natal.functions.names import containing
from natal.operators import panel as panels
from natal.operators.joins import lookup_join
from natal.rules import Splice


def months(spark, sf_dir):
    """Every month from the first to the last line item."""
    low, high = (
        table(spark, sf_dir, "lineitem")
        .select((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("m"))
        .agg(F.min("m"), F.max("m"))
        .first()
    )
    return [f"{m % 12 + 1:02d}/{m // 12}" for m in range(low, high + 1)] if low is not None else []


@query(
    "period_mean",
    f"""WITH {PANEL_SQL}
    SELECT cowcode, round(avg(corrupt), 6) AS corrupt, round(avg(polity2), 6) AS polity2
    FROM panel WHERE src_year BETWEEN 1999 AND 2001 GROUP BY 1""",
)
def period_mean(spark, sf_dir):
    out = panels.period_mean(panel(spark, sf_dir), ["cowcode"], ["corrupt", "polity2"], 1999, 2001, year="src_year")
    return rounded(out, ["corrupt", "polity2"])


@query(
    "period_mean_lagged",
    f"""WITH {PANEL_SQL}
    SELECT cowcode, round(avg(gdpcap), 4) AS lagged_gdpcap_9597, round(avg(ln_gdpcap), 6) AS lagged_ln_gdpcap_9597
    FROM panel WHERE src_year BETWEEN 1995 AND 1997 GROUP BY 1""",
)
def period_mean_lagged(spark, sf_dir):
    source = panel(spark, sf_dir)
    out = panels.period_mean(source, ["cowcode"], containing(source, "gdp"), 1995, 1997, lagged=True, year="src_year")
    return rounded(rounded(out, ["lagged_gdpcap_9597"], 4), ["lagged_ln_gdpcap_9597"])


@query(
    "mean_of_logs",
    """SELECT s_nationkey AS cowcode, round(avg(ln(nullif(l_discount, 0))), 6) AS mean_ln,
           round(ln(avg(nullif(l_discount, 0))), 6) AS ln_mean
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
)
def mean_of_logs(spark, sf_dir):
    value = F.nullif("l_discount", F.lit(0.0))
    out = by_supplier_nation(spark, sf_dir, {}, {"mean_ln": log(value), "mean": value})
    return rounded(out.select("cowcode", "mean_ln", log("mean").alias("ln_mean")), ["mean_ln", "ln_mean"])


def monthly_wide(spark, sf_dir, names):
    """Nation by month table: one column per month in ``names``, which are month/year."""
    # Months stay numbers until the line items are folded.
    number = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    monthly = by_supplier_nation(spark, sf_dir, {"ym": number}, {"value": whole("l_discount")})
    name = F.format_string("%02d/%d", F.col("ym") % 100, F.floor(F.col("ym") / 100))
    return monthly.withColumn("month", name).groupBy("cowcode").pivot("month", names).agg(F.first("value"))


MONTHLY_SQL = f"""
months(name) AS (SELECT strftime(m, '%m/%Y') FROM (SELECT unnest(generate_series(date_trunc('month', low), high, INTERVAL 1 MONTH)) AS m
                 FROM (SELECT CAST(min(l_shipdate) AS TIMESTAMP) AS low, CAST(max(l_shipdate) AS TIMESTAMP) AS high FROM lineitem))),
cells AS (SELECT s_nationkey AS cowcode, strftime(l_shipdate, '%m/%Y') AS name, avg({WHOLE_SQL.format('l_discount')}) AS value
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
long AS (SELECT n.cowcode, m.name, c.value FROM (SELECT DISTINCT cowcode FROM cells) n CROSS JOIN months m
         LEFT JOIN cells c ON c.cowcode = n.cowcode AND c.name = m.name)"""


def monthly_long(spark, sf_dir):
    names = months(spark, sf_dir)
    long = panels.wide_to_long(monthly_wide(spark, sf_dir, names), ["cowcode"], names)
    return panels.split_name(long, "name", ["month", "year"])


@query(
    "unpivot_monthly",
    f"""WITH {MONTHLY_SQL}
    SELECT cowcode, CAST(split_part(name, '/', 1) AS INTEGER) AS month, CAST(split_part(name, '/', 2) AS INTEGER) AS year,
           round(value, 6) AS value FROM long""",
)
def unpivot_monthly(spark, sf_dir):
    long = monthly_long(spark, sf_dir)
    typed = long.withColumns({"month": F.col("month").try_cast("int"), "year": F.col("year").try_cast("int")})
    return rounded(typed, ["value"]).orderBy("cowcode", "year", "month")


@query(
    "annual_from_monthly",
    f"""WITH {MONTHLY_SQL}
    SELECT cowcode, CAST(split_part(name, '/', 2) AS INTEGER) AS year, round(avg(value), 6) AS icrg_corrupt
    FROM long GROUP BY ALL""",
)
def annual_from_monthly(spark, sf_dir):
    return rounded(panels.annual_mean(monthly_long(spark, sf_dir), ["cowcode"], "value", "icrg_corrupt"), ["icrg_corrupt"])


# NATION_1 hands over to NATION_2 in 1998, NATION_3 to NATION_4 in 2000.
RULES = [
    Splice("NATION_1", None, 1997, 2),
    Splice("NATION_2", 1998, None, 2),
    Splice("NATION_3", None, 1999, 4),
    Splice("NATION_4", 2000, None, 4),
]
MERGED_SQL = "CASE n_name WHEN 'NATION_1' THEN 2 WHEN 'NATION_3' THEN 4 ELSE cowcode END"
SPLICED_SQL = f"""{PANEL_SQL},
named AS (SELECT n_name AS country, src_year AS year, CAST({MERGED_SQL} AS INTEGER) AS cowcode, corrupt
          FROM panel JOIN nation ON n_nationkey = cowcode),
spliced AS (SELECT * FROM named
            WHERE NOT (country = 'NATION_1' AND year > 1997) AND NOT (country = 'NATION_2' AND year < 1998)
              AND NOT (country = 'NATION_3' AND year > 1999) AND NOT (country = 'NATION_4' AND year < 2000))"""


def named_panel(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cowcode"), F.col("n_name").alias("country"))
    source = panel(spark, sf_dir, "year").select("cowcode", "year", "corrupt")
    return lookup_join(source, names, ["cowcode"], "inner").select("country", "year", "cowcode", "corrupt")


@query("splice_series", f"WITH {SPLICED_SQL} SELECT country, year, cowcode, round(corrupt, 6) AS corrupt FROM spliced")
def splice_series(spark, sf_dir):
    return rounded(panels.splice(named_panel(spark, sf_dir), RULES), ["corrupt"])


@query(
    "duplicate_keys",
    f"""WITH {SPLICED_SQL}
    SELECT 'before' AS stage, cowcode, year, count(*) AS dupe_count FROM named GROUP BY ALL HAVING count(*) > 1
    UNION ALL
    SELECT 'after', cowcode, year, count(*) FROM spliced GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    from natal.functions.columns import override

    merged = {r.entity: r.code for r in RULES}
    before = named_panel(spark, sf_dir).withColumn("cowcode", override("cowcode", "country", merged))
    after = panels.splice(before, RULES)
    reports = [
        panels.duplicate_keys(df, ["cowcode", "year"]).withColumn("stage", F.lit(stage))
        for stage, df in (("before", before), ("after", after))
    ]
    return reports[0].unionByName(reports[1]).select("stage", "cowcode", "year", "dupe_count")


@query(
    "duplicate_rows",
    f"""WITH {SPLICED_SQL}
    SELECT country, year, cowcode, count(*) OVER (PARTITION BY cowcode, year) AS dupe_count
    FROM named QUALIFY dupe_count > 1""",
)
def duplicate_rows(spark, sf_dir):
    from natal.functions.columns import override

    merged = {r.entity: r.code for r in RULES}
    named = named_panel(spark, sf_dir).withColumn("cowcode", override("cowcode", "country", merged)).drop("corrupt")
    return panels.duplicate_rows(named, ["cowcode", "year"])
