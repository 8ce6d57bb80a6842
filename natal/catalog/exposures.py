"""Exposure-window queries."""

from pyspark.sql import functions as F

from natal.catalog.base import (
    EXPOSURE_SQL,
    PANEL_SQL,
    RESPONDENTS_SQL,
    VARIABLES,
    WINDOW,
    panel,
    respondents,
    rounded,
    table,
)
from natal.catalog.registry import query
from natal.operators import exposure


def exposed(spark, sf_dir):
    """Respondents with their mean exposure, unrounded."""
    return exposure.exposure_mean(
        respondents(spark, sf_dir), panel(spark, sf_dir), "cpsidp", "cowcode", "svy_year", VARIABLES, WINDOW, unique=True
    )


FUZZY = [f"fuzzy_{v}" for v in VARIABLES]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in FUZZY)


@query(
    "exposure_mean",
    f"WITH {EXPOSURE_SQL} SELECT cpsidp, cowcode, svy_year, year_diff, n_years, {_ROUNDED} FROM expo",
)
def exposure_mean(spark, sf_dir):
    return rounded(exposed(spark, sf_dir).select("cpsidp", "cowcode", "svy_year", "year_diff", "n_years", *FUZZY), FUZZY)


@query(
    "exposure_mean_pooled",
    f"""WITH {RESPONDENTS_SQL}, {PANEL_SQL}
    SELECT age, count(*) AS n_years, round(avg(corrupt), 6) AS fuzzy_corrupt, arg_min(cowcode, o) AS cowcode,
           arg_min(svy_year, o) AS svy_year, CAST(arg_min(first_year - svy_year, o) AS INTEGER) AS year_diff
    FROM (SELECT *, (first_year, cowcode, svy_year) AS o FROM (
            SELECT age, r.cowcode, svy_year, corrupt, min(src_year) OVER (PARTITION BY r.cowcode, svy_year) AS first_year
            FROM resp r JOIN panel p ON r.cowcode = p.cowcode AND src_year BETWEEN svy_year - {WINDOW} AND svy_year))
    GROUP BY age""",
)
def exposure_mean_pooled(spark, sf_dir):
    """Repeated ids (here: ages) pool all their years and keep the columns of their earliest one."""
    people = respondents(spark, sf_dir).select("age", "cowcode", "svy_year")
    out = exposure.exposure_mean(people, panel(spark, sf_dir), "age", "cowcode", "svy_year", ["corrupt"], WINDOW)
    return rounded(out, ["fuzzy_corrupt"])


@query(
    "exposure_rows",
    f"""WITH {RESPONDENTS_SQL}, {PANEL_SQL}
    SELECT cpsidp, r.cowcode, svy_year, src_year, CAST(src_year - svy_year AS INTEGER) AS year_diff,
           round(corrupt, 6) AS corrupt
    FROM resp r JOIN panel p ON r.cowcode = p.cowcode AND src_year BETWEEN svy_year - {WINDOW} AND svy_year""",
)
def exposure_rows(spark, sf_dir):
    rows = exposure.exposure_rows(
        respondents(spark, sf_dir), panel(spark, sf_dir).select("cowcode", "src_year", "corrupt"), "cowcode", "svy_year", WINDOW
    )
    return rounded(rows.select("cpsidp", "cowcode", "svy_year", "src_year", "year_diff", "corrupt"), ["corrupt"])


@query(
    "exposure_first_row",
    f"""WITH {RESPONDENTS_SQL}, {PANEL_SQL}
    SELECT cpsidp, cowcode, svy_year, src_year, year_diff, round(corrupt, 6) AS corrupt FROM (
      SELECT cpsidp, r.cowcode, svy_year, src_year, CAST(src_year - svy_year AS INTEGER) AS year_diff, corrupt,
             row_number() OVER (PARTITION BY cpsidp ORDER BY src_year) AS rn
      FROM resp r JOIN panel p ON r.cowcode = p.cowcode AND src_year BETWEEN svy_year - {WINDOW} AND svy_year)
    WHERE rn = 1""",
)
def exposure_first_row(spark, sf_dir):
    source = panel(spark, sf_dir).select("cowcode", "src_year", "corrupt")
    rows = exposure.exposure_first(respondents(spark, sf_dir).select("cpsidp", "cowcode", "svy_year"), source, "cowcode", "svy_year", WINDOW)
    return rounded(rows.select("cpsidp", "cowcode", "svy_year", "src_year", "year_diff", "corrupt"), ["corrupt"])


@query(
    "first_order",
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR)[:10] AS o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_order(spark, sf_dir):
    """First row per group in a stated order, ties settled by the remaining columns."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")
    )
    return exposure.first_row(orders, ["o_custkey"], ["o_orderdate"])
