"""The survey pipelines from raw files to analysis tables, on look-alikes made of the shared tables.

Orders and their customers are the microdata, nations the birthplaces, line items the panels.
The functions that run are those of ``natal.plans.survey_tables``, for father and mother.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal import rules
from natal.catalog.base import WHOLE_SQL, rounded, table, whole
from natal.catalog.recodes import RECODED_SQL, sql_case
from natal.catalog.registry import query
from natal.functions.columns import override, recode
from natal.operators.joins import literal_table, lookup_join
from natal.operators.panel import fold_places
from natal.plans import survey_tables as plan

# Names that make the corrections and overrides of the pipelines work.
SPELLED = {1: "Venezuala", 2: "England", 3: "Scotland", 4: "Serbia", 5: "Russia", 6: "USSR"}
PANEL_NAMES = {"Venezuala": "Venezuela", "England": "United Kingdom", "Scotland": "United Kingdom"}
KNOWN = {"Venezuela": 1, "United Kingdom": 2, "Russia": 365, "USSR": 365}
CODED = {1: 1, 2: 2, 3: 2, 4: 345, 5: 365, 6: 365}
NAMED = 22  # nations from here on are no countries
INCOMES = (100, 720, 830, 841, 843, 999)
VOTES = (1, 2, 2, 96, 99)
CITIZENS = (*rules.CITIZEN_BY_BIRTH, "Naturalized citizen", "Not a citizen")
MONTHS = [f"{m:02d}/{y}" for y in (2001, 2002) for m in range(1, 13)]
PARENTS = {"father": plan.FATHER, "mother": plan.MOTHER}


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def microdata(spark, sf_dir):
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key, buyer, nation = F.col("o_orderkey"), F.col("o_custkey"), F.col("nation")
    mother = (nation + 5) % 25
    return lookup_join(orders, buyers, ["o_custkey"], "inner").select(
        key.alias("CPSIDP"),
        (2000 + 4 * (key % 5)).cast("int").alias("YEAR"),
        (16 + buyer % 74).cast("int").alias("AGE"),
        (1 + key % 60).cast("int").alias("STATEFIP"),
        (buyer % 9).cast("int").alias("METFIPS"),
        (1 + key % 2).cast("int").alias("SEX"),
        (buyer % 19).cast("int").alias("EDUC99"),
        pick(INCOMES, (buyer % 6).cast("int")).alias("FAMINC"),
        (1 + buyer % 5).cast("int").alias("CITIZEN"),
        F.when(nation == 0, 9900).when(nation != 7, 20000 + 100 * nation).cast("int").alias("FBPL"),
        F.when(mother == 3, 11000).otherwise(20000 + 100 * mother).cast("int").alias("MBPL"),
        pick(VOTES, (F.floor(key / 5) % 5).cast("int")).alias("VOTED"),
    )


def labels(spark):
    votes = {"1": "Did not vote", "2": "Voted", "96": "Refused", "99": rules.NOT_IN_UNIVERSE}
    rows = [("VOTED", k, v) for k, v in votes.items()] + [("CITIZEN", str(i), t) for i, t in enumerate(CITIZENS, 1)]
    var, code, label = zip(*rows)
    return literal_table(spark, {"var": var, "code": code, "label": label}, "var string, code string, label string")


def nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return n.withColumn("country", F.coalesce(recode("nation", SPELLED), F.col("n_name")))


def country_names(spark, sf_dir):
    known = literal_table(spark, {"name": list(KNOWN), "code": list(KNOWN.values())}, "name string, code int")
    rest = nations(spark, sf_dir).filter(F.col("nation").between(7, NAMED - 1) | (F.col("nation") == 0))
    return known.unionByName(rest.select(F.col("n_name").alias("name"), F.col("nation").cast("int").alias("code")))


def bases(spark, sf_dir):
    """Respondents of foreign parentage per parent, the whole way from microdata and code list."""
    key = labels(spark)
    citizens = plan.citizens_by_birth(plan.in_universe(microdata(spark, sf_dir), key), key)
    junk = literal_table(spark, {"cps_country_code": [None, "Code"], "cps_country_name": ["REGION", "Label"]}, "cps_country_code string, cps_country_name string")
    places = nations(spark, sf_dir).select((20000 + 100 * F.col("nation")).cast("string").alias("cps_country_code"), F.col("country").alias("cps_country_name"))
    codes = plan.birthplace_codes(places.unionByName(junk), country_names(spark, sf_dir))
    return {name: plan.baseline(citizens, codes, p) for name, p in PARENTS.items()}


CODE_SQL = sql_case("nation", CODED, f"CASE WHEN nation < {NAMED} THEN nation END")
NAME_SQL = sql_case("n_nationkey", SPELLED, "n_name")
BASE_SQL = f"""
people AS (
  SELECT o_orderkey AS cpsidp, CAST(2000 + 4 * (o_orderkey % 5) AS INTEGER) AS year, CAST(16 + o_custkey % 74 AS INTEGER) AS age,
         CAST(1 + o_orderkey % 60 AS INTEGER) AS statefip, CAST(o_custkey % 19 AS INTEGER) AS educ99,
         {list(INCOMES)}[o_custkey % 6 + 1] AS faminc, 1 + o_custkey % 5 AS citizen, c_nationkey AS f, (c_nationkey + 5) % 25 AS m,
         {list(VOTES)}[(o_orderkey // 5) % 5 + 1] AS voted
  FROM orders JOIN customer ON o_custkey = c_custkey),
born AS (
  SELECT 'father' AS parent, people.*, CASE WHEN f = 7 THEN NULL ELSE f END AS nation FROM people WHERE f <> 0
  UNION ALL SELECT 'mother', people.*, m FROM people WHERE m <> 3),
base AS (
  SELECT parent, cpsidp, year, age, statefip, educ99, faminc, voted, CAST(20000 + 100 * nation AS INTEGER) AS cps_country_code,
         CASE WHEN {CODE_SQL} IS NOT NULL THEN {NAME_SQL} END AS cps_country_name, CAST({CODE_SQL} AS INTEGER) AS cowcode
  FROM born LEFT JOIN nation ON n_nationkey = nation WHERE voted <> 99 AND citizen <= 3)"""


def both(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("parent", F.lit(name)) for name, df in frames.items()])


@query("pipeline_baseline", f"WITH {BASE_SQL} SELECT parent, cpsidp, year, age, voted, cps_country_code, cps_country_name, cowcode FROM base")
def pipeline_baseline(spark, sf_dir):
    columns = ["CPSIDP", "YEAR", "AGE", "VOTED", "cps_country_code", "cps_country_name", "cowcode"]
    frames = {name: df.select(*[F.col(c).alias(c.lower()) for c in columns]) for name, df in bases(spark, sf_dir).items()}
    return both(frames).withColumn("cps_country_code", F.col("cps_country_code").cast("int"))


def cells(spark, sf_dir):
    """Nation by year sums of line items; per supplier first, so the join is small."""
    measures = {"q": F.col("l_quantity").cast("bigint"), "d": whole("l_discount"), "t": whole("l_tax"), "e": whole("l_extendedprice")}
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (1920 + F.col("l_orderkey") % 97).cast("int").alias("year"), *[m.alias(k) for k, m in measures.items()])
    folded = lines.groupBy("l_suppkey", "year").agg(F.count("*").alias("k"), *[F.sum(m).alias(m) for m in measures])
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    summed = lookup_join(folded, owners, ["l_suppkey"], "inner", spread=False).groupBy("nation", "year")
    return summed.agg(*[(F.sum(m) / F.sum("k")).alias(m) for m in measures])


def code_of(nation="nation"):
    return F.coalesce(recode(nation, CODED), F.when(F.col(nation) < NAMED, F.col(nation))).cast("int")


# Panels as their files would hold them. Some places share a code and a year (two parts of a kingdom, a union
# and its successor), so each panel is folded to one row per code and year.


def polity_panel(spark, sf_dir):
    free = (F.col("nation") * 7 + F.col("year")) % 13 != 0
    score = F.when(F.col("year") % 11 == 0, -66.0).otherwise(F.col("q"))
    found = cells(spark, sf_dir).filter(free).select(code_of().alias("cowcode"), "year", score.alias("polity2"))
    return fold_places(plan.regime_panel(found), ["polity2"])


def vdem_panel(spark, sf_dir):
    found = cells(spark, sf_dir).select(
        code_of().alias("cowcode"), (1000 + F.col("nation")).cast("int").alias("vdem_country_code"), F.concat(F.lit("n"), "nation").alias("vdem_country_name"),
        "year", F.col("d").alias("vdem_turnout_vap"), F.col("t").alias("vdem_corrupt"),
    )
    return fold_places(found, ["vdem_turnout_vap", "vdem_corrupt"], ["vdem_country_code", "vdem_country_name"])


def named(df, spark, sf_dir):
    """The country's name as panels spell it, instead of the nation."""
    names = nations(spark, sf_dir).select("nation", override("country", "country", PANEL_NAMES).alias("country"))
    return lookup_join(df, names, ["nation"], "inner").drop("nation")


def money(spark, sf_dir, name):
    return named(cells(spark, sf_dir).select("nation", "year", F.col("e").alias(name)), spark, sf_dir)


def wdi_panel(spark, sf_dir):
    return fold_places(plan.income_panel(money(spark, sf_dir, "wdi_gdpcap"), country_names(spark, sf_dir)), ["wdi_gdpcap", "ln_wdi_gdpcap"])


def maddison_panel(spark, sf_dir):
    long_run = plan.long_run_income_panel(money(spark, sf_dir, "mad_gdpcap"), country_names(spark, sf_dir))
    return fold_places(long_run, ["mad_gdpcap", "ln_mad_gdpcap"])


def icrg_panel(spark, sf_dir):
    spliced = plan.risk_panel(monthly_risk(spark, sf_dir), country_names(spark, sf_dir), MONTHS)
    return fold_places(spliced, ["icrg_corrupt"])


def monthly_risk(spark, sf_dir):
    """Wide sheet: a row per nation, a column per month."""
    month = F.format_string("%02d/%d", F.col("l_orderkey") % 12 + 1, 2001 + F.col("l_partkey") % 2)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", month.alias("month")).agg(F.count("*").alias("k"), F.sum(whole("l_tax")).alias("t"))
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    monthly = lookup_join(lines, owners, ["l_suppkey"], "inner", spread=False)
    wide = monthly.groupBy("nation").pivot("month", MONTHS).agg(F.sum("t") / F.sum("k"))
    return named(wide, spark, sf_dir)


CELLS_SQL = f"""{BASE_SQL},
cells AS (
  SELECT s_nationkey AS nation, CAST(1920 + l_orderkey % 97 AS INTEGER) AS year, avg(CAST(l_quantity AS BIGINT)) AS q,
         avg({WHOLE_SQL.format("l_discount")}) AS d, avg({WHOLE_SQL.format("l_tax")}) AS t, avg({WHOLE_SQL.format("l_extendedprice")}) AS e
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
coded AS (SELECT *, CAST({CODE_SQL} AS INTEGER) AS cowcode FROM cells),
polity AS (SELECT cowcode, year, avg(CASE WHEN year % 11 <> 0 THEN q END) AS polity2 FROM coded
           WHERE (nation * 7 + year) % 13 <> 0 AND cowcode IS NOT NULL GROUP BY ALL),
vdem AS (SELECT cowcode, year, avg(d) AS turnout, avg(t) AS corrupt FROM coded WHERE cowcode IS NOT NULL GROUP BY ALL),
income AS (SELECT cowcode, year, avg(e) AS e, avg(ln(e)) AS ln_e FROM coded WHERE cowcode IS NOT NULL GROUP BY ALL),
months AS (SELECT s_nationkey AS nation, CAST(2001 + l_partkey % 2 AS INTEGER) AS year, l_orderkey % 12 AS month, avg({WHOLE_SQL.format("l_tax")}) AS v
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
risk AS (SELECT CAST({CODE_SQL} AS INTEGER) AS cowcode, year, avg(v) AS icrg_corrupt FROM months  -- 4 and 6 lie outside their spliced years
         WHERE {CODE_SQL} IS NOT NULL AND nation <> 4 AND nation <> 6 GROUP BY ALL)"""

STATES_SQL = sql_case("statefip", rules.STATE_ABBREVIATIONS)


def places(measure):
    """Decimals to compare: sums of large values differ in their last bits by the order of adding."""
    return 2 if "gdpcap" in measure and "ln_" not in measure else 6


def final_sql(source, measures, z, more=()):
    """Recodes, complete cases, z-scores per parent."""
    shown = ", ".join(f"round({m}, {places(m)}) AS {m}" for m in measures)
    scores = ", ".join(f"round(({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w, 6) AS {c}_z" for c in z)
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*measures, "voted_re", "age_re", "educ99_re", "faminc_re", "cowcode"))
    return f"""SELECT parent, cpsidp, cowcode, voted_re, age_re, educ99_re, faminc_re, {STATES_SQL} AS state_abb, {"".join(f"{c}, " for c in more)}{shown}, {scores}
    FROM ({RECODED_SQL} FROM ({source})) WHERE {known} WINDOW w AS (PARTITION BY parent)"""


def final(frames, measures, z, more=()):
    columns = ["cpsidp", "cowcode", "voted_re", "age_re", "educ99_re", "faminc_re", "state_abb", *more, *measures, *[f"{c}_z" for c in z]]
    out = both({n: df.select(*columns) for n, df in frames.items()})
    coarse = [m for m in measures if places(m) < 6]
    return rounded(rounded(out, [m for m in measures if m not in coarse] + [f"{c}_z" for c in z]), coarse, 2)


NOW = ["icrg_corrupt", "vdem_corrupt", "polity2", "wdi_gdpcap", "ln_wdi_gdpcap"]
NOW_SQL = f"""WITH {CELLS_SQL},
p AS (SELECT cowcode, avg(polity2) AS polity2 FROM polity WHERE year BETWEEN 2000 AND 2016 GROUP BY 1),
v AS (SELECT cowcode, avg(corrupt) AS vdem_corrupt FROM vdem WHERE year BETWEEN 2000 AND 2016 GROUP BY 1),
g AS (SELECT cowcode, avg(e) AS wdi_gdpcap, avg(ln_e) AS ln_wdi_gdpcap FROM income WHERE year BETWEEN 2000 AND 2016 GROUP BY 1),
r AS (SELECT cowcode, avg(icrg_corrupt) AS icrg_corrupt FROM risk GROUP BY 1)
{final_sql("SELECT * FROM base LEFT JOIN p USING (cowcode) LEFT JOIN v USING (cowcode) LEFT JOIN g USING (cowcode) LEFT JOIN r USING (cowcode)", NOW, [*NOW, "age"])}"""


@query("pipeline_contemporaneous", NOW_SQL)
def pipeline_contemporaneous(spark, sf_dir):
    sections = [make(spark, sf_dir) for make in (polity_panel, vdem_panel, wdi_panel, icrg_panel)]
    frames = {n: plan.contemporaneous(b, *sections) for n, b in bases(spark, sf_dir).items()}
    return final(frames, NOW, [*NOW, "age"])


THEN = [f"lagged_{m}_7079" for m in ("polity2", "vdem_turnout_vap", "vdem_corrupt", "wdi_gdpcap", "ln_wdi_gdpcap")]
THEN_SQL = f"""WITH {CELLS_SQL},
p AS (SELECT cowcode, avg(polity2) AS {THEN[0]} FROM polity WHERE year BETWEEN 1970 AND 1979 GROUP BY 1),
v AS (SELECT cowcode, avg(turnout) AS {THEN[1]}, avg(corrupt) AS {THEN[2]} FROM vdem JOIN polity USING (cowcode, year)
      WHERE year BETWEEN 1970 AND 1979 GROUP BY 1),
g AS (SELECT cowcode, avg(e) AS {THEN[3]}, avg(ln_e) AS {THEN[4]} FROM income WHERE year BETWEEN 1970 AND 1979 GROUP BY 1)
{final_sql("SELECT * FROM base LEFT JOIN p USING (cowcode) LEFT JOIN v USING (cowcode) LEFT JOIN g USING (cowcode)", THEN, ["age", *THEN])}"""


@query("pipeline_lagged", THEN_SQL)
def pipeline_lagged(spark, sf_dir):
    sections = [make(spark, sf_dir) for make in (polity_panel, vdem_panel, wdi_panel)]
    frames = {n: plan.lagged(b, *sections) for n, b in bases(spark, sf_dir).items()}
    return final(frames, THEN, ["age", *THEN])


FUZZY = ["fuzzy_vdem_corrupt", "fuzzy_polity2", "fuzzy_mad_gdpcap", "fuzzy_ln_mad_gdpcap"]
EXPOSED_SQL = f"""WITH {CELLS_SQL},
source AS (SELECT p.cowcode, p.year AS src_year, polity2, corrupt, e, ln_e FROM polity p LEFT JOIN vdem v USING (cowcode, year)
           LEFT JOIN (SELECT * FROM income WHERE cowcode <> 345) i USING (cowcode, year)),  -- no override in the long-run panel
seen AS (SELECT parent, cpsidp, any_value(b.cowcode) AS cowcode, any_value(age) AS age, any_value(statefip) AS statefip, any_value(educ99) AS educ99,
                any_value(faminc) AS faminc, any_value(voted) AS voted, CAST(min(src_year) - any_value(year - age) AS INTEGER) AS year_diff,
                avg(corrupt) AS fuzzy_vdem_corrupt, avg(polity2) AS fuzzy_polity2, avg(e) AS fuzzy_mad_gdpcap, avg(ln_e) AS fuzzy_ln_mad_gdpcap
         FROM base b JOIN source s ON b.cowcode = s.cowcode AND src_year BETWEEN year - age - {rules.EXPOSURE_WINDOW} AND year - age GROUP BY parent, cpsidp)
{final_sql("SELECT * FROM seen", FUZZY, ["age", *FUZZY], ["year_diff"])}"""


@query("pipeline_exposure", EXPOSED_SQL)
def pipeline_exposure(spark, sf_dir):
    source = plan.source_panel(*[make(spark, sf_dir) for make in (polity_panel, vdem_panel, maddison_panel)])
    frames = {n: plan.exposure_table(b, source, PARENTS[n]) for n, b in bases(spark, sf_dir).items()}
    return final(frames, FUZZY, ["age", *FUZZY], ["year_diff"])
