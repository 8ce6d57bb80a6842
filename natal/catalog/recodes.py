"""Filters, recodes, labels and names."""

from pyspark.sql import functions as F

from natal import rules
from natal.catalog.base import NULLED_NATION, RESPONDENTS_SQL, customers, respondents, table
from natal.catalog.registry import query
from natal.functions import columns as C
from natal.functions import names
from natal.operators import entity
from natal.operators.frame import observed_levels
from natal.operators.joins import literal_table, lookup_join
from natal.operators.name_patterns import attach_code_by_pattern


def sql_in(values):
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def sql_case(column, mapping, default="NULL"):
    def text(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def sql_sets(column, mapping):
    return "CASE " + " ".join(f"WHEN {column} IN {sql_in(v)} THEN '{k}'" for k, v in mapping.items()) + " END"


@query(
    "not_in_keep_null",
    f"""SELECT c_custkey, fbpl FROM (SELECT c_custkey, nullif(c_nationkey, {NULLED_NATION}) AS fbpl FROM customer)
    WHERE coalesce(fbpl NOT IN (1, 3, 5, 9), TRUE)""",
)
def not_in_keep_null(spark, sf_dir):
    people = customers(spark, sf_dir).select("c_custkey", F.col("cowcode").alias("fbpl"))
    return people.filter(C.not_in("fbpl", [1, 3, 5, 9]))


@query(
    "in_set_filter",
    """SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND NOT (c_nationkey = 5 AND c_acctbal < 3000)
      AND nullif(c_nationkey, 7) IS NOT NULL AND c_acctbal BETWEEN 0 AND 9000""",
)
def in_set_filter(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return df.filter(
        C.in_set("c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"])
        & C.unless((F.col("c_nationkey") == 5) & (F.col("c_acctbal") < 3000))
        & C.null_if("c_nationkey", NULLED_NATION).isNotNull()
        & F.col("c_acctbal").between(0, 9000)
    )


@query(
    "sentinel_to_null",
    """SELECT p_partkey, nullif(p_size, 10) AS polity2,
           CASE WHEN p_brand = 'Brand#3' AND p_size IN (11, 12) THEN NULL ELSE p_retailprice END AS mad_gdpcap,
           ln(CASE WHEN p_brand = 'Brand#3' AND p_size IN (11, 12) THEN NULL ELSE p_retailprice END) IS NULL AS no_log
    FROM part""",
)
def sentinel_to_null(spark, sf_dir):
    false_zero = (F.col("p_brand") == "Brand#3") & F.col("p_size").isin(11, 12)
    price = C.null_where("p_retailprice", false_zero)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.null_if("p_size", 10).alias("polity2"),
        price.alias("mad_gdpcap"),
        C.log(price).isNull().alias("no_log"),
    )


FIXES = {"NATION_3": "NATION_4", "NATION_10": "NATION_12", "NATION_11": "NATION_12"}
OVERRIDES = {"NATION_5": 345, "NATION_22": 731}


@query(
    "entity_override",
    f"""SELECT c_custkey, country_name, {sql_case("country_name", OVERRIDES, "code")} AS cowcode,
           {sql_case("fips", rules.STATE_ABBREVIATIONS)} AS state_abb
    FROM (SELECT c_custkey, {sql_case("n.n_name", FIXES, "n.n_name")} AS country_name,
                 CAST(1 + c_custkey % 60 AS INTEGER) AS fips
          FROM customer JOIN nation n ON c_nationkey = n.n_nationkey)
    LEFT JOIN (SELECT n_name, CAST(n_nationkey + 200 AS INTEGER) AS code FROM nation WHERE n_nationkey < 20) k
      ON k.n_name = country_name""",
)
def entity_override(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    named = lookup_join(
        table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")),
        nation.select("n_nationkey", "n_name"),
        ["n_nationkey"],
        "inner",
    )
    fixed = entity.fix_names(named, "n_name", "country_name", FIXES)
    # The lookup is spelled differently on purpose: names are compared by their key.
    lookup = nation.filter("n_nationkey < 20").select(
        F.concat(F.lit(" "), F.replace("n_name", F.lit("_"), F.lit("-"))).alias("name"), (F.col("n_nationkey") + 200).alias("code")
    )
    coded = entity.attach_code(fixed, lookup, "country_name", overrides=OVERRIDES)
    stated = entity.attach_state(coded.withColumn("statefip", (1 + F.col("c_custkey") % 60).cast("int")))
    return stated.select("c_custkey", "country_name", "cowcode", "state_abb")


STATUS_LABELS = {"F": "Voted", "O": "Did not vote", "P": "Not in universe"}
PRIORITIES = ["0-NONE", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "label_codes",
    f"""SELECT status_label, o_orderkey, priority, CAST(substr(priority, 1, 1) AS INTEGER) + 1 AS declared_level,
           CAST(substr(priority, 1, 1) AS INTEGER) AS level
    FROM (SELECT o_orderkey, {sql_case("o_orderstatus", STATUS_LABELS)} AS status_label, o_orderpriority AS priority
          FROM orders) WHERE status_label <> 'Not in universe'""",
)
def label_codes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    labels = literal_table(
        spark,
        {"o_orderstatus": STATUS_LABELS.keys(), "status_label": STATUS_LABELS.values()},
        "o_orderstatus string, status_label string",
    )
    labelled = lookup_join(
        orders.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority")),
        labels,
        ["o_orderstatus"],
        rows=len(STATUS_LABELS),
    ).filter("status_label <> 'Not in universe'")
    levels = observed_levels(orders.withColumnRenamed("o_orderpriority", "priority"), "priority", PRIORITIES)
    ranked = lookup_join(labelled, levels, ["priority"], rows=len(PRIORITIES))
    ranked = ranked.withColumn("declared_level", C.level_rank("priority", PRIORITIES)).drop("o_orderstatus")
    return names.first_then_rest(ranked, "status_label", "o_orderkey")


RECODED_SQL = f"""
SELECT *, CASE WHEN voted = 1 THEN 0.0::DOUBLE WHEN voted = 2 THEN 1.0::DOUBLE END AS voted_re,
       CASE WHEN age BETWEEN 18 AND 29 THEN '18-29' WHEN age BETWEEN 30 AND 44 THEN '30-44'
            WHEN age BETWEEN 45 AND 64 THEN '45-64' WHEN age >= 65 THEN '65+' END AS age_re,
       {sql_sets("educ99", rules.EDUCATION_SETS)} AS educ99_re, {sql_sets("faminc", rules.INCOME_SETS)} AS faminc_re"""


@query(
    "recode_bands",
    f"""WITH {RESPONDENTS_SQL}, younger AS (SELECT cpsidp, voted, age - 3 AS age, educ99, faminc FROM resp)
    SELECT cpsidp, voted_re, age_re, educ99_re, faminc_re, svy_age_left FROM (
      {RECODED_SQL}, CAST(65 - age AS INTEGER) AS svy_age_left FROM younger)""",
)
def recode_bands(spark, sf_dir):
    from natal.plans.tables import recodes

    people = respondents(spark, sf_dir).withColumn("age", F.col("age") - 3)
    return people.withColumns(recodes()).select(
        "cpsidp", "voted_re", "age_re", "educ99_re", "faminc_re", (65 - F.col("age")).alias("svy_age_left")
    )


TYPE_LEVELS = ["ECONOMY", "SMALL", "MEDIUM", "STANDARD"]


@query(
    "typed_levels",
    f"""SELECT p_partkey, CASE WHEN p_type IN {sql_in(TYPE_LEVELS)} THEN p_type END AS p_type,
           TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_no, TRY_CAST(p_name AS INTEGER) AS name_no,
           CAST(p_size AS VARCHAR) AS size_text FROM part""",
)
def typed_levels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.in_levels("p_type", TYPE_LEVELS).alias("p_type"),
        C.to_number(F.substring("p_brand", 7, 9), "int").alias("brand_no"),
        C.to_number("p_name", "int").alias("name_no"),
        F.col("p_size").cast("string").alias("size_text"),
    )


@query(
    "level_violations",
    f"""SELECT 'p_type' AS variable, p_type AS value, count(*) AS n FROM part
    WHERE p_type NOT IN {sql_in(TYPE_LEVELS)} GROUP BY ALL
    UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE p_brand IN ('Brand#8', 'Brand#9') GROUP BY ALL""",
)
def level_violations(spark, sf_dir):
    from natal.sources.tables import level_violations as violations

    brands = [f"Brand#{i}" for i in range(1, 26) if i not in (8, 9)]
    return violations(table(spark, sf_dir, "part"), {"p_type": TYPE_LEVELS, "p_brand": brands})


@query(
    "clean_names",
    """SELECT c_custkey AS cust_key, c_nationkey AS nation_key, c_acctbal AS nation_key_2, c_mktsegment AS mkt_percent
    FROM customer""",
)
def clean_names(spark, sf_dir):
    messy = table(spark, sf_dir, "customer").toDF("Cust Key", "custName", "NATION key", "nation.key!", "Mkt%")
    cleaned = names.with_clean_names(messy)
    return cleaned.select("cust_key", *names.positions(cleaned, 3, 5))


@query(
    "select_renamed",
    "SELECT n_nationkey AS code, n_name AS country, n_regionkey + 1 AS region_no FROM nation",
)
def select_renamed(spark, sf_dir):
    df = names.select_renamed(
        table(spark, sf_dir, "nation"), {"country": "n_name", "region": "n_regionkey", "code": "n_nationkey"}
    )
    return names.first_then_rest(df.withColumn("region_no", F.col("region") + 1).drop("region"), "code")


# Patterns of names: alternatives, ends, an optional part, a class, and two that disagree on some names.
NAME_PATTERNS = {
    "^(blue|red) (anvil|bolt)$": 10,
    r"gi[sz]+mo": 20,
    r"\bgears?\b": 30,
    "^green ": 40,
    "plate$|wid": 50,
    "^.{12,}$": 60,
}


PATTERN_LIST = ", ".join(f"'{p}'" for p in NAME_PATTERNS)


@query(
    "entity_patterns",
    f"""WITH rules AS (SELECT unnest([{PATTERN_LIST}]) AS pattern, unnest({list(NAME_PATTERNS.values())}) AS code),
    names AS (SELECT DISTINCT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part),
    found AS (SELECT p_name, CAST(min(code) AS INTEGER) AS code FROM names, rules WHERE regexp_matches(k, pattern)
              GROUP BY p_name HAVING min(code) = max(code))
    SELECT p_partkey, p_name, code AS cowcode FROM part LEFT JOIN found USING (p_name)""",
)
def entity_patterns(spark, sf_dir):
    """Codes of part names by patterns; names on which patterns disagree have none."""
    return attach_code_by_pattern(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", NAME_PATTERNS)
