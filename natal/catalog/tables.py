"""Survey tables, complete cases, standardised tables and file round trips."""

from pyspark.sql import functions as F

from natal.catalog.base import (
    EXPOSURE_SQL,
    NULLED_NATION,
    PANEL_SQL,
    RESPONDENTS_SQL,
    customers,
    panel,
    respondents,
    rounded,
    table,
)
from natal.catalog.exposures import FUZZY, exposed
from natal.catalog.joins import ORDER_MEANS_SQL, order_means
from natal.catalog.panels import MONTHLY_SQL, monthly_wide, months
from natal.catalog.recodes import RECODED_SQL
from natal.catalog.registry import query
from natal.operators import frame, joins
from natal.operators.panel import period_mean, wide_to_long
from natal.plans.tables import analysis_table, recodes
from natal.session import scratch_path
from natal.sources import codebook, tables


@query(
    "weighted_share",
    """SELECT svy_year, status, round(n, 2) AS n, round(pct, 6) AS pct FROM (
      SELECT *, n / sum(n) OVER (PARTITION BY svy_year) AS pct FROM (
        SELECT CAST(year(o_orderdate) AS INTEGER) AS svy_year, o_orderstatus AS status, sum(o_totalprice) AS n
        FROM orders GROUP BY ALL)) WHERE status = 'F'""",
)
def weighted_share(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("svy_year"), F.col("o_orderstatus").alias("status"), "o_totalprice"
    )
    # The share is over all statuses, so the filter comes after it.
    shares = frame.weighted_share(orders, ["svy_year"], "status", "o_totalprice").filter("status = 'F'")
    return rounded(rounded(shares, ["n"], 2), ["pct"])


@query(
    "tabulate",
    """SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS percent
    FROM customer GROUP BY 1""",
)
def tabulate(spark, sf_dir):
    return rounded(frame.tabulate(table(spark, sf_dir, "customer"), "c_mktsegment"), ["percent"])


JOINED_SQL = f"""{RESPONDENTS_SQL}, {PANEL_SQL},
joined AS (SELECT cpsidp, r.cowcode, voted, weight, corrupt FROM resp r
           LEFT JOIN panel p ON r.cowcode = p.cowcode AND svy_year = src_year)"""


def joined(spark, sf_dir):
    source = panel(spark, sf_dir).select("cowcode", F.col("src_year").alias("svy_year"), "corrupt")
    return joins.lookup_join(respondents(spark, sf_dir), source, ["cowcode", "svy_year"]).select(
        "cpsidp", "cowcode", "voted", "weight", "corrupt"
    )


@query(
    "complete_cases",
    f"""WITH {JOINED_SQL}
    SELECT cpsidp, cowcode, voted, weight, round(corrupt, 6) AS corrupt FROM joined
    WHERE cowcode IS NOT NULL AND corrupt IS NOT NULL""",
)
def complete_cases(spark, sf_dir):
    return rounded(frame.complete_cases(frame.complete_cases(joined(spark, sf_dir), ["cowcode"])), ["corrupt"])


@query(
    "case_counts",
    f"""WITH {JOINED_SQL}
    SELECT count(*) AS n_rows, count(cowcode) AS n_cowcode, count(corrupt) AS n_corrupt,
           count(*) FILTER (WHERE cowcode IS NOT NULL AND corrupt IS NOT NULL) AS nobs FROM joined""",
)
def case_counts(spark, sf_dir):
    return frame.case_counts(joined(spark, sf_dir), ["cowcode", "corrupt"])


def sql_z(columns):
    return ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}_z" for c in columns)


@query(
    "standardize",
    f"""WITH {EXPOSURE_SQL}, cc AS (SELECT cpsidp, age, fuzzy_corrupt FROM expo WHERE voted < 3)
    SELECT cpsidp, {sql_z(["age", "fuzzy_corrupt"])}, 1 / nullif(stddev_samp(age * 0) OVER (), 0) AS flat_z FROM cc""",
)
def standardize(spark, sf_dir):
    df = exposed(spark, sf_dir).filter("voted < 3").select("cpsidp", "age", "fuzzy_corrupt", F.lit(4.0).alias("flat"))
    out = frame.standardize(frame.complete_cases(df), ["age", "fuzzy_corrupt", "flat"])
    return rounded(out.select("cpsidp", "age_z", "fuzzy_corrupt_z", "flat_z"), ["age_z", "fuzzy_corrupt_z"])


COMPLETE = "voted_re IS NOT NULL AND age_re IS NOT NULL AND educ99_re IS NOT NULL AND faminc_re IS NOT NULL"


def sql_table(source, measures, z):
    """Recode, complete cases over every column, then z-scores."""
    return f"""SELECT cpsidp, cowcode, voted_re, age_re, educ99_re, faminc_re,
      {", ".join(f"round({m}, 6) AS {m}" for m in measures)}, {sql_z(z)}
    FROM ({RECODED_SQL} FROM ({source}))
    WHERE {COMPLETE} AND cowcode IS NOT NULL AND {" AND ".join(f"{m} IS NOT NULL" for m in measures)}"""


_KEEP = ["cpsidp", "cowcode", "voted", "age", "educ99", "faminc"]


def _table(df, measures, z):
    out = analysis_table(df, [*_KEEP, *measures], z)
    columns = ["cpsidp", "cowcode", *recodes(), *measures, *[f"{c}_z" for c in z]]
    return rounded(out.select(*columns), [*measures, *[f"{c}_z" for c in z]])


XS_SQL = f"""{RESPONDENTS_SQL}, {PANEL_SQL}, {ORDER_MEANS_SQL},
late AS (SELECT cowcode, avg(corrupt) AS corrupt, avg(ln_gdpcap) AS ln_gdpcap FROM panel
         WHERE src_year BETWEEN 1999 AND 2001 GROUP BY 1),
regime AS (SELECT cowcode, avg(polity2) / 1000 AS polity2 FROM order_means WHERE src_year BETWEEN 1999 AND 2001 GROUP BY 1),
early AS (SELECT cowcode, avg(corrupt) AS lagged_corrupt_9597, avg(ln_gdpcap) AS lagged_ln_gdpcap_9597 FROM panel
          WHERE src_year BETWEEN 1995 AND 1997 GROUP BY 1)"""


@query(
    "contemporaneous_table",
    f"""WITH {XS_SQL} {sql_table(
        "SELECT * FROM resp LEFT JOIN late USING (cowcode) LEFT JOIN regime USING (cowcode)",
        ["corrupt", "ln_gdpcap", "polity2"], ["corrupt", "polity2", "age"])}""",
)
def contemporaneous_table(spark, sf_dir):
    late = period_mean(panel(spark, sf_dir), ["cowcode"], ["corrupt", "ln_gdpcap"], 1999, 2001, year="src_year")
    regime = period_mean(
        order_means(spark, sf_dir).withColumn("polity2", F.col("polity2") / 1000), ["cowcode"], ["polity2"], 1999, 2001, year="src_year"
    )
    people = joins.enrich(respondents(spark, sf_dir), [late, regime], "cowcode")
    return _table(people, ["corrupt", "ln_gdpcap", "polity2"], ["corrupt", "polity2", "age"])


@query(
    "lagged_table",
    f"""WITH {XS_SQL} {sql_table(
        "SELECT * FROM resp LEFT JOIN early USING (cowcode)",
        ["lagged_corrupt_9597", "lagged_ln_gdpcap_9597"], ["age", "lagged_corrupt_9597", "lagged_ln_gdpcap_9597"])}""",
)
def lagged_table(spark, sf_dir):
    early = period_mean(
        panel(spark, sf_dir), ["cowcode"], ["corrupt", "ln_gdpcap"], 1995, 1997, lagged=True, year="src_year"
    )
    measures = ["lagged_corrupt_9597", "lagged_ln_gdpcap_9597"]
    return _table(joins.enrich(respondents(spark, sf_dir), [early], "cowcode"), measures, ["age", *measures])


@query(
    "exposure_table",
    f"""WITH {EXPOSURE_SQL} {sql_table("SELECT * FROM expo", FUZZY, ["age", *FUZZY])}""",
)
def exposure_table(spark, sf_dir):
    return _table(exposed(spark, sf_dir), FUZZY, ["age", *FUZZY])


@query(
    "csv_roundtrip",
    f"""SELECT c_custkey, c_name, nullif(c_nationkey, {NULLED_NATION}) AS cowcode, c_acctbal,
           nullif(c_mktsegment, 'BUILDING') AS segment FROM customer""",
)
def csv_roundtrip(spark, sf_dir):
    df = customers(spark, sf_dir).select(
        "c_custkey", "c_name", "cowcode", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    )
    path = scratch_path(spark, "customers.csv")
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, df.schema)


# Quotes, commas and line breaks inside fields, and NA for missing.
NOTE_SQL = "concat('The \"', c_name, '\", ', c_mktsegment, chr(10), 'line ', c_custkey)"
NOTES_SQL = f"""SELECT CAST(c_custkey AS INTEGER) AS id, CASE WHEN c_custkey % 4 <> 0 THEN {NOTE_SQL} END AS note,
       CAST(nullif(c_nationkey, {NULLED_NATION}) AS INTEGER) AS cowcode, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer"""
ALLOWED = ["AUTOMOBILE", "FURNITURE", "MACHINERY"]


def notes_file(spark, sf_dir):
    note = F.concat(F.lit('The "'), "c_name", F.lit('", '), "c_mktsegment", F.lit("\n"), F.lit("line "), F.col("c_custkey").cast("string"))
    df = customers(spark, sf_dir).select(
        F.col("c_custkey").cast("int").alias("id"), F.when(F.col("c_custkey") % 4 != 0, note).alias("note"),
        F.col("cowcode").cast("int").alias("cowcode"), "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
    )
    path = scratch_path(spark, "notes.csv")
    tables.write_csv(df, path)
    return path


@query("csv_inferred_scan", NOTES_SQL)
def csv_inferred_scan(spark, sf_dir):
    return tables.read_csv(spark, notes_file(spark, sf_dir))


@query(
    "csv_levels_scan",
    f"SELECT id, note, cowcode, c_acctbal, CASE WHEN segment IN ({', '.join(repr(a) for a in ALLOWED)}) THEN segment END AS segment FROM ({NOTES_SQL})",
)
def csv_levels_scan(spark, sf_dir):
    return tables.read_levels(spark, notes_file(spark, sf_dir), {"segment": ALLOWED})


@query("csv_split_scan", "SELECT doc_id, text, lang, n_chars FROM documents")
def csv_split_scan(spark, sf_dir):
    """Long texts with quotes and line breaks, read back from all the small splits of a file, many in a task."""
    path = scratch_path(spark, "texts.csv")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    tables.write_csv(texts, path)
    small = spark.newSession()  # so that the size of splits is this query's own
    small.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    small.conf.set("spark.sql.files.openCostInBytes", "64k")
    return tables.read_csv(small, path, texts.schema)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FIELDS = [("CUSTKEY", 12, "numeric", 0), ("NATION", 3, "numeric", 0), ("BALANCE", 12, "numeric", 2),
          ("SEGMENT", 2, "numeric", 0), ("NAME", 30, "character", 0)]


def _codebook_xml():
    """Codebook text; positions follow from the field widths."""
    out, start = [], 1
    for name, width, kind, decimals in FIELDS:
        values = "".join(
            f"<catgry><catValu>{i}</catValu><labl>{s}</labl></catgry>" for i, s in enumerate(SEGMENTS, 1) if name == "SEGMENT"
        )
        out.append(
            f'<var ID="{name}" name="{name}" dcml="{decimals}"><location StartPos="{start}" EndPos="{start + width - 1}" '
            f'width="{width}"/>{values}<varFormat type="{kind}"/></var>'
        )
        start += width
    return ["<codeBook><dataDscr>", *out, "</dataDscr></codeBook>"]


@query(
    "codebook_scan",
    f"""SELECT CAST(c_custkey AS BIGINT) AS "CUSTKEY", nullif(c_nationkey, {NULLED_NATION}) AS "NATION", c_acctbal AS "BALANCE",
           CAST(list_position({SEGMENTS!r}, c_mktsegment) AS INTEGER) AS "SEGMENT", c_mktsegment AS "SEGMENT_factor",
           c_name AS "NAME" FROM customer""",
)
def codebook_scan(spark, sf_dir):
    widths = {name: width for name, width, _, _ in FIELDS}
    values = {
        "CUSTKEY": F.col("c_custkey"),
        "NATION": F.col("cowcode"),
        "BALANCE": F.round(F.col("c_acctbal") * 100).cast("bigint"),
        "SEGMENT": F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")),
        "NAME": F.col("c_name"),
    }
    lines = customers(spark, sf_dir).select(
        F.concat(*[F.lpad(F.coalesce(c.cast("string"), F.lit("")), widths[n], " ") for n, c in values.items()]).alias("value")
    )
    data, book = scratch_path(spark, "data"), scratch_path(spark, "codebook.xml")
    lines.write.text(data)
    joins.literal_table(spark, {"value": _codebook_xml()}, "value string").coalesce(1).write.text(book)
    layout, labels = codebook.read_codebook(spark, book)
    return codebook.with_label(codebook.read_fixed_width(spark, data, layout), labels, "SEGMENT")


@query("wide_scan", f"WITH {MONTHLY_SQL} SELECT cowcode, name, round(value, 6) AS value FROM long")
def wide_scan(spark, sf_dir):
    """All months of the sheet, read back with its footer gone, one row per cell."""
    names = months(spark, sf_dir)
    wide = monthly_wide(spark, sf_dir, names)
    footer = joins.literal_table(spark, {"cowcode": [None, None]}, "cowcode int")
    path = scratch_path(spark, "wide.csv")
    tables.write_csv(wide.unionByName(footer, allowMissingColumns=True), path)
    back = tables.read_wide(spark, path, "cowcode", wide.schema)
    return rounded(wide_to_long(back, ["cowcode"], names), ["value"])


@query(
    "landed_panel_scan",
    f"""WITH {PANEL_SQL}
    SELECT cowcode, src_year AS year, round(gdpcap, 4) AS wdi_gdpcap FROM panel WHERE src_year BETWEEN 1997 AND 2000""",
)
def landed_panel_scan(spark, sf_dir):
    path = scratch_path(spark, "panel")
    tables.write_stage(panel(spark, sf_dir), path)
    columns = {"cowcode": "cowcode", "year": "src_year", "wdi_gdpcap": "gdpcap"}
    return rounded(tables.read_panel(spark, path, columns, (1997, 2000)), ["wdi_gdpcap"], 4)


@query(
    "stored_result",
    f"""WITH {PANEL_SQL} SELECT cowcode, round(avg(polity2), 6) AS polity2 FROM panel GROUP BY 1""",
)
def stored_result(spark, sf_dir):
    """The second call finds the stored result and does not compute it again."""
    path = scratch_path(spark, "fit")

    def compute():
        return period_mean(panel(spark, sf_dir), ["cowcode"], ["polity2"], 1995, 2001, year="src_year")

    tables.load_or_compute(spark, path, compute)
    return rounded(tables.load_or_compute(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("not stored"))), ["polity2"])
